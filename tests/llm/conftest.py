"""Fixtures of the training-data operators; the session comes from the parent folder."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, repeated ids, and clashing extra columns."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base + " extra", "en", None, 1), (3, None, None, None, None), (4, "", "en", "a", 0),
        (None, base.upper(), "de", "b", 3), (None, None, None, None, None), (5, "x " * 40_000, "en", "a", 9), (6, "123 456", "fr", "b", 2),
        (7, "word\x00with▁marks　and\n\nlines \U0001f600", "es", "", 1), (8, " " + base + "\n", "en", "a", 1), (9, "a b c", "en", "c", 2), (10, "y" * 300_000, "en", "c", 2),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, sig string, size int, `order` int"
    return spark.createDataFrame([r + (0.5, "r", "s", 1, 2) for r in rows], kind)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
