"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a column expression. Per kind the matches and the pieces between them come from the same pattern, so the
lengths of both give the positions in code points. Patterns are written without back-tracking into a run of characters:
a start inside a run is tried only where the last match ended, so a run of a million letters or digits costs one pass.

Base kinds (email, ip, card, phone) are kept whatever their score. Further kinds need a score of ``THRESHOLD``: an IBAN
is confirmed by mod 97 alone; a card of 13 to 15 digits needs Luhn and a card word nearby; a social security number
has no checksum and needs its words nearby.

Defined results: a null or empty text has no spans. Every row gives one row, also repeated ones; a null doc_id stays null.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuentaclara.llm.common import once, own_columns

THRESHOLD = 0.6
NEAR = 40
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    matches: str  # kinds with the same pattern share one pass
    valid: Callable[[Column], Column]
    prior: float
    context: str
    base: bool


#: Java patterns. A possessive "++" takes the same characters as "+" here, as nothing that follows could use them.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without these characters has no match of the kind.
NEEDS = {"email": "@", "phone": "+"}


def digits(match: Column) -> Column:
    return F.translate(match, "+ ().-", "")


def luhn(match: Column) -> Column:
    d = digits(match)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod_97(match: Column) -> Column:
    """The first four characters go to the end, a letter counts as its two-digit number, and the remainder must be 1."""
    plain = F.translate(match, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(digits(m)).between(low, high)


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
KINDS = (
    Kind("email", "email", lambda m: F.lit(True), 0.8, r"(?i)mail|contact|write|courriel|correo", True),
    Kind("ip", "ip", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, r"(?i)\bip\b|host|server|address|client", True),
    Kind("card", "card", lambda m: F.when(digit_count(16, 19)(m), luhn(m)).otherwise(False), 0.9, r"(?i)card|visa|credit|carte|karte|tarjeta", True),
    Kind("phone", "phone", digit_count(8, 15), 0.7, r"(?i)phone|call|tel|mobile|fax", True),
    Kind("iban", "iban", mod_97, 0.9, r"(?i)iban|account|konto|cuenta|compte", False),
    Kind("card_short", "card", lambda m: F.when(digit_count(13, 15)(m), luhn(m)).otherwise(False), 0.4, r"(?i)card|visa|amex|credit", False),
    Kind("ssn", "ssn", lambda m: F.lit(True), 0.3, r"(?i)\bssn\b|social security", False),
)


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array, in blocks, so that the work stays near linear for very long arrays."""
    count = F.size(values)
    starts = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    zero = F.array(F.lit(0))

    def append(done: Column, x: Column) -> Column:
        return F.array_append(done, F.element_at(done, -1) + x)

    totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda t, x: t + x))
    offsets = F.aggregate(totals, zero, append)
    within = F.transform(blocks, lambda block: F.aggregate(block, zero, append))
    # Zipped, so that the offsets are computed once and not for each element.
    paired = F.arrays_zip(within.alias("sums"), F.slice(offsets, F.lit(1), F.size(blocks)).alias("offset"))
    return F.flatten(F.transform(paired, lambda z: F.transform(
        F.slice(z["sums"], F.lit(2), F.size(z["sums"]) - 1), lambda s: s + z["offset"])))


def _found(kind: str) -> Column:
    match = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), 0)
    if kind in NEEDS:
        return F.when(F.contains("text", F.lit(NEEDS[kind])), match).otherwise(F.array().cast("array<string>"))
    return match


def _between(kind: str) -> Column:
    return F.when(F.size(f"m_{kind}") > 0, F.split("text", PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>"))


def _starts(kind: str) -> Column:
    matches, gaps = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    steps = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0)))
    return running_sums(steps)


def _spans(kind: Kind) -> Column:
    matches, gaps, starts = (F.col(f"{p}_{kind.matches}") for p in "mgs")
    proposed = F.transform(matches, lambda m, i: F.struct(m.alias("match"), i.alias("i")))
    confirmed = F.filter(proposed, lambda p: kind.valid(p["match"]))

    def span(p: Column) -> Column:
        start = F.get(starts, p["i"])
        near = F.concat_ws(" ", F.right(F.get(gaps, p["i"]), F.lit(NEAR)), F.left(F.get(gaps, p["i"] + 1), F.lit(NEAR // 2)))
        bonus = F.when(near.rlike(kind.context), F.lit(0.3)).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(p["match"])).alias("end"),
            F.round(F.least(F.lit(1.0), F.lit(kind.prior) + bonus), 3).alias("score"))

    spans = F.transform(confirmed, span)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``spans``: an array of (kind, start, end, score) by kind as listed in KINDS, then start."""
    rows = own_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = once(rows, **{f"m_{k}": _found(k) for k in PATTERNS})
    rows = once(rows, **{f"g_{k}": _between(k) for k in PATTERNS})
    rows = once(rows, **{f"s_{k}": _starts(k) for k in PATTERNS})
    rows = once(rows, **{f"k_{k.name}": _spans(k) for k in KINDS})
    return rows.select("doc_id", "text", *[f"k_{k.name}" for k in KINDS]).withColumn(
        "spans", F.concat(*[F.col(f"k_{k.name}") for k in KINDS]))


def summary(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds and the digests of the spans, one row per document."""
    found = find(docs)
    base = [k for k in KINDS if k.base]
    base_spans = joined(F.concat(*[F.col(f"k_{k.name}") for k in base]))
    best = F.aggregate("spans", F.lit(0.0), lambda t, s: F.greatest(t, s["score"]))
    return found.select(
        "doc_id", *[F.size(f"k_{k.name}").cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(base_spans.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), best.alias("best_score"))
