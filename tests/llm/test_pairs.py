"""Near and exact copies: streams, Jaccard components and cover trees against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuentaclara.llm import cover_tree, exact_dedup, graph, jaccard_join
from cuentaclara.llm.common import with_row_key, without_rows, written
from cuentaclara.llm.shingles import Shingler


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def plain(value):
    return (value is None, value or 0)


# --- exact ------------------------------------------------------------------------------------


def exact_expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    return sorted(
        (plain(i), plain(min(ids, key=plain)), len(ids)) for ids in groups.values() for i in ids)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(odd, weak):
    digest = (lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(odd, digest=digest, files_per_batch=2).collect()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted((plain(r.doc_id), plain(r.keep_id), r.group_size) for r in got) == exact_expected(rows)
    assert sum(r.kept for r in got) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows})


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_state_goes_on_after_a_restart(spark, tmp_path):
    landing, checkpoint, state = (f"{tmp_path}/{n}" for n in ("in", "ck", "state"))

    def land(*rows):
        spark.createDataFrame(rows, exact_dedup.ARRIVALS).write.mode("append").parquet(landing)
        found = exact_dedup.run_stream(spark, landing, 1, checkpoint, state).collect()
        return {r.digest: (r.keep_id, r.locator, r.n) for r in found}

    assert land(("f#1", 5, "d1"), ("f#2", 9, "d2")) == {"d1": (5, "f#1", 1), "d2": (9, "f#2", 1)}
    assert land(("g#1", 3, "d1"), ("g#2", None, "d2")) == {"d1": (3, "g#1", 2), "d2": (9, "f#2", 2)}


def test_rows_that_stay(odd):
    kept = exact_dedup.kept_rows(odd)
    assert kept.columns == odd.columns and kept.count() == len({
        re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in odd.collect()})


def test_a_column_named_row_key_is_kept(odd):
    own = odd.withColumn("row_key", F.lit(5)).withColumn("_own_row_key", F.lit("x"))
    for kept in (exact_dedup.kept_rows(own), without_rows(with_row_key(own), with_row_key(own).where("false"), own.columns)):
        assert kept.dtypes == own.dtypes and {(r.row_key, r["_own_row_key"]) for r in kept.collect()} == {(5, "x")}


# --- Jaccard ----------------------------------------------------------------------------------


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def jaccard_expected(rows, k=4, percent=85):
    sets = [shingle_set(t, k) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
        and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    roots = union_find(len(rows), links)
    names = {}
    for (doc_id, _), root in zip(rows, roots):
        names[root] = min(names.get(root, doc_id), doc_id, key=plain)
    return sorted((plain(d), len(s), plain(names[r])) for (d, _), s, r in zip(rows, sets, roots))


def jaccard_found(df):
    return sorted((plain(r.doc_id), r.n_shingles, plain(r.component_id)) for r in jaccard_join.jaccard_components(df).collect())


def test_shingles_are_those_of_plain_python():
    texts = [None, "", " ", "a", "A b", "a b c", "a b c d E", "é　x 日 y z w", "q " * 600_000, "x" * 1_500_000]
    found = list(Shingler(4).sets(pa.array(texts)))
    assert [len(f) for f in found] == [len(shingle_set(t, 4)) for t in texts]


def test_jaccard_on_odd_rows(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert jaccard_found(odd) == jaccard_expected(rows)
    kept = jaccard_join.kept_rows(odd)
    assert kept.columns == odd.columns
    classes = {c for _, n, c in jaccard_expected(rows) if n}
    assert kept.count() == len(classes) + sum(n == 0 for _, n, _ in jaccard_expected(rows))


def test_only_elements_of_several_sets_are_moved(spark, monkeypatch):
    """Before, each element of each prefix was written, counted and joined, and that once for every repetition of a row."""
    sizes, real = {}, jaccard_join.written
    monkeypatch.setattr(jaccard_join, "COUNT_FLUSH", 200)

    def counted(df, purpose):
        out = real(df, purpose)
        sizes[purpose] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    own = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)]
    near = [(100 + i, " ".join(f"n{j}" for j in range(60)) + f" end{i}") for i in range(3)]
    rows = own + [own[7]] * 30 + near + [(None, own[3][1]), (None, near[0][1])]
    assert jaccard_found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == jaccard_expected(rows)
    # Three near copies with prefixes of ten elements each, and no copy of a row.
    assert 0 < sizes["jaccard-keys"] <= 30 and sizes["jaccard-met"] <= 30


def test_jaccard_of_nothing(nothing):
    assert jaccard_join.jaccard_components(nothing).count() == 0


LIMITS = [{}, {"SMALL": 3, "REGION_ROWS": 8, "PIVOTS": 2, "ROUNDS": 3}, {"SMALL": 2, "REGION_ELEMENTS": 300, "PIVOTS": 1, "ROUNDS": 1, "REGION_WINDOWS": 1}]


@pytest.mark.parametrize("limits", LIMITS)
def test_jaccard_groups_chains_and_shared_passages(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 400, n)]
    texts = []
    for _ in range(14):
        base = word(int(rng.choice([2, 4, 20, 60, 200])))
        for _ in range(int(rng.choice([1, 2, 12]))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(1, len(copy) // 14) + 1))):
                copy[int(rng.integers(len(copy)))] = word(1)[0]
            texts.append(" ".join(copy))
    passage, chain = word(50), word(80)
    texts += [" ".join(passage + word(8)) for _ in range(25)]
    for i in range(25):
        texts.append(" ".join(chain))
        chain[i] = word(1)[0]
    rows = list(enumerate(texts))
    assert jaccard_found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == jaccard_expected(rows)


@pytest.mark.parametrize("windows", [0, 2, 8])
def test_a_region_is_connected_as_its_links_would(monkeypatch, windows):
    monkeypatch.setattr(jaccard_join, "REGION_WINDOWS", windows)
    rng = np.random.default_rng(windows)
    for _ in range(30):
        sets, base = [], rng.integers(0, 1 << 62, int(rng.integers(20, 60)))
        for _ in range(int(rng.integers(2, 40))):
            own = base.copy()
            own[rng.integers(0, len(own), int(rng.integers(0, 5)))] = rng.integers(0, 1 << 62)
            sets.append(np.unique(own[: len(own) - int(rng.integers(0, 6))]))
        links = [(i, j) for i in range(len(sets)) for j in range(i)
                 if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        got = jaccard_join.joined_region(np.arange(len(sets)) * 7, sets, 85)
        assert partition(union_find(len(sets), links)) == partition(union_find(len(sets), [(a // 7, b // 7) for a, b in got]))
        assert len(got) < len(sets)


def partition(roots):
    groups = {}
    for i, r in enumerate(roots):
        groups.setdefault(r, []).append(i)
    return sorted(groups.values())


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 30)]
    roots = union_find(400, links)
    smallest = {}
    for i, r in enumerate(roots):
        smallest.setdefault(r, i)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: smallest[roots[i]] for pair in links for i in pair if pair[0] != pair[1]} | {
        i: smallest[roots[i]] for i in got}


# --- vectors ----------------------------------------------------------------------------------


def vectors_expected(rows, cosine):
    unit = []
    for _, label, values in rows:
        good = label is not None and values and None not in values and np.isfinite(np.linalg.norm(values)) and np.linalg.norm(values) > 0
        unit.append(np.array(values) / np.linalg.norm(values) if good else None)
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None
        and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]
    roots, count, names = union_find(len(rows), links), [0] * len(rows), {}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for (i, _, _), r in zip(rows, roots):
        names[r] = min(names.get(r, i), i)
    return sorted((r[0], count[k], names[roots[k]]) for k, r in enumerate(rows))


@pytest.mark.parametrize("block,centres,per_home", [(4096, 2000, 1024), (30, 12, 5)])
def test_cover_tree(spark, block, centres, per_home):
    rng, rows = np.random.default_rng(0), []
    for c in range(14):
        centre = rng.normal(size=12)
        for _ in range(int(rng.choice([1, 3, 50]))):
            values = np.float32(centre + rng.normal(size=12) * rng.choice([0.02, 0.1, 0.15]))
            rows.append((len(rows), int(rng.integers(0, 2)) if c % 2 else 1, [float(v) for v in values]))
    nan = float("nan")
    rows += [(901, 1, None), (902, 1, [0.0] * 12), (903, 1, [nan] + [1.0] * 11), (904, None, rows[0][2]), (905, 1, []), (906, 1, [1.0, 2.0]),
             (907, 1, [2.0, 4.0]), (908, 1, [None] + [1.0] * 11), (909, rows[5][1], rows[5][2]), (910, rows[5][1], [2 * v for v in rows[5][2]])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("unit", F.lit(1)).repartition(3)
    got = cover_tree.near_duplicates(df, block=block, centres=centres, per_home=per_home).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == vectors_expected(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_cover_tree_at_the_threshold():
    """Two blocks around centres whose distance is the threshold: bounds near 0 must not cut or count what the products say."""
    rng = np.random.default_rng(8)
    for trial in range(60):
        a = rng.normal(size=16)
        a /= np.linalg.norm(a)
        side = rng.normal(size=16)
        side -= (side @ a) * a
        b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * side / np.linalg.norm(side)
        x = np.concatenate([c + rng.normal(size=(71, 16)) * 1e-8 for c in (a, b)])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        first = np.arange(142) < 71
        linked = x[first] @ x[~first].T >= 0.98
        links = cover_tree.pairs_of_cell(x, np.ones(142), first, False, 0.98)
        found = np.concatenate([linked.sum(1), linked.sum(0)])
        # Products themselves are rounded, in another order in blocks: pairs within that of the threshold may go either way.
        unsure = np.abs(x[first] @ x[~first].T - 0.98) < 1e-14
        slack = np.concatenate([unsure.sum(1), unsure.sum(0)])
        assert (np.abs(links.count - found) <= slack).all(), trial


def test_cover_tree_of_large_and_small_numbers(spark):
    rows = [(1, 0, [1e200, 1e200]), (2, 0, [2e200, 2e200]), (3, 0, [1e-170, 0.0]), (4, 0, [1.0, 0.0]), (5, 0, [float("inf"), 0.0]), (6, 0, [0.0, 0.0])]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}


def test_cover_tree_of_nothing(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_written_tables_are_read_back(odd):
    assert written(odd, "test").count() == odd.count()
