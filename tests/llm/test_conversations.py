"""Repairs against a plain search over all edits, also where a conversation crosses words and tasks."""

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pytest

from cuentaclara.llm import conversations, repair_grammar
from cuentaclara.llm.common import written

SCHEMA = "conv_id long, turn long, role string, text string"
FULL = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        if hit:
            new = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(conv, turn, "user" if hit == 4 else role, new)] * (2 if hit == 3 else 1)
    return out


def cheapest(turns):
    """turns: (role, text, fault). Least (cost, audit), and the lines it leaves."""
    step = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @cache
    def rest(i, state, inserted):
        found = [(0, "", ())] if i == len(turns) and state in (0, 3) else []

        def add(cost, letter, line, tail):
            if tail:
                found.append((cost + tail[0], letter + tail[1], line + tail[2]))

        if inserted < 2:
            role, goal = step[state]
            add(2, "I", (f"{role}:",), rest(i, goal, inserted + 1))
        if i < len(turns):
            role, text, fault = turns[i]
            add(3, "D", (), rest(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                new, goal = step[state]
                add(2 + extra, "R", (f"{new}:{text}",), rest(i + 1, goal, 0))
                if (state, role[:1]) in keep:
                    add(extra, "K", (f"{role}:{text}",), rest(i + 1, keep[state, role[:1]], 0))
        return min(found, key=lambda x: x[:2], default=None)

    return rest(0, 0, 0)


def expected(rows, ids):
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, turns = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        cost, audit, lines = cheapest(tuple(turns))
        initials = [t[0][:1] for t in turns]
        numbers = [r[1] for r in own if r[1] is not None]
        faults = [t[2] for t in turns]
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), int(cost), audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, out))


def random_rows(seed, convs, longest):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "a"]
    texts = ["Hi.", "no end", "", " \t", None, "Yes!\n", "Why?", "ünd.", "日本", "\x00."]
    rows = []
    for conv in [*range(convs), None]:
        for _ in range(int(rng.integers(0, longest))):
            turn = None if rng.random() < 0.05 else int(rng.integers(0, longest))
            text = texts[int(rng.integers(len(texts)))]
            rows.append((conv, turn, roles[int(rng.integers(len(roles)))], text and text + " " * int(rng.integers(0, 3))))
    return rows


def got(df):
    return sorted(str(tuple(r)) for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())


@pytest.mark.parametrize("segment", [512, 3])
def test_damaged_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = random_rows(segment, 120, 14)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, report int, part string")
    assert got(conversations.report(conversations.damaged(df), df)) == expected(damaged(rows), {r[0] for r in rows})


def test_a_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", 16)
    monkeypatch.setattr(repair_grammar, "FLAT", 4)
    rng = np.random.default_rng(1)
    rows = [(7, t, str(rng.choice(["user", "assistant", "system", "tool"], p=[0.45, 0.45, 0.05, 0.05])), f"{t % 90} text{'.' if t % 7 else ''}") for t in range(250) if t % 11]
    rows += random_rows(2, 5, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    given = written(conversations.plain_rows(df), "given")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = {r.part for r in conversations.words(conversations.marked(given)).where("conv_id = 7").collect()}
        assert len(parts) > 3
        plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
        assert got(conversations.report(given)) == expected(plain, {r[0] for r in rows})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows_are_well_formed(spark, sf_dir):
    rows = written(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "given")
    found = conversations.audits(rows)
    lines = {}
    for r in conversations.repaired_rows(rows, found).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.place == len(lines[r.conv_id]) - 1
    for r in conversations.report(rows, found=found).collect():
        mine = lines.get(r.conv_id, [])
        assert FULL.fullmatch("".join(role[0] for role, _ in mine))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest() == r.repaired_sha256


def test_no_rows_and_nulls(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(conversations.report(conversations.damaged(empty), empty)) == []
    rows = [(None, None, None, None)] * 2 + [(5, None, "user", "x" * 500_000 + ".")]
    assert got(conversations.report(conversations.damaged(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(rows, SCHEMA))) == expected(damaged(rows), {None, 5})


def test_rules_share_matrices_and_change_nothing():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(repair_grammar.TERMINALS), int(rng.integers(0, 40)))) for _ in range(200)] + ["ua" * 200, "", "x" * 9, "u" * 33]
    plain, known = repair_grammar.Grammar(), repair_grammar.Grammar()
    for _ in range(5):
        counts = sum((repair_grammar.pairs(known.compressed(w)) for w in words), start=repair_grammar.Counter())
        known = known.with_pairs(counts, 60)
    assert 5 < len(known.rules) <= 60 and len(known.compressed("ua" * 200)) < 60
    for word in words:
        assert known.cheapest(known.compressed(word)) == plain.cheapest(word)
        assert [str(x) for x in repair_grammar.packed(known.word(known.compressed(word)))] == [str(x) for x in repair_grammar.packed(plain.word(word))]
