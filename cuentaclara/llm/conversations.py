"""Structure repair of conversations: faults, cheapest edits by grammar-compressed dynamic programming, repaired turns.

1. Each turn becomes one symbol (role initial and first fault). Turns are dealt out by ranges of (conversation, turn), so
   a conversation of any length spans as many tasks as it needs; a task streams its range and writes words of at most
   ``SEGMENT`` symbols with their counts. Earlier equal turns come from a pre-aggregated minimum per (conversation,
   role, digest of the text).
2. Re-Pair rules are learned on the distinct words of the whole corpus: per round the frequencies of all pairs are
   summed and the most frequent ones become rules, at most ``rules`` in all. One min-plus matrix with audit ropes per
   rule is evaluated bottom-up (``repair_grammar``) and sent to the tasks, where all conversations share it.
3. A word that is a whole conversation is evaluated at once. Words of a conversation that crosses a task border or is
   longer than a segment are multiplied in order, first per task, then across tasks.
4. The audit meets the turns again in one sorted stream per conversation, which gives the repaired turns or their digest
   in bounded memory. SHA-256 of a conversation can only be taken in order, so this stream is one task per conversation.

Defined results: a null conv_id is a conversation of its own; a null role or text is one space; null turns come first and
do not count for gaps. Turns of one number are ordered by role, then by the digest of the text; equal turns follow one
another and all but the first are duplicates. A conversation without turns has no edits. Columns other than conv_id,
turn, role and text are ignored. An audit is one value of a row, which bounds a conversation to about 10^8 turns.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuentaclara.llm import repair_grammar as grammar
from cuentaclara.llm.common import once, own_columns, ship, written

ship(__name__)

SPACE = "[^\\x20\\x09-\\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SEGMENT = 512
COUNTS = ("n_turns", "blank", "duplicate", "truncated", "illegal", "numbers")
LEGAL = ("su", "ua", "au")
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plain_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, where a null role or text is one space."""
    rows = own_columns(conversations, "conv_id", "turn", "role", "text")
    return rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after repeatable damage: dropped, emptied, stripped of sentence ends, repeated, or given to the user."""
    def text_of(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    key = F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))
    rows = once(plain_rows(conversations), hit=(F.crc32(key.cast("binary")) % 20).cast("int"))
    copies = F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def marked(rows: DataFrame) -> DataFrame:
    """Turns without their text: digest, whether blank or truncated, and whether an equal turn has a smaller number."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    # Both ways of the join read this; it is narrow, so it is written.
    marks = written(rows.select(
        "conv_id", "turn", "role", digest("text").alias("digest"), (~F.col("text").rlike(SPACE)).alias("blank"),
        (~last.isin(".", "!", "?")).alias("open_end")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = marks.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first")).select(
        *[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "digest")], F.col("first.turn").alias("first_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    return marks.join(first, same).select(
        "conv_id", "turn", "role", "digest", "blank", "open_end", (~F.col("turn").eqNullSafe(F.col("first_turn"))).alias("later"))


class Word:
    """A run of turns of one conversation within one task."""

    def __init__(self, conv) -> None:
        self.conv, self.symbols, self.first, self.last = conv, [], "", ""
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = None

    def add(self, role: str, fault: str, turn: int | None, new_number: bool, before: str | None) -> None:
        """A turn, whose fault is a name of COUNTS or empty; ``before`` is the initial of the turn before it, if known."""
        initial = role[:1]
        if fault in ("blank", "duplicate"):
            symbol = "x"
        else:
            symbol = initial if initial in ("s", "u", "a") else "o"
            symbol = symbol.upper() if fault else symbol
        if not self.symbols:
            self.first = initial
        self.symbols.append(symbol)
        self.last = initial
        self.counts["n_turns"] += 1
        if fault:
            self.counts[fault] += 1
        self.counts["illegal"] += before is not None and before + initial not in LEGAL
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.counts["numbers"] += new_number

    def row(self, part: int, ordinal: int, whole: bool) -> tuple:
        return (self.conv, part, ordinal, "".join(self.symbols), self.first, self.last, self.low, self.high, whole, *self.counts.values())


def _words_of_task(batches: Iterator, part: int) -> Iterator[tuple]:
    """Rows of ``words`` from the sorted turns of a task. A conversation is whole unless it touches a border or was cut."""
    word, before, ordinal, cut, number = None, None, 0, True, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "blank", "open_end", "later")]
        for conv, turn, role, digest_, blank, open_end, later in zip(*columns, strict=True):
            same = word is not None and word.conv == conv
            if not same or len(word.symbols) == SEGMENT:
                if word is not None:
                    yield word.row(part, ordinal, not (cut or same))
                    ordinal += 1
                    cut = same
                if not same:
                    before = None
                word = Word(conv)
            again = before is not None and before == (turn, role, digest_)
            fault = "blank" if blank else "duplicate" if later or again else "truncated" if open_end else ""
            word.add(role, fault, turn, before is None or before[0] != turn, before and before[1][:1])
            before = (turn, role, digest_)
    if word is not None:
        yield word.row(part, ordinal, False)


def words(rows: DataFrame) -> DataFrame:
    """One row per word: conversation, task and order, symbols, first and last initial, turn numbers and counts.

    ``numbers`` counts turn numbers where they change, ``illegal`` pairs inside a task; what crosses a border is added later.
    Equal turn numbers of a conversation never are in two tasks.
    """
    kind = dict(rows.dtypes)["conv_id"]
    names = ["conv_id", "part", "ordinal", "word", "first", "last", "low", "high", "whole", *COUNTS]
    schema = (f"conv_id {kind}, part int, ordinal long, word string, first string, last string, low long, high long, "
              f"whole boolean, {', '.join(f'{c} long' for c in COUNTS)}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        conv = None

        def types_seen() -> Iterator:
            nonlocal conv
            for batch in batches:
                conv = batch.schema.field("conv_id").type
                yield batch

        def out(found: list[tuple]) -> pa.RecordBatch:
            kinds = [conv, pa.int32(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * len(COUNTS)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        found = []
        for row in _words_of_task(types_seen(), TaskContext.get().partitionId()):
            found.append(row)
            if len(found) == 4096:
                yield out(found)
                found = []
        if found:
            yield out(found)

    placed = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return placed.mapInArrow(run, schema)


def learned_rules(found: DataFrame, rules: int, rounds: int) -> list[tuple[str, str, str]]:
    """Re-Pair rules of the distinct words, weighted by how often a word occurs. A round collects one row per pair of symbols."""
    distinct = written(found.groupBy("word").agg(F.count("*").alias("n")), "words")
    known = grammar.Grammar()
    for _ in range(rounds):
        have = known.rules

        def count(batches: Iterator, have=have) -> Iterator:
            import pyarrow as pa

            own, total = grammar.Grammar(have), Counter()
            for batch in batches:
                for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    for pair, times in grammar.pairs(own.compressed(word)).items():
                        total[pair] += n * times
            yield pa.RecordBatch.from_pydict({"pair": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

        counts = distinct.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        known = known.with_pairs(Counter({r["pair"]: r["n"] for r in counts.collect()}), rules)
        if len(known.rules) == len(have):
            break
    return known.rules


ENTRY = "array<struct<cost: long, audit: string>>"


def _evaluated(found: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Cost and audit of whole conversations; the matrix of any other word. Equal words of a task are evaluated once."""
    carried = [c for c in found.columns if c != "word"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*carried).schema.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, ends, matrices = grammar.Grammar(rules), {}, {}
        entry = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            costs, audits, packed = [], [], []
            for word, whole in zip(batch.column("word").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                if whole:
                    if word not in ends:
                        ends[word] = own.cheapest(own.compressed(word))
                    cost, audit = ends[word]
                else:
                    if word not in matrices:
                        matrices[word] = grammar.packed(own.word(own.compressed(word)))
                    cost, audit = None, None
                costs.append(cost)
                audits.append(audit)
                packed.append(None if whole else matrices[word])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried] + [pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(packed, entry)],
                names=[*carried, "cost", "audit", "matrix"])
            ends, matrices = {}, {}

    return found.mapInArrow(run, f"{schema}, cost long, audit string, matrix {ENTRY}")


def _composed(pieces: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """Words of one group multiplied in their order, with the counts and what happens where two of them meet."""
    schema = pieces.schema

    def compose(table):
        import pyarrow as pa

        rows = table.sort_by([("part", "ascending"), ("ordinal", "ascending")]).to_pylist()
        done, matrix = dict(rows[0]), grammar.unpacked(rows[0]["matrix"])
        for row in rows[1:]:
            matrix = grammar.product(matrix, grammar.unpacked(row["matrix"]))
            if row["part"] != done["part"]:  # within a task the words were counted as they followed one another
                done["illegal"] += done["last"] + row["first"] not in LEGAL
            for name in COUNTS:
                done[name] += row[name]
            done["part"], done["last"] = row["part"], row["last"]
            done["low"] = row["low"] if done["low"] is None else done["low"]
            done["high"] = row["high"] if row["high"] is not None else done["high"]
        if last:
            done["cost"], done["audit"] = grammar.ended(matrix[grammar.START])
            done["matrix"] = None
        else:
            done["matrix"] = grammar.packed(matrix)
        return pa.Table.from_pylist([{f.name: done[f.name] for f in table.schema}], table.schema)

    return pieces.groupBy(*keys).applyInArrow(compose, schema)


def audits(rows: DataFrame, rules: int = 96, rounds: int = 6) -> DataFrame:
    """One row per conversation that has turns: conv_id, gaps, the faults, cost and audit. A table in the shared folder."""
    found = written(words(marked(rows)), "conversation-words")
    done = written(_evaluated(found, learned_rules(found, rules, rounds)), "conversation-costs")
    whole = done.where("whole")
    cut = _composed(_composed(done.where("NOT whole"), ["conv_id", "part"], last=False), ["conv_id"], last=True)
    gaps = F.when(F.col("low").isNotNull(), F.col("high") - F.col("low") + 1 - F.col("numbers")).otherwise(0).cast("long")
    return written(whole.unionByName(cut).select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "conversation-audits")


class _Conversation:
    """The open conversation of a stream: turns go in, repaired turns come out as (role, text)."""

    def __init__(self, conv, report: dict, audit: str) -> None:
        self.conv, self.report, self.editor = conv, report, grammar.Editor(audit)

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        for new in self.editor.inserted():
            yield new, ""
        role = self.editor.edited(role)
        if role is not None:
            yield role, text

    def rest(self) -> Iterator[tuple[str, str]]:
        for new in self.editor.inserted():
            yield new, ""


def _edited(batches: Iterator) -> Iterator[tuple[_Conversation, str | None, str | None]]:
    """(conversation, role, text) per repaired turn, and (conversation, None, None) at its end."""
    names = ("conv_id", "turn", "role", "text", "report")
    now = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names]
        for conv, _, role, text, report in zip(*columns, strict=True):
            if report is not None:
                if now is not None:
                    yield from ((now, *t) for t in now.rest())
                    yield now, None, None
                now = _Conversation(conv, report, report["audit"])
            else:
                yield from ((now, *t) for t in now.turn(role, text))
    if now is not None:
        yield from ((now, *t) for t in now.rest())
        yield now, None, None


def _stream(rows: DataFrame, originals: DataFrame, found: DataFrame) -> DataFrame:
    """Per conversation one report row, then its turns in order; a conversation is in one task."""
    ids = own_columns(originals, "conv_id").distinct()
    other = found.withColumnRenamed("conv_id", "found_id")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in REPORT] + [F.coalesce("audit", F.lit("")).alias("audit")]
    heads = ids.join(other, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("binary").alias("digest"), F.struct(*zero).alias("report"))
    turns = rows.select("conv_id", "turn", "role", "text", digest("text").alias("digest"), F.lit(None).cast(heads.schema["report"].dataType).alias("report"))
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("report").isNull(), "turn", "role", "digest").drop("digest")


def report(rows: DataFrame, originals: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 for each conv_id of ``originals``.

    ``rows`` come from ``plain_rows`` or ``damaged``; ``found`` are their ``audits`` if they are there already.
    """
    originals = rows if originals is None else originals
    found = audits(rows) if found is None else found
    placed = _stream(rows, originals, found)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind, out, sha, lines = None, [], hashlib.sha256(), 0

        def types_seen() -> Iterator:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def made() -> pa.RecordBatch:
            convs, reports, shas = zip(*out, strict=True)
            columns = [pa.array([r[c] for r in reports], pa.int64()) for c in REPORT] + [pa.array([r["audit"] for r in reports], pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(convs, kind), *columns, pa.array(shas, pa.string())], names=["conv_id", *REPORT, "audit", "repaired_sha256"])

        for conversation, role, text in _edited(types_seen()):
            if role is not None:
                sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
                continue
            out.append((conversation.conv, conversation.report, sha.hexdigest()))
            sha, lines = hashlib.sha256(), 0
            if len(out) == 4096:
                yield made()
                out = []
        if out:
            yield made()

    kind = dict(placed.dtypes)["conv_id"]
    return placed.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in REPORT)}, audit string, repaired_sha256 string")


def repaired_rows(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role and text."""
    found = audits(rows) if found is None else found
    placed = _stream(rows, rows, found)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind, out, place, size = None, [], 0, 0

        def types_seen() -> Iterator:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def made() -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "place", "role", "text"])

        for conversation, role, text in _edited(types_seen()):
            if role is None:
                place = 0
                continue
            out.append((conversation.conv, place, role, text))
            place, size = place + 1, size + len(text)
            if size > 1 << 20 or len(out) == 4096:
                yield made()
                out, size = [], 0
        if out:
            yield made()

    return placed.mapInArrow(run, f"conv_id {dict(placed.dtypes)['conv_id']}, place long, role string, text string")
