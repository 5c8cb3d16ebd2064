"""Citations: take them from tool results, keep the cited ones, remove invented links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuentaclara.functions.text import stripped
from cuentaclara.operators.skew import top_per_key

MAX_CITATIONS = 10

#: Fixed value: a markdown link to an expense; group 2 is the id.
LINK = r"\[([^\]]*)\]\(\s*/expenses/([A-Za-z0-9_\-]+)\s*\)"


#: Fields of a tool result row.
ROW_FIELDS = ("expense_id", "vendor", "amount", "currency", "date", "category", "link", "_source", "source")
_ROWS = "array<struct<" + ",".join(f"`{name}`:string" for name in ROW_FIELDS) + ">>"
_BLOCKS = "array<struct<toolResult:struct<content:array<struct<json:string>>>>>"


def tool_rows_from_messages(messages: DataFrame) -> DataFrame:
    """Tool result rows as they stand in a conversation, one row each, in the order in which they came.

    ``messages`` has conv_id, turn, role and ``content``, the JSON text of the message's blocks. Only messages of the
    user role carry results. A result is a list of rows, or an object with ``rows``; an object with an error, an
    aggregate without rows, and items that are no objects give none.
    """
    spoken = messages.where("role = 'user'").select(
        "conv_id", "turn", F.posexplode(F.from_json("content", _BLOCKS)).alias("block_no", "block"))
    results = spoken.select(
        "conv_id", "turn", "block_no", F.posexplode("block.toolResult.content").alias("item_no", "item"))
    payload = F.ltrim(F.col("item.json"))
    failed = F.coalesce(F.get_json_object(payload, "$.error"), F.lit("")).isin("", "false", "null", "0", "[]", "{}")
    listed = F.when(payload.startswith("["), payload).when(failed, F.get_json_object(payload, "$.rows"))
    rows = results.select(
        "conv_id", "turn", "block_no", "item_no", F.posexplode(F.from_json(listed, _ROWS)).alias("row_no", "row"))
    place = F.struct("turn", "block_no", "item_no", "row_no")
    return rows.where("row IS NOT NULL").select("conv_id", place.alias("pos"), "row.*")


def usable(tool_rows: DataFrame) -> DataFrame:
    """Rows that name an expense and come from a call that did not fail."""
    rows = tool_rows.where(F.coalesce(F.col("expense_id"), F.lit("")) != "")
    if "error" in tool_rows.columns:
        rows = rows.where(F.coalesce(F.col("error"), F.lit("")) == "")
    return rows


def normalize(tool_rows: DataFrame) -> DataFrame:
    """Tool result rows in citation shape. Rows without an id or from a failed call are dropped.

    Expects conv_id, pos, expense_id and, optionally, vendor, amount, currency, date, category,
    link, _source, source, error.
    """
    have = set(tool_rows.columns)

    def optional(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")) if name in have else F.lit(None).cast("string")

    return usable(tool_rows).select(
        "conv_id", "pos", "expense_id", "vendor",
        F.col("amount").try_cast("double").alias("amount"),
        "currency", "date", "category",
        F.coalesce(optional("link"), F.concat(F.lit("/expenses/"), "expense_id")).alias("link"),
        F.coalesce(optional("_source"), optional("source"), F.lit("unknown")).alias("source"),
    )


def first_per_expense(citations: DataFrame) -> DataFrame:
    """One citation per (conversation, expense): the one seen first."""
    rest = [c for c in citations.columns if c not in ("conv_id", "expense_id")]
    first = F.min_by(F.struct(*rest), "pos").alias("_row")
    return citations.groupBy("conv_id", "expense_id").agg(first).select("conv_id", "expense_id", "_row.*")


def citations(tool_rows: DataFrame, limit: int = MAX_CITATIONS) -> DataFrame:
    """The first distinct citations of each conversation."""
    distinct = first_per_expense(normalize(tool_rows))
    return top_per_key(distinct, ["conv_id"], [F.col("pos")], limit, "citation_no")


def cited_ids(text: Column) -> Column:
    """Ids linked in a text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(2)))


def cited_expenses(answers: DataFrame, tool_rows: DataFrame, limit: int = MAX_CITATIONS) -> DataFrame:
    """Citations the answer really uses, in text order, filled in from the tool results.

    ``answers`` has conv_id, turn, text. Cited ids without a tool row are left out before the
    limit is applied.
    """
    wanted = answers.select(
        "conv_id", "turn", F.posexplode(cited_ids(F.col("text"))).alias("text_pos", "expense_id")
    )
    known = first_per_expense(normalize(tool_rows))
    hydrated = wanted.join(known, ["conv_id", "expense_id"])
    return top_per_key(hydrated, ["conv_id", "turn"], [F.col("text_pos")], limit, "citation_no")


def strip_ungrounded(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Answers without the links whose expense no successful tool call returned, and the ids removed.

    Links are checked by a join on (conv_id, expense_id), so the allowed ids of a conversation
    are never gathered into one list; what returns to a row is bounded by its own text.
    """
    rows = answers.select("conv_id", "turn", "text", cited_ids(F.col("text")).alias("_ids"))
    links = rows.select("conv_id", "turn", F.explode("_ids").alias("expense_id"))
    permitted = usable(allowed).select("conv_id", "expense_id")
    invented = (
        links.join(permitted, ["conv_id", "expense_id"], "left_anti")
        .groupBy("conv_id", "turn")
        .agg(F.array_sort(F.collect_set("expense_id")).alias("removed_ids"))
    )
    joined = rows.join(invented, ["conv_id", "turn"], "left").withColumn(
        "removed_ids", F.coalesce("removed_ids", F.array().cast("array<string>"))
    )
    # The text between links and the links themselves alternate; drop the links in question.
    between = F.split("text", LINK, -1)
    whole = F.regexp_extract_all("text", F.lit(LINK), F.lit(0))
    ids = F.regexp_extract_all("text", F.lit(LINK), F.lit(2))
    kept = F.zip_with(
        whole, ids, lambda link, i: F.when(F.array_contains("removed_ids", i), F.lit("")).otherwise(link)
    )
    glued = F.concat_ws(
        "", F.flatten(F.zip_with(between, kept, lambda t, k: F.array(t, F.coalesce(k, F.lit("")))))
    )
    tidy = F.regexp_replace(glued, r"\n{3,}", "\n\n")
    # Trim every kind of white space, not only blanks.
    return joined.select("conv_id", "turn", stripped(tidy).alias("text"), "removed_ids")


def tool_call_outcome(rows: Column, error: Column, invalid: Column) -> Column:
    """ok, empty (ok without rows), error or invalid_input."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", F.lit("error"))
        .when(F.coalesce(invalid, F.lit(False)), F.lit("invalid_input"))
        .when(F.coalesce(rows, F.lit(0)) == 0, F.lit("empty"))
        .otherwise(F.lit("ok"))
    )


def tool_call_outcomes(calls: DataFrame) -> DataFrame:
    """Calls, mean latency and rows per (tool, outcome)."""
    outcome = tool_call_outcome(F.col("row_count"), F.col("error"), F.col("invalid"))
    return calls.groupBy("tool", outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        F.sum("row_count").alias("rows_returned"),
    )
