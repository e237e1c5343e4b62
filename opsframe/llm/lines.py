"""Line dedup by a log-template tree: lines of a template that recurs across documents are dropped.

Fixed-depth parsing: tokens with a digit become wildcards, then a line descends by its token count and its
``DEPTH`` leading tokens to a leaf. There its other tokens form ``PARTS`` runs, and the line belongs to
the template of its exact tokens and, from ``WILD_TOKENS`` tokens on, to the templates that leave out one
run as a variable field. A template recurs when ``min_docs`` documents have it. Its lines stay in the
document with the smallest ``doc_id`` and are dropped from all others; a line is dropped if any of its
templates asks for it. Lines of fewer than ``MIN_TOKENS`` tokens have no template and always stay.

All steps are built-in column functions. Template keys are combined before the shuffle; a template found
in a third of all documents is one row of the template table, and Spark splits its line rows in the join.

Null texts stay null, empty texts empty. Rows with equal ``doc_id`` are one document, and so are all rows
without ``doc_id``, which comes last. Other columns stay as they are; ``n_chars``, where present, is that
of the new text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import whole, written

DEPTH, PARTS = 2, 4
MIN_TOKENS, WILD_TOKENS = 3, 10
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
LAST = (1 << 63) - 1


def _document() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def lines(docs: DataFrame) -> DataFrame:
    """``doc, line_no, tokens`` of every line with a template."""
    every = docs.select(_document().alias("doc"), F.posexplode(F.split(whole("text"), "\n")).alias("line_no", "line"))
    line = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", VARIABLE, "*")).otherwise(F.col("line"))
    tokens = F.split(F.trim(line, F.lit(" \t\r\f\x0b")), r"\s+")
    # a generated row: the tokens are made once, however often they are used below
    once = every.select("doc", "line_no", F.explode(F.array(tokens)).alias("tokens"))
    return once.where(F.size("tokens") >= MIN_TOKENS)


def line_keys(docs: DataFrame) -> DataFrame:
    """``doc, line_no, key``: hashes of all templates of every line."""
    tokens, n = F.col("tokens"), F.size("tokens")
    width = F.ceil((n - DEPTH) / PARTS).cast("int")
    parts = {f"run{i}": F.xxhash64(F.slice(tokens, F.lit(DEPTH + 1) + width * i, width)) for i in range(PARTS)}
    # plain columns: inside the generator the hashes would be computed again for every template
    hashed = lines(docs).select("doc", "line_no", n.alias("n"), F.xxhash64(n, *[tokens[i] for i in range(DEPTH)]).alias("leaf"), *[h.alias(c) for c, h in parts.items()])
    runs = list(parts)
    exact = F.xxhash64("leaf", *runs)
    wild = [F.xxhash64(F.col("leaf"), F.lit(i), *runs[:i], *runs[i + 1:]) for i in range(PARTS)]
    keys = F.when(F.col("n") >= WILD_TOKENS, F.array(exact, *wild)).otherwise(F.array(exact))
    return hashed.select("doc", "line_no", F.explode(keys).alias("key"))


def recurring_templates(keys: DataFrame, min_docs: int = 2) -> DataFrame:
    """``key`` and ``first`` (document that keeps its lines) of templates of ``min_docs`` documents."""
    aggs = [F.min("doc").alias("first"), F.max("doc").alias("last")]
    if min_docs > 2:  # for two, first and last tell
        aggs.append(F.count_distinct("doc").alias("docs"))
    found = keys.groupBy("key").agg(*aggs).where("first < last")
    return (found.where(F.col("docs") >= min_docs) if min_docs > 2 else found).select("key", "first")


def dropped_lines(docs: DataFrame, min_docs: int = 2) -> DataFrame:
    """``doc`` and ``dropped``: numbers of the lines to drop, ascending, for documents that lose any."""
    keys = written(line_keys(docs))  # read twice
    again = written(recurring_templates(keys, min_docs))
    gone = keys.join(again, "key").where("doc > first").select("doc", "line_no")
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def drop_recurring(docs: DataFrame, min_docs: int = 2, report: str | None = None) -> DataFrame:
    """``docs`` without the recurring lines, all columns kept; ``report`` names a column for the dropped line numbers."""
    rows = docs.select(F.struct("*").alias("_row"), _document().alias("doc"))
    out = rows.join(dropped_lines(docs, min_docs), "doc", "left")
    kept = F.filter(F.split(F.col("_row.text"), "\n"), lambda _, i: ~F.array_contains(F.col("dropped"), i))
    text = F.when(F.col("dropped").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("new_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.char_length("new_text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("_row")[c].alias(c))
    out = out.select("_row", "dropped", text.alias("new_text"))
    return out.select(*columns, *([F.coalesce("dropped", F.array().cast("array<int>")).alias(report)] if report else []))
