"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's ``WORDS``-word shingles, lower-cased,
words between white space. Sketches merge, so parts of a document, a source or a corpus can be sketched
apart. From two sketches follow resemblance (shared among the k smallest of both), containment and, from
the k-th smallest hash, the number of distinct shingles (exact below k).

Everything is built-in column functions. A text of fewer than five words is one shingle; null and empty
texts have empty sketches, which resemble each other fully and any other not at all. Repeated rows have
equal sketches. Whole texts are hashed, of any length.

``with_next`` gives each row its successor by ``doc_id`` (null first, equal ids by text), the last one
the first row. Rows are put into ranges of ``doc_id``, and the first rows of a range are also sent to the
range before it, so no window spans more than one range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import whole

WORDS, K = 5, 128
LOWEST = -(1 << 63)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _shingle_hashes(words: Column) -> Column:
    def of_hashes(h: Column) -> Column:
        long_text = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WORDS)]))
        return F.when(F.size(h) == 0, h).when(F.size(h) < WORDS, F.array(F.xxhash64(h))).otherwise(long_text)

    return bound(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def sketch(text: Column, k: int = K) -> Column:
    """Ascending array of at most ``k`` hashes."""
    words = F.filter(F.split(F.lower(whole(text)), r"\s+"), lambda w: w != "")
    return bottom(F.array_distinct(_shingle_hashes(words)), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return bottom(F.array_union(a, b), k)


def merge_groups(df: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """``key`` and ``sketch`` of the union of each group's sketches.

    Ranks are limited before the shuffle, so a group sends at most ``k`` hashes from each task.
    """
    hashes = df.select(key, F.explode(sketch_col).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("h"))
    return hashes.withColumn("rank", rank).where(F.col("rank") <= k).groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all shingles of both."""
    def of_union(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(a, b), u))
        return F.when(F.size(u) == 0, 1.0).otherwise(both / F.size(u))

    return bound(merged(a, b, k), of_union)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``, else estimated from the k-th smallest hash."""
    share = (F.element_at(s, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too (1 for an empty a)."""
    union = distinct_shingles(merged(a, b, k), k)
    share = F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(share)


def as_text(s: Column) -> Column:
    """The hashes as hexadecimal digits, 16 each."""
    return F.concat_ws("", F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")))


def _range_of(order: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) at or below ``order``, found in two short scans."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    coarse = F.array(*[F.lit(p[0]) for p in parts[1:]]) if len(parts) > 1 else F.array().cast("array<bigint>")
    fine = F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts])
    at = lambda i: i * step + F.size(F.filter(fine[i], lambda b: b <= order))
    return bound(F.size(F.filter(coarse, lambda b: b <= order)), at)


def with_next(docs: DataFrame, given: Callable[[DataFrame], DataFrame], ranges: int | None = None) -> DataFrame:
    """``given(rows)`` with every column's value of the next row as ``next_<column>``.

    ``given`` maps rows ``doc_id, text`` to the columns wanted, ``doc_id`` and ``text`` among them.
    """
    spark = docs.sparkSession
    ranges = ranges or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"), order.alias("order"))
    cuts = rows.select(F.percentile_approx("order", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()[0]
    rows = rows.withColumn("range", _range_of(F.col("order"), sorted(set(cuts or [0]))))
    starts = sorted(rows.groupBy("range").agg(F.min("order")).collect())  # one row a range
    moved = [(first, starts[i - 1][0], 0 if i else 1) for i, (_, first) in enumerate(starts)]
    if starts:
        moved[0] = (starts[0][1], starts[-1][0], 1)
    heads = F.broadcast(spark.createDataFrame(moved, "order long, range int, wrap int"))  # one row a range
    copies = rows.drop("range").join(heads, "order").select("doc_id", "text", "order", "range", "wrap", F.lit(False).alias("own"))
    every = rows.select("doc_id", "text", "order", "range", F.lit(0).alias("wrap"), F.lit(True).alias("own")).union(copies)
    every = given(every)
    names = [c for c in every.columns if c not in ("order", "range", "wrap", "own")]
    following = Window.partitionBy("range").orderBy("wrap", "order", "doc_id", "text")
    out = every.withColumns({f"next_{c}": F.lead(c).over(following) for c in names})
    return out.where("own").select(*names, *[f"next_{c}" for c in names])


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(following, half))


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses to that and to the next text."""
    rows = with_next(docs, lambda d: d.withColumn("sketch", sketch(F.col("text"), k)))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "sketch", "next_sketch", edited(F.col("text"), F.col("next_text")).alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k))
    own, new, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(own).alias("fingerprint"), as_text(new).alias("edited_fingerprint"),
        resemblance(own, new, k).alias("near_edited"), resemblance(own, following, k).alias("near_next"),
        containment(own, new, k).alias("contained_in_edited"), distinct_shingles(own, k).alias("n_shingles"))
