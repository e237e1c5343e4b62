"""Toxicity by class-conditional Kneser-Ney models of the characters in words.

Each class (toxic, ordinary) has interpolated Kneser-Ney probabilities: its own counts of n-grams of
``TOP`` characters, and below them one chain of continuation counts, from ``SHARED`` characters down,
that both classes share, so expressions that are rare in a class take their probability from the shared
counts. N-grams seen once count like all others. A word's evidence is the difference of its log-likelihoods under both models; words over
``LONG_WORD`` characters are normalised to that length. A document is described by its mean evidence per
word, its three strongest words (one word up to three times) and the logarithm of its length, and a
logistic function fitted to held-back labelled rows turns them into a score from 0 to 1.

What is learned from: all labelled rows that the caller marks for training. At most ``calibration_rows``
of them, and at most a quarter, fit the logistic function (a bounded sample, those with the smallest hash
of ``doc_id``); all others are counted. Counts and evidence are written tables that grow with the input.
For scoring, the distinct words' n-grams are joined with the evidence table, and the words' sums go back to
the batches of documents they are from, which hold each distinct word once with the rows that have it. The label table is
broadcast up to ``BROADCAST_LABELS`` rows and joined by a shuffle beyond.

Null and empty texts have no words: all features are 0, and the score is the logistic function's. Repeated rows are scored alike; repeated labels of a document count once, toxic if any is.
Rows without ``doc_id`` are scored and never learned from. Without labels of both classes all evidence is
0. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import slices, whole, written

TOP, SHARED, DISCOUNT, LONG_WORD = 12, 5, 0.75, 24
CALIBRATION_ROWS, BROADCAST_LABELS = 20_000, 1_000_000
#: Rows and characters of documents that are described together.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 23
WORD = re.compile(r"\w+")
START, END = "\x02", "\x03"
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
CHAR_BITS = 12
FEATURES = ["mean_evidence", "top_1", "top_2", "top_3", "log_words"]
#: Values that bring the features near -1 to 1, and the prior weights (constant first).
CENTRE, SCALE = np.array([0.0, 8.0, 6.0, 5.0, 6.0]), np.array([1.0, 4.0, 4.0, 4.0, 1.5])
PRIOR = np.array([-1.0, 0.2, 1.0, 1.0, 0.5, -0.5])


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """Well-spread signed hashes of polynomial sums over ``n`` characters."""
    h = h + np.uint64(n * 0x632BE59BD9B4E019 & MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def grams(words: list[str]) -> tuple[np.ndarray, ...]:
    """For every character of every word, and its end: the word's index, the character's code and three longs.

    These are hashes of the last ``TOP`` characters and of those without the last, and the last ``SHARED``
    characters themselves, ``CHAR_BITS`` bits each, the last one lowest. Characters from U+0800 on share
    2,048 such codes.
    """
    pad = START * (TOP - 1)
    codes = np.frombuffer("".join([f"{pad}{w}{END}" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64) + 1
    starts = np.cumsum(lengths + TOP - 1) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    short = np.where(codes < 2048, codes, np.uint64(2048) + (codes * np.uint64(BASE) >> np.uint64(53)))
    top, context, shared = (np.zeros(len(at), np.uint64) for _ in range(3))
    for k in range(TOP):
        top = top + codes[at - k] * np.uint64(pow(BASE, k, 1 << 64))
        if k:
            context = context + codes[at - k] * np.uint64(pow(BASE, k - 1, 1 << 64))
        if k < SHARED:
            shared = shared | short[at - k] << np.uint64(CHAR_BITS * k)
    return word, codes[at].astype(np.int32), _mixed(top, TOP), _mixed(context, TOP - 1), shared.view(np.int64)


def word_counts(labelled: DataFrame) -> DataFrame:
    """``word, toxic, ordinary``: how often each word occurs in the texts of either class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array([c[w] for w in words], pa.int64()) for c in (counts[1], counts[0])]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *columns], names=["word", "toxic", "ordinary"])

        for b in slices(batches):
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[int(label)].update(WORD.findall(text.lower()))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield flush()
        yield flush()

    out = labelled.select(F.col("toxic").cast("int"), whole("text")).mapInArrow(run, "word string, toxic long, ordinary long")
    return out.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def gram_counts(words: DataFrame) -> DataFrame:
    """``gram, last, context, shared, toxic, ordinary`` of every n-gram of ``TOP`` characters."""
    names = ["last", "gram", "context", "shared", "toxic", "ordinary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 20_000):
            word, *hashes = grams(b.column(0).to_pylist())
            if not len(word):
                continue
            _, first, back = np.unique(hashes[1], return_index=True, return_inverse=True)
            sums = [np.bincount(back, b.column(i).to_numpy()[word]).astype(np.int64) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*(h[first] for h in hashes), *sums]], names=names)

    rows = words.mapInArrow(run, "last int, " + ", ".join(f"{n} long" for n in names[1:]))
    return rows.groupBy("gram").agg(
        F.min("last").alias("last"), F.min("context").alias("context"), F.min("shared").alias("shared"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def shared_backoff(top: DataFrame) -> DataFrame:
    """``shared`` and ``p``: continuation probability of every n-gram of ``SHARED`` characters."""
    last = lambda k: F.col("shared").bitwiseAND((1 << CHAR_BITS * k) - 1)
    levels = {SHARED: written(top.groupBy("shared").agg(F.count("*").alias("n")))}  # read once a level
    for k in range(SHARED - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy(last(k).alias("shared")).agg(F.count("*").alias("n"))
    p = None
    for k in range(1, SHARED + 1):
        context = Window.partitionBy(F.shiftright("shared", CHAR_BITS))  # at most one row for each character that can follow
        rows = levels[k].withColumns({"total": F.sum("n").over(context), "kinds": F.count("*").over(context)})
        if p is None:
            below = 1.0 / (F.col("kinds") + 1)
        else:
            rows = rows.withColumn("lower", last(k - 1)).join(p.select(F.col("shared").alias("lower"), F.col("p").alias("below")), "lower")
            below = F.col("below")
        kept = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")
        p = rows.select("shared", (kept + DISCOUNT * F.col("kinds") / F.col("total") * below).alias("p"))
    return p


def evidence(top: DataFrame) -> DataFrame:
    """``context, back, grams``: log-likelihood differences by the character that follows a context, and ``back`` of unseen ones."""
    classes = ("toxic", "ordinary")
    totals = [F.sum(c).alias(f"{c}_total") for c in classes] + [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in classes]
    grams = F.collect_list(F.struct("last", *classes, "p"))  # at most one for each character that can follow
    rows = top.join(shared_backoff(top), "shared").groupBy("context").agg(grams.alias("grams"), *totals)

    def left(c: str) -> Column:
        return F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0)

    def prob(c: str, g: Column) -> Column:
        own = F.when(F.col(f"{c}_total") > 0, F.greatest(g[c] - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_total")).otherwise(0.0)
        return own + left(c) * g["p"]

    seen = F.transform("grams", lambda g: F.struct(g["last"], F.log(prob("toxic", g) / prob("ordinary", g))))
    return rows.select("context", F.log(left("toxic") / left("ordinary")).alias("back"), F.map_from_entries(seen).alias("grams"))


def word_grams(words: DataFrame) -> DataFrame:
    """``id, last, context`` for every character of every word, and its end.

    Ids and characters of a task are near one another, so that little more than the contexts' hashes is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5_000):
            word, last, _, context, _ = grams(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[word]), pa.array(last), pa.array(context)], names=["id", "last", "context"])

    return words.select("id", "word").mapInArrow(run, "id long, last int, context long")


@dataclass(frozen=True)
class Evidence:
    """Written table of ``evidence``."""

    table: DataFrame

    def values(self, words: DataFrame) -> DataFrame:
        """The rows of ``words``, whose ``word`` is distinct, that have evidence for the toxic class, and its ``value``; others are left out, as 0.

        Contexts that no labelled row has say nothing, so only the others go on to the words' sums.
        """
        numbered = written(words.withColumn("id", F.monotonically_increasing_id()))
        each = word_grams(numbered).join(self.table, "context")
        found = written(each.groupBy("id").agg(F.sum(F.coalesce(F.try_element_at("grams", F.col("last")), "back")).alias("value")))
        part = F.least(F.lit(1.0), LONG_WORD / F.char_length("word"))
        return numbered.join(found, "id").withColumn("value", F.col("value") * part).drop("id")

    def words(self, words: list[str]) -> np.ndarray:
        """Evidence of a few words."""
        asked = self.table.sparkSession.createDataFrame([(w,) for w in set(words)], "word string")
        found = {r["word"]: r["value"] for r in self.values(asked).collect()}
        return np.array([found.get(w, 0.0) for w in words])


def fit_evidence(labelled: DataFrame) -> Evidence:
    """Both models from rows ``toxic`` (1 or 0) and ``text``."""
    return Evidence(written(evidence(written(gram_counts(word_counts(labelled))))))


def postings(docs: DataFrame, keep: str, size: int = BATCH_ROWS) -> DataFrame:
    """The rows in batches of at most ``size`` and about ``BATCH_CHARS`` characters, one line each: its distinct ``words``, for each
    the number of rows that have it (``sizes``), those rows and how often they have it, and the rows' ``keep`` (``ids``, longs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        index: dict[str, int] = {}
        kept, found, chars = [], [], 0

        def line() -> pa.RecordBatch:
            n = len(kept)
            rows = np.repeat(np.arange(n), [len(x) for x in found])
            both, times = np.unique(np.concatenate(found).astype(np.int64) * n + rows, return_counts=True)
            sizes = np.bincount(both // n, minlength=len(index))
            packed = (sizes.astype("<i4"), (both % n).astype("<u2"), times.astype("<i4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | k]), pa.array([list(index)], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in packed),
                 pa.array([kept], pa.list_(pa.int64()))], names=["batch", "words", "sizes", "row", "times", "ids"])

        for b in slices(batches):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = WORD.findall(text.lower())
                kept.append(i)
                found.append(np.fromiter([index.setdefault(w, len(index)) for w in words], np.int32, len(words)))
                chars += len(text)
                if len(kept) >= size or chars >= BATCH_CHARS:
                    yield line()
                    index, kept, found, chars, k = {}, [], [], 0, k + 1
        if kept:
            yield line()

    return docs.select(F.col(keep).cast("long").alias("id"), whole("text").alias("text")).mapInArrow(
        run, "batch long, words array<string>, sizes binary, row binary, times binary, ids array<long>")


def batch_features(row: np.ndarray, times: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and ``FEATURES`` of ``n`` rows from their distinct words."""
    n_words = np.bincount(row, times, n)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = np.bincount(row, times * value, n) / np.maximum(n_words, 1)
    again = np.minimum(times, 3)
    r, v = np.repeat(row, again), np.repeat(value, again)
    order = np.lexsort((-v, r))
    r, v = r[order], v[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    x[r[place < 3], 1 + place[place < 3]] = v[place < 3]
    x[:, 4] = np.log(np.maximum(n_words, 1))
    return n_words.astype(np.int64), x


def features(docs: DataFrame, model: Evidence, keep: str) -> DataFrame:
    """Column ``keep`` (a long) of every row with ``n_words`` and ``FEATURES``.

    Words go to the evidence with the batches that have them and their places there, and only places and values come back.
    """

    def run(batch: pa.Table, found: pa.Table) -> pa.Table:
        ids, sizes, row, times = (batch.column(c)[0] for c in ("ids", "sizes", "row", "times"))
        sizes, row, times = (np.frombuffer(x.as_py(), kind) for x, kind in ((sizes, "<i4"), (row, "<u2"), (times, "<i4")))
        value = np.zeros(len(sizes))
        value[found.column("place").to_numpy()] = found.column("value").to_numpy()
        n_words, x = batch_features(row.astype(np.int64), times, np.repeat(value, sizes), len(ids))
        return pa.table([pa.array(ids.as_py(), pa.int64()), pa.array(n_words), *(pa.array(c) for c in x.T)], names=[keep, "n_words", *FEATURES])

    batches = written(postings(docs, keep))
    words = batches.select("batch", F.posexplode("words").alias("place", "word")).groupBy("word").agg(F.collect_list(F.struct("batch", "place")).alias("at"))
    values = model.values(words).select(F.explode("at").alias("at"), "value").select("at.*", "value")
    kinds = [f"{k} long" for k in (keep, "n_words")] + [f"{k} double" for k in FEATURES]
    return batches.drop("words").groupBy("batch").cogroup(values.groupBy("batch")).applyInArrow(run, ", ".join(kinds))


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights, the constant first, with a normal prior round ``PRIOR``, by Newton's method."""
    x = np.c_[np.ones(len(x)), (x - CENTRE) / SCALE]
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - PRIOR)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + strength * np.eye(len(w)), gradient)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class ToxicityModel:
    evidence: Evidence
    weights: tuple[float, ...]

    def _scored(self, docs: DataFrame, keep: str) -> DataFrame:
        z = F.lit(self.weights[0])
        for name, centre, scale, weight in zip(FEATURES, CENTRE.tolist(), SCALE.tolist(), self.weights[1:]):
            z = z + (F.col(name) - centre) * (weight / scale)
        rows = features(docs, self.evidence, keep)
        return rows.select(keep, (1 / (1 + F.exp(-z))).alias("score"), "n_words", *FEATURES)

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id, score, n_words`` and the features of every row."""
        return self._scored(docs, "doc_id")

    def keep_below(self, docs: DataFrame, score: float) -> DataFrame:
        """The rows of ``docs`` that score below ``score``, with all columns; equal texts score alike."""
        key = F.xxhash64(whole("text"))
        gone = written(self._scored(docs.select(key.alias("key"), "text"), "key").where(F.col("score") >= score).select("key").distinct())
        rows = docs.select(F.struct("*").alias("_row"), key.alias("key"))
        return rows.join(gone, "key", "left_anti").select("_row.*")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string")) % 3


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, calibration_rows: int = CALIBRATION_ROWS) -> ToxicityModel:
    """Model from the rows of ``docs`` whose id has a ``toxic`` label and fulfils ``use`` (all by default)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if use is not None:
        known = known.where(use)
    cut = F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1)
    n_labels = known.count()
    share = min(0.25, calibration_rows / max(1, n_labels))
    known = F.broadcast(known) if n_labels <= BROADCAST_LABELS else known
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    if use is not None:
        texts = texts.where(use)
    rows = written(texts.join(known, "doc_id").select("doc_id", "toxic", (cut < math.floor(share * (1 << 30))).alias("held"), "text"))
    model = fit_evidence(rows.where("not held").select("toxic", "text"))
    held = written(rows.where("held").orderBy(cut).limit(2 * calibration_rows).select("toxic", "text"))
    sample = features(held, model, "toxic").toPandas()
    weights = fit_logistic(sample[FEATURES].to_numpy(float), sample["toxic"].to_numpy(float))
    return ToxicityModel(model, tuple(float(w) for w in weights))
