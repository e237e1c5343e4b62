"""Spelling variants: words one edit apart are found by two rare bigrams each.

Bigrams are ordered by how many places of the vocabulary hold them, rare ones first. A word's *prefix* is its
first three bigrams in that order with all that tie with the third; its *pivots* are two bigrams of the prefix
that share no letter, chosen by dynamic programming for the smallest sum of frequencies. One edit touches at
most one of two such bigrams, so of two near words the one whose prefix ends earlier in the order has a pivot
that lies in the other's prefix, moved by no more than the difference in length (position limit).

An edit is also on one side of the surviving pivot only: the other side is equal, and so is at least half of
the side with the edit, at its near or its far end. The index is looked up by that equal text with the length
and the pivot's position, which is what keeps the candidates few; a pair that it misses cannot be one edit
apart. Candidates are verified by edit distance.

Null texts have no words. A null id hashes as the empty string. Repeated rows count again. Words without a near
word have zero near words, no form and are their own root. Equal counts: the smaller word in code-point order.
An empty table gives no words. Words of fewer than four code points hold no two such bigrams and are near none. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import written

#: Joins of tables that grow with the vocabulary. Spark sizes them by the files of the words, a hundredth of the look-ups in memory, and would broadcast them.
SHUFFLED = "merge"
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Three bigrams of a word hold two without a common letter.
PREFIX_GRAMS = 3
MIN_LENGTH = 6


def word_counts(docs: DataFrame, typo_every: int = 0, min_length: int = MIN_LENGTH, min_count: int = 5) -> DataFrame:
    """``word, n`` of lower-cased letter runs; with ``typo_every`` those whose hash it divides lose one letter first."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.expr(f"regexp_extract_all(coalesce(text, ''), '{RUN}', 0)".replace("\\", "\\\\"))).alias("run"),
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if typo_every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.char_length("run")).cast("int")
        shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
        word = F.when(h % typo_every == 0, shorter).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= min_length)
    return counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Place of every bigram in the order, rare first; letters are at most 90, so it has at most 8,100 entries."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))
    counts = words.select(gram.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {r.gram: (k, r.n) for k, r in enumerate(counts.orderBy("n", "gram").collect())}


def pivots(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """Positions of two bigrams without a common letter and the least sum of weights, by dynamic programming over ``(position, weight)``."""
    prefix = sorted(prefix)
    before = None  # cheapest single bigram that ends before the current one starts
    best, done = None, 0
    for at, weight in prefix:
        while done < len(prefix) and prefix[done][0] <= at - 2:
            if before is None or prefix[done][1] < before[0]:
                before = (prefix[done][1], prefix[done][0])
            done += 1
        if before is not None and (best is None or before[0] + weight < best[0]):
            best = (before[0] + weight, before[1], at)
    return best[1], best[2]


def plan(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[list[int], tuple[int, int], int]:
    """Positions of the prefix, the pivots, and the rank of the prefix's last bigram."""
    grams = sorted((*ranks[word[i:i + 2]], i) for i in range(len(word) - 1))
    last = grams[PREFIX_GRAMS - 1][0]
    prefix = [(i, weight) for rank, weight, i in grams if rank <= last]
    return [i for i, _ in prefix], pivots(prefix), last


def equal_parts(word: str, at: int, length: int, there: int) -> list[str]:
    """Look-up texts of ``word``'s bigram ``at`` against words of ``length`` that have it at ``there``."""
    out = []
    if at == there:  # the edit is behind it: all before is equal, and half of what follows, at its near or far end
        half, head = max(0, (length - there - 3) // 2), word[:at + 2]
        out += [f"{length} {there} a {word[:at + 2 + half]}", f"{length} {there} b {head} {word[len(word) - half:]}"]
    if there - at == length - len(word):  # the edit is before it
        half, tail = max(0, (there - 1) // 2), word[at:]
        out += [f"{length} {there} c {word[:half]} {tail}", f"{length} {there} d {word[at - half:]}"]
    return out


def index_keys(word: str, prefix: list[int]) -> list[str]:
    return [k for i in prefix for k in equal_parts(word, i, len(word), i)]


def probe_keys(word: str, two: tuple[int, int]) -> list[str]:
    """Keys under which a word with one edit more, one less or one replaced may be indexed."""
    size = len(word)
    return [
        k for i in two for longer in (-1, 0, 1) for there in {i, i + longer}
        if 0 <= there <= size + longer - 2 for k in equal_parts(word, i, size + longer, there)
    ]


def _entries(words: DataFrame, ranks: dict[str, tuple[int, int]], probe: bool) -> DataFrame:
    """``key, word, n, last`` of every index entry, or of every look-up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 2000):
                b = whole_batch.slice(start, 2000)
                keys, of, last = [], [], []
                for k, word in enumerate(b.column(0).to_pylist()):
                    if len(word) <= PREFIX_GRAMS:
                        continue
                    prefix, two, end = plan(word, ranks)
                    own = probe_keys(word, two) if probe else index_keys(word, prefix)
                    keys += own
                    of += [k] * len(own)
                    last += [end] * len(own)
                of = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), b.column(0).take(of), b.column(1).take(of), pa.array(last, pa.int32())],
                    names=["key", "word", "n", "last"])

    return words.select("word", "n").mapInArrow(run, "key string, word string, n long, last int").select(
        F.xxhash64("key").alias("key"), "word", "n", "last")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b`` once for every two words of ``words`` that one edit parts, ``a`` the smaller."""
    ranks = gram_ranks(words)
    index, probe = _entries(words, ranks, False), _entries(words, ranks, True)
    w, v = F.col("i.word"), F.col("p.word")
    found = index.alias("i").join(probe.alias("p").hint(SHUFFLED), "key").where(
        (F.col("i.last") >= F.col("p.last")) & (w != v) & (F.levenshtein(w, v, 1) == 1))
    first = w < v
    pick = lambda name, yes: F.when(first == F.lit(yes), F.col(f"i.{name}")).otherwise(F.col(f"p.{name}"))
    return found.select(
        pick("word", True).alias("a"), pick("n", True).alias("n_a"), pick("word", False).alias("b"), pick("n", False).alias("n_b"),
    ).distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int) -> DataFrame:
    """``word, n, n_near, form, form_n`` of every word."""
    way = lambda x, y: F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n"))
    both = pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("_way")).select("_way.*")
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    wins = -F.col("best.less") >= ratio * F.col("n")
    return words.join(best.hint(SHUFFLED), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(wins, F.col("best.near")).alias("form"),
        F.when(wins, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form. Each form has more occurrences, so chains are short; every round doubles the step."""
    links = written(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = links.join(step.hint(SHUFFLED), "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        longer = written(longer)
        links = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            return links


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``word_counts``.

    ``form`` is the most frequent near word if it is ``ratio`` times as frequent; ``root`` is where the forms lead.
    """
    words = written(words)
    found = written(forms(words, near_pairs(words), ratio))
    return found.join(roots(found).hint(SHUFFLED), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
