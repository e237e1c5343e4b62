"""Best-fit packing of documents into training windows under source and duplicate conflicts.

Texts are cut into pieces of at most ``capacity - 1`` words (a piece's blanks stay with it, so pieces
joined give the text back); a piece takes its words and one separator. Pieces go, longest first, into
bins of ``capacity``. Bins are ordered by what is left in them and carry bitmaps of the sources and
duplicate clusters they hold. The search starts at the tightest bin that is large enough and goes on to
the next until one holds neither the piece's source nor its cluster; without any, a bin is opened.

Rows are dealt into shards by a hash, some ``SHARD`` pieces each, and every shard is packed in one pass
over its sorted rows; only the bins' bitmaps are held. The number of shards follows from the length of
all texts, so a hot source or cluster is spread over all shards.

Null and empty texts are one piece of no words. A null source or cluster conflicts with nothing. Repeated
rows share their source, and so never a bin. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import slices, whole

CAPACITY, SHARD = 2048, 2048
WORD = re.compile(r"\S+")
PIECES = "doc_id long, shard long, source string, cluster long, piece int, start long, end long, n_tokens int, text string"


def cut(text: str, words: int) -> list[tuple[int, int, int]]:
    """``(start, end, number of words)`` of consecutive pieces that cover ``text``."""
    out, start, n, last = [], 0, 0, 0
    for m in WORD.finditer(text):
        if n == words:
            out.append((start, m.start(), n))
            start, n = m.start(), 0
        n += 1
    return [*out, (start, len(text), n)]


def copy_cluster(text: Column | str = "text") -> Column:
    """Hash that texts share which differ in case and blanks only."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(whole(text)), r"\s+", " ")))


def pieces(docs: DataFrame, capacity: int, source: Column, cluster: Column) -> DataFrame:
    """Pieces of all texts with their shard."""
    total = docs.agg(F.sum(F.char_length(whole("text")).cast("long") + capacity)).first()[0] or 0
    shards = max(1, total // (6 * capacity * SHARD // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for b in slices(batches):
            rows = [
                (doc, shard, src, dup, k, i, j, n + 1, text[i:j])
                for doc, shard, src, dup, text in zip(*(c.to_pylist() for c in b.columns))
                for k, (i, j, n) in enumerate(cut(text, capacity - 1))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    shard = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(shards))
    cols = [F.col("doc_id").cast("long"), shard, source.cast("string"), cluster.cast("long"), whole("text")]
    return docs.select(*[c.alias(n) for c, n in zip(cols, ("doc_id", "shard", "source", "cluster", "text"))]).mapInArrow(run, PIECES)


class Bins:
    """Open bins of one shard, ordered by residual."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.held: dict[int, int] = {}  # bin: bitmap of sources and clusters
        self.bits: dict[object, int] = {}

    def _bit(self, key: object) -> int:
        return 1 << self.bits.setdefault(key, len(self.bits))

    def place(self, size: int, source: str | None, cluster: int | None) -> tuple[int, int]:
        """Bin and place of its first token in the bin."""
        mask = (self._bit(source) if source is not None else 0) | (self._bit(cluster) if cluster is not None else 0)
        for at in range(bisect_left(self.order, (size, -1)), len(self.order)):
            if not self.held[self.order[at][1]] & mask:
                left, number = self.order.pop(at)
                break
        else:
            left, number = self.capacity, self.count
            self.count += 1
        self.held[number] = self.held.get(number, 0) | mask
        if left > size:
            insort(self.order, (left - size, number))
        return number, self.capacity - left


def pack(
    docs: DataFrame, capacity: int = CAPACITY, source: Column | None = None, cluster: Column | None = None, keep_text: bool = False,
) -> DataFrame:
    """One row per piece: ``bin_id, bin_start, doc_id, piece, start, end, n_tokens`` and, if asked, ``text``.

    ``start`` and ``end`` are code points of the document's text, ``bin_start`` counts tokens.
    """
    rows = pieces(docs, capacity, source if source is not None else F.col("source"), cluster if cluster is not None else copy_cluster())
    kept = ["doc_id", "piece", "start", "end", "n_tokens", *(["text"] if keep_text else [])]
    rows = rows.select("shard", "source", "cluster", *kept).repartition("shard")
    rows = rows.sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece", "source", "cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, Bins(capacity)
        for b in batches:
            ids, starts = [], []
            for shard, src, dup, size in zip(*(b.column(c).to_pylist() for c in ("shard", "source", "cluster", "n_tokens"))):
                if shard != now:
                    now, bins = shard, Bins(capacity)
                number, at = bins.place(size, src, dup)
                ids.append(shard << 24 | number)
                starts.append(at)
            columns = [pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), *(b.column(c) for c in kept)]
            yield pa.RecordBatch.from_arrays(columns, names=["bin_id", "bin_start", *kept])

    kinds = {c.split()[0]: c for c in PIECES.split(", ")}
    return rows.mapInArrow(run, ", ".join(["bin_id long, bin_start int", *(kinds[c] for c in kept)]))
