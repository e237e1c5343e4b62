"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit set where over half the 3-word shingles' hashes have it. Two fingerprints link at
``RADIUS`` or fewer differing bits. Of three differing bits at least one lies in one of four 16-bit
blocks; without that block at most two differ. So every distinct fingerprint emits, once per block, the
48 other bits with all variants within half that radius (none or one bit flipped). Two linked fingerprints
meet on a variant half way between them. Variants are shuffled, and each bucket's fingerprints are
verified on all 64 bits.

Copies share a fingerprint and are combined before anything is emitted. A bucket gives a spanning forest
of its verified links, so its output is linear in its size; it can hold no more fingerprints than 49 times
2^16. Links are lost only where another path joins the same fingerprints.

Null and empty texts and texts of white space have fingerprint zero and link like any other. Fewer than
three words are one shingle. Repeated rows are copies. Rows without ``doc_id`` take part, but never name a
component; a component of such rows alone is null. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import slices, whole, written
from opsframe.llm.graph import components

SEED, RADIUS, WORDS, BLOCKS = 42, 3, 3, 4
ALL = (1 << 64) - 1


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the UTF-8 ``text``."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    ends = [words[i:] for i in range(WORDS)] if len(words) >= WORDS else [[b" ".join(words)]]
    shingles, total, counts = map(b" ".join, zip(*ends)), max(1, len(words) - WORDS + 1), np.zeros(64, np.int64)
    for start in range(0, total, 1 << 16):
        n = min(1 << 16, total - start)
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s, _ in zip(shingles, range(n))), np.uint64, n)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Hash that rows share only if id and text agree."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row_key`` and ``fp`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "row_key", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), whole("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, row_key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(distinct: DataFrame) -> DataFrame:
    """``key`` and ``fp``: every variant of every distinct fingerprint."""
    width = 64 // BLOCKS
    pairs = []
    for block in range(BLOCKS):
        hole = ((1 << width) - 1) << (width * block)
        tag = (block + 1) << (width * block)  # in the block left out: tells the blocks' keys apart
        flips = [0] + [1 << i for i in range(64) if not hole >> i & 1]
        pairs += [(_signed(ALL ^ hole), _signed(flip ^ tag)) for flip in flips]
    masks = F.array(*[F.struct(F.lit(k).alias("keep"), F.lit(x).alias("flip")) for k, x in pairs])
    out = distinct.select("fp", F.explode(masks).alias("m"))
    return out.select(F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip")).alias("key"), "fp")


def _bits(x: np.ndarray) -> np.ndarray:
    """Set bits of longs; of signed numbers numpy would count those of the absolute value."""
    return np.bitwise_count(x.view(np.uint64))


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Verified links that join the same fingerprints as all verified links do."""
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _bits(rest ^ x) <= radius
            if near.any():
                found = rest[near].tolist()
                out += [(int(x), f) for f in found]
                queue += [np.int64(f) for f in found]
                rest = rest[~near]
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of one partition, whose rows come sorted by key."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        two = two[_bits(fp[two] ^ fp[two + 1]) <= RADIUS]
        a, b = [fp[two]], [fp[two + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            if got := spanning_links(fp[s:s + n]):
                x, y = np.array(got, np.int64).T
                a.append(x)
                b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        key = np.r_[key, batch.column(0).to_numpy()]
        fp = np.r_[fp, batch.column(1).to_numpy()]
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
        if cut:
            yield links(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield links(key, fp)


def links(distinct: DataFrame) -> DataFrame:
    """Distinct links ``a < b`` between distinct fingerprints that join all linked ones."""
    keyed = variants(distinct)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, fp, root, component_id`` of every row; ``root`` tells components apart too."""
    fps = written(fingerprints(docs))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = written(distinct.join(roots, "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = written(rooted.join(smallest, "root").select("fp", "root", "component_id"))
    return fps.join(classes, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` from each component, with all its columns.

    It is the one with the smallest ``doc_id`` (null last), of equal ids the one with the smallest hash of
    id and text, of rows that agree in both any one.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    first = near_duplicates(docs).groupBy("root").agg(F.min(order).alias("f"))
    kept = first.select(F.coalesce("f.doc_id", F.lit(0)).alias("_kept_id"), F.col("f.row_key").alias("_kept_key"))
    rows = docs.select(
        F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_kept_id"), row_key().alias("_kept_key"))
    return rows.join(kept, ["_kept_id", "_kept_key"]).dropDuplicates(["_kept_id", "_kept_key"]).select("_row.*")


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
