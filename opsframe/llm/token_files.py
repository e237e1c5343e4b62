"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

``write_tokens`` range-partitions documents by ``doc_id``, encodes each partition where it lies and
writes one ORC file per partition, rows in ascending ``doc_id`` (null first, equal ids by text). ORC
stores ids with run-length encoding, keeps minimum and maximum of ``doc_id`` per stripe and row group,
and a Bloom filter per row group, so a lookup reads few row groups and stripes are read in parallel.

Null and empty texts hold the end id alone. Repeated rows are written as often as they occur. An empty
table gives a folder without rows. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsframe.llm.common import slices, whole, written

SCHEMA = "doc_id long, pos long, ids array<int>"
PUNCTUATION = string.punctuation
SIGNS = r"[!-/:-@\[-`{-~]"
WHITE = str.maketrans("\n\t\r", "   ")
#: New words that are encoded together.
TOGETHER = 50
#: Texts, and about as many characters, whose new chunks are encoded at once.
TEXTS, CHARS = 1000, 4 << 20


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit integers.

    The vocabulary lower-cases, drops white space and no token spans it, so a text's ids are those of its
    lower-cased chunks between blanks; ASCII punctuation at a chunk's end is encoded by itself after a character
    that the tokenizer's normaliser turns into text that ends with a letter. These properties are tested when a
    vocabulary is loaded; one without them encodes whole texts. Texts whose case matters (special tokens, final
    sigma, dotted I) are not lower-cased here. Punctuation after a letter from a to z at a chunk's end is made a chunk of its own first.
    The distinct chunks of a batch are told by Arrow; each is looked up once and its ids are dealt to its places. Beyond ``limit`` bytes the store becomes
    the older generation: chunks in use move on, the others are forgotten at the next turn.
    """

    def __init__(self, path: str, limit: int = 160 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.known, self.older, self.size = {"": b""}, {}, 0
        self.parts: dict[str, bool] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.chunked = self._splits()
        self.ends_apart = self.chunked and all(map(self._parts_before, string.ascii_lowercase))

    def _splits(self) -> bool:
        """Whether the vocabulary has the properties that chunks rest on."""
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        runs = [*PUNCTUATION, *(a + b for a in PUNCTUATION for b in PUNCTUATION)]
        return (
            all(whole("ab" + p) == whole("ab") + whole(p) for p in runs)
            and all(whole(f"ab{w}{c}d") == whole("ab") + whole(f"{c}d") for w in (" ", "\n", "\t", "\r", "  ") for c in ("", "c", *PUNCTUATION))
            and whole("ABZ ÀÉ") == whole("abz àé"))

    def _parts_before(self, c: str) -> bool:
        """Whether punctuation after this character is encoded by itself."""
        if c not in self.parts:
            norm = self.tokenizer.normalizer.normalize_str(c) if self.tokenizer.normalizer else c
            self.parts[c] = bool(norm) and norm[-1].isalpha()
        return self.parts[c]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [pack(f"<{len(got.ids)}I", *got.ids) for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids by word. Words of letters are encoded together and parted at the tokens that end a word; if their number differs, one by one."""
        out: dict[str, bytes] = {}
        letters = [w for w in words if w.isalpha()]
        groups = [letters[i:i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        alone = [w for w in words if not w.isalpha()]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            cuts = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(cuts) == len(group):
                out.update(zip(group, map(ids.tobytes().__getitem__, map(slice, [0, *cuts], cuts))))
            else:
                alone += group
        out.update(zip(alone, self._each(alone)))
        return out

    def _learn(self, chunks: set[str]) -> None:
        known, older, parts = self.known, self.older, self._parts_before
        known.update((c, older[c]) for c in chunks if c in older)
        words, ends = set(), []
        for c in chunks:
            if c in known:
                continue
            bare = c.rstrip(PUNCTUATION) if c[-1] in PUNCTUATION else c
            if bare and bare != c and "<|" not in c and parts(bare[-1]):
                ends.append((c, bare, c[len(bare):]))
                words.add(bare)
                words.add(c[len(bare):])
            else:
                words.add(c)
        known.update((w, older[w]) for w in words if w in older)
        words = [w for w in words if w not in known]
        known.update(self._ids(words))
        known.update((c, known[bare] + known[tail]) for c, bare, tail in ends)
        self.size += 200 * (len(chunks) + len(words)) + 5 * sum(map(len, chunks))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; all that is new in about ``CHARS`` characters is encoded at once."""
        if not self.chunked:
            return self._each(texts)
        out, part, chars = [], [], 0
        for text in texts:
            part.append(text)
            chars += len(text)
            if chars > CHARS:
                out += self._encode_part(part)
                part, chars = [], 0
        return out + self._encode_part(part) if part else out

    def _encode_part(self, texts: list[str]) -> list[bytes]:
        plain = ["<|" not in text for text in texts]
        lowered = [text.lower() if p and not ("\u03a3" in text or "\u0130" in text) else text for text, p in zip(texts, plain)]
        rows = pa.array([text.translate(WHITE) if "\t" in text or "\r" in text else text.replace("\n", " ") for text in lowered], pa.large_string())
        if self.ends_apart:
            apart = pc.replace_substring_regex(rows, f"([a-z])({SIGNS}+)( |$)", r"\1 \2\3")
            rows = apart if all(plain) else pc.if_else(pa.array(plain), apart, rows)
        split = pc.split_pattern(rows, " ")
        found = split.values.dictionary_encode()
        chunks = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.size > self.limit:
            self.known, self.older, self.size = {"": b""}, self.known, 0
        new = set(chunks).difference(self.known)
        if new:
            self._learn(new)
        dealt = pa.array(map(self.known.__getitem__, chunks), pa.large_binary()).take(found.indices)
        ends, packed = (np.frombuffer(x, kind) if x else np.empty(0, kind) for x, kind in zip(dealt.buffers()[1:], ("<i8", "u1")))
        cuts = ends[split.offsets.to_numpy()].tolist()
        packed = packed.tobytes()
        return [packed[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def _id_lists(parts: list[bytes]) -> pa.Array:
    values = np.frombuffer(b"".join(parts), "<i4")
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode_rows(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """``doc_id``, ``pos`` (row number in its partition) and ``ids``, rows and order as given."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pos = _encoder(tokenizer), 0
        for b in slices(batches, TEXTS):
            parts = [ids + end for ids in encoder.encode_all(b.column(1).to_pylist())]
            numbers = pa.array(np.arange(pos, pos + len(parts)))
            pos += len(parts)
            yield pa.RecordBatch.from_arrays([b.column(0), numbers, _id_lists(parts)], names=["doc_id", "pos", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, row_group: int = 1024) -> None:
    """Encode ``docs`` and write them to ORC files at ``path`` in ascending ``doc_id`` order."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        encode_rows(ordered, tokenizer, end_id).write.mode("overwrite").option("compression", "zstd")
        .option("orc.create.index", "true").option("orc.row.index.stride", str(row_group))
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files with their file number; ``doc_ids`` prunes stripes and row groups."""
    df = spark.read.schema(SCHEMA).orc(path)
    if doc_ids is not None:
        df = df.where(F.col("doc_id").isin([int(x) for x in doc_ids]))
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return df.select(number.alias("file"), "doc_id", "pos", "ids")


def token_digest(tokens: DataFrame) -> DataFrame:
    """Per document of ``read_tokens``: place of its first id among all ids, number of ids, crc32.

    Offsets add totals of whole files to sums within one file, so no window spans the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["file", "doc_id", "pos", "n_tokens", "ids_crc32"],
            )

    rows = written(tokens.mapInArrow(run, "file long, doc_id long, pos long, n_tokens long, ids_crc32 long"))  # the ids are read once
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("file", F.coalesce(before, F.lit(0)).alias("file_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    inside = rows.withColumn("within", F.coalesce(within, F.lit(0)))
    return inside.join(offsets, "file").select(
        "doc_id", (F.col("file_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
