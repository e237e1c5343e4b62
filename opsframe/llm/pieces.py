"""SentencePiece BPE encoding and decoding by suffix-array matching.

No piece spans a blank that follows another character or a line end, so a text is made of units that are
encoded apart. Units also end between ASCII punctuation and characters that no piece of the model holds beside it,
as nothing is merged there. The units of a batch that are not known yet are concatenated, ``CODES`` characters at a time,
and indexed by a suffix array (sorted to the length of the longest piece). Every piece's occurrences are a
range of it, found by binary search in the range of the piece's own prefix; the occurrences are edges. Sorted
by position, they are relaxed: a prefix of a unit takes the one edge ending there whose piece may follow the
piece that the prefix before it ends with. Two pieces may stand side by side if merging their characters by
score gives just these two; that is what makes the relaxed path the one that merging the whole unit would
give. It is told by undoing the merges at their border, the latest first, and asking whether the parts there
would have merged before. Units with several leading blanks hold pieces of equal score and are merged
directly. Characters without a piece become their bytes' pieces. Beyond ``limit`` units the store becomes the
older generation: units in use move on, the others are forgotten at the next turn.

Null and empty texts have no ids. Decoding gives the text back; U+2581, which stands for a blank in the
pieces, comes back as a blank. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import slices, whole

BLANK = "▁"
SIGNS = re.escape(string.punctuation)
#: Characters of new units that are indexed at once.
CODES = 200_000


def unit_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Units end at blanks and line ends, and between ASCII punctuation and characters that no piece holds beside it."""
    beside = {c for p in pieces for pair in zip(p, p[1:]) for c in pair if any(x in string.punctuation for x in pair)}
    beside = re.escape("".join(sorted(beside.difference(string.punctuation, BLANK))))
    run = f"(?:[^{BLANK}\n{SIGNS}{beside}]+|[{SIGNS}]+)"
    if beside:
        run = f"(?:{run}(?:[{beside}]+{run}?)*|[{beside}]+(?:{run}[{beside}]+)*{run}?)"
    return re.compile(f"{BLANK}*{run}|{BLANK}+|\n")


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``codes`` sorted by their first ``depth`` codes or more."""
    rank, width = codes.astype(np.int64), 1
    while width < depth:
        after = np.zeros_like(rank)
        after[:-width] = rank[width:] + 1
        rank = np.unique(rank << 32 | after, return_inverse=True)[1]
        width *= 2
    return np.argsort(rank, kind="stable")


class Pieces:
    """Pieces of a BPE model with byte fallback, and the ids of the units seen so far."""

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n, self.limit = model.get_piece_size(), limit
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(names) if model.is_byte(i)}
        if len(self.byte) < 256 or model.encode(f"a{BLANK} b") != model.encode("a  b"):
            raise ValueError("a BPE model with byte fallback and no normalisation is needed")
        self.id = {p: i for i, p in enumerate(names) if not special[i] and not model.is_byte(i)}
        if any(re.search(f"[^{BLANK}]{BLANK}|\n", p) for p in self.id):
            raise ValueError("pieces span units")
        self.unit = unit_pattern(self.id)
        self.name, self.score = names, [model.get_score(i) for i in range(n)]
        known = set(self.id.values())
        self.raw = [p.replace(BLANK, " ").encode() if i in known else b"" for i, p in enumerate(names)]
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        self.raw = np.array([*self.raw, None], object)[:-1]
        order = sorted(self.id, key=lambda p: [ord(c) for c in p])
        self.depth = max(map(len, order))
        self.levels = self._levels(order)
        self.rank = {p: -self.score[i] for p, i in self.id.items()}
        alone = [r for p, r in self.rank.items() if BLANK * 2 not in p]
        self.distinct = len(set(alone)) == len(alone)
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _levels(self, order: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length, the pieces' prefixes of that length in order: place of the prefix before, last character, id or -1."""
        levels, places = [], {"": 0}
        for k in range(1, self.depth + 1):
            prefixes = list(dict.fromkeys(p[:k] for p in order if len(p) >= k))
            levels.append((np.array([places[p[:-1]] for p in prefixes]), np.array([ord(p[-1]) for p in prefixes]), np.array([self.id.get(p, -1) for p in prefixes])))
            places = {p: i for i, p in enumerate(prefixes)}
        return levels

    def merge(self, text: str, merged: list[tuple[str, str]] | None = None) -> list[str]:
        """Parts of ``text`` after merging the best-scored neighbours, the leftmost of equal ones first; the pairs go to ``merged``."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))

        def entry(i: int) -> tuple | None:
            j = after[i]
            both = parts[i] + parts[j] if 0 <= i and j < len(parts) else None
            return (-self.score[self.id[both]], i, j, both) if both in self.id else None

        heap = [e for i in range(len(parts) - 1) if (e := entry(i))]
        heapify(heap)
        while heap:
            _, i, j, both = heappop(heap)
            if parts[i] is None or after[i] != j or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != both:
                continue
            if merged is not None:
                merged.append((parts[i], parts[j]))
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (e := entry(k)):
                    heappush(heap, e)
        return [p for p in parts if p is not None]

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merge to ``piece`` last, if it is merged from its characters in the order of scores; else none."""
        if piece not in self.splits:
            merged: list[tuple[str, str]] = []
            whole, rank = self.merge(piece, merged) == [piece], self.rank
            ordered = whole and all(rank[x + y] > max(rank.get(x, -math.inf) if len(x) > 1 else -math.inf, rank[y] if len(y) > 1 else -math.inf) for x, y in merged)
            self.splits[piece] = merged[-1] if ordered and BLANK * 2 not in piece else None
        return self.splits[piece]

    def stand_apart(self, x: str, y: str) -> bool:
        """Whether merging the characters of both pieces gives just these two."""
        rank, split, both = self.rank, self.splits, (x, y)
        if not self.distinct or any(len(p) > 1 and self._split(p) is None for p in both):
            return self.merge(x + y) == list(both)
        limit, first = math.inf, False  # the merge undone last, and whether the border is before it
        while True:
            across = rank.get(x + y)
            if across is not None and (across < limit or first and across == limit):
                return False
            if len(x) == 1 and len(y) == 1:
                return True
            first = len(x) == 1 or len(y) > 1 and rank[x] <= rank[y]
            if first:
                limit, y = rank[y], (split.get(y) or self._split(y))[0]
            else:
                limit, x = rank[x], (split.get(x) or self._split(x))[1]

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self.stand_apart(self.name[a], self.name[b])
        return got

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of every occurrence of every piece, by end and then by start."""
        suffixes = suffix_array(codes, self.depth)
        padded = np.r_[codes, np.full(self.depth, -1, np.int64)]
        node, found = np.zeros(len(suffixes), np.int64), []  # the suffixes that begin with a prefix of a piece, and its place
        for k, (before, last, ids) in enumerate(self.levels):
            keys = node << 22 | padded[suffixes + k] + 1  # ascending, as both are sorted alike
            wanted = before << 22 | last + 1
            low = np.searchsorted(keys, wanted)
            count = np.searchsorted(keys, wanted, "right") - low
            node = np.repeat(np.arange(len(count)), count)
            suffixes = suffixes[np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
            piece = ids[node]
            found.append((suffixes[piece >= 0], np.full(int((piece >= 0).sum()), k + 1), piece[piece >= 0]))
            if not len(node):
                break
        start, size, piece = (np.concatenate(x) for x in zip(*found))
        end = start + size
        order = np.lexsort((start, end))
        return start[order], end[order], piece[order]

    def _learn(self, units: list[str]) -> None:
        """Ids of new units, matched together."""
        if len(self.pairs) > 300_000:
            self.pairs.clear()
        part, chars = [], 0
        for u in units:
            if u.startswith(BLANK * 2):
                self.units[u] = self._ids(self.merge(u))
            elif u in self.id:
                self.units[u] = pack("<i", self.id[u])
            else:
                part.append(u)
                chars += len(u) + 1
                if chars > CODES:
                    self._match(part)
                    part, chars = [], 0
        if part:
            self._match(part)

    def _match(self, units: list[str]) -> None:
        codes = np.frombuffer(("\n".join(units) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts, ends, ids = self._edges(codes)
        bounds = np.searchsorted(ends, np.arange(len(codes) + 2)).tolist()
        starts, ids = starts.tolist(), ids.tolist()
        known, may_follow, at = self.pairs.get, self.may_follow, 0
        for unit in units:
            n = len(unit)
            last_id, before = [-2] * (n + 1), list(range(-1, n))  # -2: a character without a piece
            low = bounds[at + 1]
            for k in range(1, n + 1):
                high = bounds[at + k + 1]
                for edge in range(low, high):
                    s, i = starts[edge] - at, ids[edge]
                    a = last_id[s]
                    ok = s == 0 or a == -2 or known(a << 20 | i)
                    if ok is None:
                        ok = may_follow(a, i)
                    if ok:
                        last_id[k], before[k] = i, s
                        break
                low = high
            out, k = [], n
            while k:
                if last_id[k] >= 0:
                    out.append(last_id[k])
                else:
                    out += [self.byte[b] for b in reversed(unit[k - 1].encode("utf-8", "surrogatepass"))]
                k = before[k]
            self.units[unit] = pack(f"<{len(out)}i", *out[::-1])
            at += n + 1

    def _ids(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for p in parts:
            out += [self.id[p]] if p in self.id else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return pack(f"<{len(out)}i", *out)

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.unit.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.units) > self.limit:
            self.units, self.older = {}, self.units
        units, older = self.units, self.older
        new = set().union(*split).difference(units)
        units.update((u, older[u]) for u in new if u in older)
        self._learn([u for u in new if u not in older])
        return [b"".join(map(units.__getitem__, x)) for x in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_packed(texts)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), [0, len(ids)])[0]

    def decode_all(self, ids: np.ndarray, bounds: list[int]) -> list[str]:
        """Texts of the ids between neighbouring ``bounds``."""
        parts = self.raw[ids].tolist()
        texts = [b"".join(parts[i:j]).decode("utf-8", "replace") for i, j in zip(bounds, bounds[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32()))


def encode(docs: DataFrame, model: str, rows: int = 400) -> DataFrame:
    """``doc_id`` and ``ids`` of every row; ``rows`` texts are matched at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in slices(batches, rows):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(pieces.encode_packed(b.column(1).to_pylist()))], names=["doc_id", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` and the decoded ``text``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in slices(batches):
            ids = b.column(1)
            ends = np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].tolist()
            texts = pieces.decode_all(ids.flatten().to_numpy(zero_copy_only=False), ends)
            texts = pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
