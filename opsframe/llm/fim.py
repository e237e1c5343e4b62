"""Fill in the middle: one repeated-capture match of the whole text gives all unit ends.

A unit is a run of ASCII letters or one other code point. The ``regex`` library keeps every repetition of a
group, so one ``fullmatch`` of ``(unit)*`` gives the number of units and, as ``ends(1)``, every place where a
text may be cut; nothing walks over the text. Two cuts and the form are drawn from a SHA-256 of the seed and
the document's id, so a run, a retry and any partitioning give the same result.

Null texts count as empty. Empty texts, and texts that hold a marker, stay as they are (form ``plain``). A null
id draws as the empty string; rows that share an id share their draws. Repeated rows each get their result.
An empty table gives an empty result. Existing columns ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and
``output`` are replaced, others are kept. A text of any length is one match; memory is linear in its units.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import whole

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"
#: Texts turned into Python strings at a time.
STEP = 256


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def rearrange(doc_id: int | None, text: str, seed: int, percent: int, spm_percent: int) -> tuple:
    """Number of units, form, code points of prefix and middle, and the text in its new order."""
    ends = UNITS.fullmatch(text).ends(1)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return len(ends), "plain", None, None, text
    first, second = (ends[k - 1] if k else 0 for k in sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_percent:
        return len(ends), "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``docs`` with ``output`` in its ``form`` and the cuts; ``percent`` of the texts are rearranged, ``spm_percent`` of those suffix first."""

    @F.arrow_udf(f"struct<{FIELDS.replace(' ', ':')}>".replace(",:", ","))
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        parts = []
        for at in range(0, len(texts), STEP):
            rows = [rearrange(i, t, seed, percent, spm_percent) for i, t in zip(ids[at:at + STEP].to_pylist(), texts[at:at + STEP].to_pylist())]
            parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    done = run(F.col("doc_id").cast("long"), whole("text"))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.select(*kept, done.alias("_fim")).select(*kept, *(F.col("_fim")[c].alias(c) for c in names))


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text before it was rearranged; markers occur in it nowhere else, so they part it."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    in_order = lambda *k: F.concat(*(F.get(part, F.lit(i)) for i in k))
    return F.when(form == "psm", in_order(1, 3, 2)).when(form == "spm", in_order(2, 3, 1)).otherwise(output)


def digest(done: DataFrame) -> DataFrame:
    """Cuts and SHA-256 of the output and of the text rebuilt from it."""
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"))
