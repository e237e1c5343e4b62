"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (``email ip card phone``) need no context: a match that passes its validator counts. Further
kinds (``iban national_id local_phone``) start from a pattern score, gain by a passed checksum and by
context words within ``WINDOW`` code points, lose by contrary words, and count from ``min_score``; they
never replace or overlap a base span. Positions are code points, ends exclusive.

Null and empty texts have no spans. Repeated rows each get their spans. Every scan is linear in the
text, whatever it holds. ``redact`` keeps all columns; ``find`` returns ``doc_id`` and the spans only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.llm.common import slices, whole

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "national_id", "local_phone"]
WINDOW = 48
MIN_SCORE = 0.7

# A match can begin only at the first digit of a run, so later digits of the run are never tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN_GROUP = re.compile(r" ?[A-Z0-9]+")
#: Characters by country; of several valid ends the one of this length is taken.
IBAN_SIZE = {k: int(n) for n, ks in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,TL,SO 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for k in ks.split(",")}
NATIONAL = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")

PATTERN_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.7, "iban": 0.5, "national_id": 0.4, "local_phone": 0.4}
CHECKSUM_GAIN, CONTEXT_GAIN, CONTEXT_LOSS = 0.4, 0.35, 0.3
CONTEXT = {
    "email": r"e-?mail|contact|write", "ip": r"ip|address|host|server", "card": r"card|visa|mastercard|payment|credit|debit",
    "phone": r"phone|tel|call|mobile|fax", "iban": r"iban|account|bank|konto|compte|cuenta",
    "national_id": r"ssn|social security|national id|tax id", "local_phone": r"phone|tel|call|mobile|cell|fax",
}
CONTRARY = re.compile(r"(?i)\b(?:order|invoice|version|serial|isbn|part|model)\b")
CONTEXT_RE = {k: re.compile(rf"(?i)\b(?:{v})\b") for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064: the first four characters move to the end, letters count as 10 to 35."""
    rest = 0
    for c in code[4:] + code[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Every group end of 15 to 34 characters after a start is tried; failed starts take nothing with them."""
    done = 0
    for m in IBAN.finditer(text):
        start, at, code, ends = m.start(), m.end(), m[0], []
        if start < done:
            continue
        while len(code) <= 34:
            if len(code) >= 15 and not (at < len(text) and text[at].isascii() and text[at].isalnum()) and mod97(code):
                ends.append((len(code) != IBAN_SIZE.get(code[:2]), at))
            group = IBAN_GROUP.match(text, at, at + 32)
            if not group:
                break
            at, code = group.end(), code + group[0].strip()
        if ends:
            done = min(ends)[1]
            yield start, done


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed base spans by kind, then start."""
    out = [("email", i, j) for i, j in _emails(text)]
    for m in IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _context(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - WINDOW):start]} {text[end:end + WINDOW // 2]}"
    return CONTEXT_GAIN * bool(CONTEXT_RE[kind].search(near)) - CONTEXT_LOSS * bool(CONTRARY.search(near))


def added_spans(text: str, base: list[tuple[str, int, int]], min_score: float) -> list[tuple[str, int, int, float]]:
    found = [("iban", i, j, CHECKSUM_GAIN) for i, j in _ibans(text)]
    for m in NATIONAL.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            found.append(("national_id", m.start(), m.end(), 0.0))
    for m in LOCAL_PHONE.finditer(text):
        found.append(("local_phone", m.start(), m.end(), 0.0))
    out = []
    for kind, i, j, gain in found:
        score = PATTERN_SCORE[kind] + gain + _context(kind, text, i, j)
        if score >= min_score and not any(a < j and i < b for _, a, b in base):
            out.append((kind, i, j, min(1.0, round(score, 3))))
    return out


def find_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """All spans with scores: base kinds first, then added kinds, each by kind and start."""
    base = base_spans(text)
    scored = [
        (k, i, j, max(0.0, min(1.0, round(PATTERN_SCORE[k] + CHECKSUM_GAIN * (k == "card") + _context(k, text, i, j), 3))))
        for k, i, j in base
    ]
    return scored + added_spans(text, base, min_score)


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def find(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in slices(batches):
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t, min_score)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of base kinds, SHA-256 of the base spans and all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    joined = lambda spans: F.concat_ws(",", F.transform(spans, line))
    spans = F.col("spans")
    number = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in BASE]
    base = F.filter(spans, lambda s: s["kind"].isin(BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def mask(text: str, min_score: float = MIN_SCORE) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, i, j, _ in sorted(find_spans(text, min_score), key=lambda s: (s[1], -s[2])):
        if j <= at:
            continue
        out += [text[at:max(i, at)], f"[{kind.upper()}]" if i >= at else ""]
        at = j
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with masked ``text`` and, where present, ``n_chars`` of the new text; null stays null."""

    @F.pandas_udf(T.StringType())
    def masked(texts):
        return texts.map(lambda t: None if t is None else mask(t, min_score))

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

