"""Small functions shared by all jobs, as Column expressions."""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsframe.functions import intervals

# Severity orders, most severe first.
LOG_SEVERITY_RANK = {
    "emergency": 0, "alert": 1, "critical": 2, "error": 3,
    "warning": 4, "notice": 5, "info": 6, "debug": 7, "unknown": 8,
}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
EVENT_SEVERITY_RANK = {**SEVERITY_RANK, "unknown": 5}
SEVERITIES = tuple(SEVERITY_RANK)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, table: Mapping[Any, Any], default: Any = None) -> Column:
    """Value of ``c`` in a literal map, else ``default``."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.element_at(F.create_map(*pairs), col(c))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def severity_rank(c: Column | str, vocab: Mapping[str, int] = SEVERITY_RANK) -> Column:
    """Rank in a severity vocabulary; unknown words sort last."""
    return lookup(c, vocab, len(vocab))


def severity_name(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in SEVERITY_RANK.items()})


def digest_id(prefix: str, n: int, *parts: Column | str, algo: str = "sha1", null_text: str = "") -> Column:
    """``prefix-`` plus the first ``n`` hex digits over the ``|``-joined parts."""
    joined = F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit(null_text)) for p in parts])
    digest = F.sha1(joined) if algo == "sha1" else F.sha2(joined, 256)
    return F.concat(F.lit(f"{prefix}-"), F.substring(digest, 1, n))


def set_digest(c: Column | str) -> Column:
    """Order-free digest of a group of texts as a mergeable sum (never collects the group)."""
    part = F.conv(F.substring(F.sha1(col(c).cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.sum(part).cast("decimal(38,0)")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def opt(c: Column | str) -> Column:
    """Trimmed text; empty becomes null."""
    return F.nullif(strip(col(c).cast("string")), F.lit(""))


def grab(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex group or null (``regexp_extract`` gives an empty text for no match)."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def parse_iso(c: Column | str) -> Column:
    """Tolerant ISO time parse; anything else is null."""
    text = F.regexp_replace(strip(col(c)), "Z$", "+00:00")
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$"), text))


def humanize(c: Column | str) -> Column:
    """``YYYY-MM-DD HH:MM UTC`` display of an ISO text; unparsed text passes through."""
    return F.coalesce(F.date_format(parse_iso(c), "yyyy-MM-dd HH:mm 'UTC'"), col(c))


def snake(c: Column | str) -> Column:
    """Lower-case name token: runs of other characters become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def vlan_sort_key(c: Column | str) -> Column:
    """Sort key putting numeric ids first in numeric order, then words."""
    numeric = col(c).rlike("^[0-9]+$")
    digits = F.regexp_replace(col(c), "^0+(?=.)", "")
    return F.struct(
        F.when(numeric, 0).otherwise(1).alias("kind"),
        F.when(numeric, F.length(digits)).otherwise(0).alias("size"),
        F.when(numeric, digits).otherwise(col(c)).alias("key"),
    )


def sort_vlans(arr: Column) -> Column:
    """Array of ids in numeric-aware order."""
    keyed = F.transform(arr, lambda v: F.struct(vlan_sort_key(v).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def expand_list(c: Column | str) -> Column:
    """``1,10-12,ALL`` to ``["1","10","11","12","ALL"]`` in the order given; a range that runs backwards gives nothing, words stay."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda p: F.trim(p))

    def one(p: Column) -> Column:
        first, last = (grab(p, r"^(\d{1,18})-(\d{1,18})$", g).try_cast("long") for g in (1, 2))
        ids = F.transform(F.sequence(first, last), lambda v: v.cast("string"))
        none = F.array().cast("array<string>")
        return F.when(first <= last, ids).when(first > last, none).otherwise(F.array(p))

    return F.flatten(F.transform(F.filter(parts, lambda p: p != ""), one))


def expand_ranges(c: Column | str) -> Column:
    """``1,10-12`` to ``[1,10,11,12]`` (distinct, ascending); malformed parts are skipped. ``intervals.parse`` keeps wide ranges as they are."""
    return intervals.ids(intervals.parse(col(c)))


def as_text(c: Column | str, is_array: bool = False) -> Column:
    """Comparable text of a value; arrays join with ``;`` and null members print as ``None``."""
    return F.array_join(col(c), ";", "None") if is_array else col(c).cast("string")


def num(c: Column | str) -> Column:
    """Number or null."""
    return col(c).try_cast("double")


def nan_to_null(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def pick(pairs: Sequence[tuple[Column, Any]], otherwise: Any = None) -> Column:
    """Ordered conditions to values, first match wins."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def once(df, **cols: Column):
    """Add columns that are computed exactly once per row.

    A filter on a plain derived column is pushed below the projection and repeats
    the whole expression; rows generated from a one-element array stop that.
    """
    packed = F.explode(F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))).alias("_once")
    out = df.select("*", packed)
    return out.select(*[c for c in df.columns if c not in cols], *[F.col(f"_once.{n}").alias(n) for n in cols])
