"""Exact quantiles whose memory per task stays bounded.

``percentile`` keeps every distinct value in one buffer. Here every wanted rank is bracketed instead:
each pass takes approximate quantiles inside the open brackets of all columns and counts the rows below
them, with no shuffle of the data, until a bracket holds few rows and an exact pick is cheap. The method
is the same at every size; a table below the limit has its first bracket small enough.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRACKET_ROWS = 10_000


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], bracket_rows: int = BRACKET_ROWS
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column; NaN and null are left out."""
    if not cols:
        return {}
    d = df.select(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    head = d.agg(
        *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(cols))],
        *[F.min(f"c{i}").alias(f"lo{i}") for i in range(len(cols))],
        *[F.max(f"c{i}").alias(f"hi{i}") for i in range(len(cols))],
    ).first()
    brackets: dict[tuple[int, int], tuple[float, float, int, int]] = {}  # (column, rank): low, high, rows below low, rows inside
    for i in range(len(cols)):
        n = head[f"n{i}"]
        for p in probs if n else ():
            for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                brackets[i, k] = (head[f"lo{i}"], head[f"hi{i}"], 0, n)
    found = _order_statistics(d, brackets, bracket_rows)

    def value(i: int, p: float) -> float | None:
        n = head[f"n{i}"]
        if not n:
            return None
        pos = p * (n - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        return found[i, lo] if lo == hi else (hi - pos) * found[i, lo] + (pos - lo) * found[i, hi]

    return {c: [value(i, p) for p in probs] for i, c in enumerate(cols)}


def _inside(i: int, a: float, b: float):
    return F.when(F.col(f"c{i}").between(a, b), F.col(f"c{i}"))


def _middle(a: float, b: float) -> list[float]:
    m = max(a, -1.7e308) / 2 + min(b, 1.7e308) / 2
    return [m] if a <= m <= b else []


def _order_statistics(d: DataFrame, brackets: dict, limit: int) -> dict[tuple[int, int], float]:
    """0-based order statistics of all columns; two scans a pass, whatever the number of columns."""
    done: dict[tuple[int, int], float] = {}
    while True:
        for key, (a, b, _, _) in list(brackets.items()):
            if a == b:
                done[key] = a
                del brackets[key]
        open_ = {key: v for key, v in brackets.items() if v[3] > limit}
        if not open_:
            break
        aggs, names = [], {key: f"m{j}" for j, key in enumerate(open_)}
        for (i, k), (a, b, below, inside) in open_.items():
            mid = (k - below + 0.5) / inside
            probs = [max(0.0, mid - 0.002), max(0.0, mid - 0.0005), mid, min(1.0, mid + 0.0005), min(1.0, mid + 0.002)]
            aggs.append(F.percentile_approx(_inside(i, a, b), probs, 10000).alias(names[i, k]))
        approx = d.agg(*aggs).first()
        # halving the bracket as well makes every pass shrink it
        marks = {key: sorted({v[0], *approx[names[key]], *_middle(v[0], v[1]), v[1]}) for key, v in open_.items()}
        points = sorted({(i, m) for (i, _), ms in marks.items() for m in ms})
        row = d.agg(*[x for j, (i, m) in enumerate(points) for x in (F.count_if(F.col(f"c{i}") < m).alias(f"l{j}"), F.count_if(F.col(f"c{i}") <= m).alias(f"e{j}"))]).first()
        counts = {point: (row[f"l{j}"], row[f"e{j}"]) for j, point in enumerate(points)}
        for (i, k), ms in marks.items():
            for j, m in enumerate(ms):
                less, upto = counts[i, m]
                if less <= k < upto:
                    done[i, k] = m
                    del brackets[i, k]
                    break
                if k < less:
                    below = counts[i, ms[j - 1]][1]
                    brackets[i, k] = (math.nextafter(ms[j - 1], math.inf), math.nextafter(m, -math.inf), below, less - below)
                    break
    if brackets:
        keys = list(brackets)
        picks = d.agg(*[
            F.expr(f"percentile_disc({(k - brackets[i, k][2] + 0.5) / brackets[i, k][3]!r}) within group (order by "
                   f"case when c{i} between double('{brackets[i, k][0]!r}') and double('{brackets[i, k][1]!r}') then c{i} end)").alias(f"p{j}")
            for j, (i, k) in enumerate(keys)
        ]).first()
        done.update({key: picks[f"p{j}"] for j, key in enumerate(keys)})
    return done
