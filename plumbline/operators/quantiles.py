"""Exact quantiles that never hold a whole group in one task.

Values are first counted, then placed in value buckets.  A small histogram
says which buckets hold the wanted ranks; these are cut into cells between their
own least and greatest value, and a second histogram says which cells hold the
ranks.  Only those are ordered: a millionth of what a bucket spans.  More cuts
(``REFINEMENTS``) part values that lie closer together still, at one more pass each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two monotone bucket numbers; together they split both narrow ranges far from
# zero and long tails.
_LOG_BUCKET = ("CASE WHEN _v = 0 THEN 0 ELSE CAST(signum(_v) * (floor(ln(least(abs(_v), 1e300D))"
               " * 64) + 100000) AS BIGINT) END AS _b1")
_LINEAR_BUCKET = ("CAST(CASE WHEN abs(_lo) < 1e300D AND abs(_hi) < 1e300D AND _hi > _lo"
                  " THEN floor(try_divide(_v - _lo, _hi - _lo) * 4096) ELSE 0 END AS BIGINT) AS _b2")
# How often, and into how many cells, the buckets that hold a rank are cut.
REFINEMENTS, CELLS = 1, 1 << 20


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quantiles(df: DataFrame, value: str | Column, probs: Sequence[float],
              by: Sequence[str] = (), freq: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles per group as columns ``q0, q1, ...``
    beside the count ``n``.  Nulls and NaNs are left out."""
    by = list(by)
    keys = [_q(k) for k in by]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    # Missing values weigh nothing instead of being filtered: a filter would be
    # pushed into whatever computes the value and evaluate it twice.
    weight = _q(freq) if freq else "1"
    vc = (df.select(*by, F.nanvl(v, F.lit(None).cast("double")).alias("_v"),
                    *([freq] if freq else []))
          .groupBy(*by, "_v").agg(F.expr(
              f"sum(CAST(CASE WHEN _v IS NOT NULL THEN {weight} ELSE 0 END AS BIGINT)) AS _n")))

    def matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
        tagged = right.selectExpr(*[f"{_q(k)} AS {_q('_k_' + k)}" for k in on],
                                  *[c for c in right.columns if c not in on])
        test = " AND ".join(f"{_q(k)} <=> {_q('_k_' + k)}" for k in on)
        return left.join(tagged, F.expr(test)).drop(*["_k_" + k for k in on])

    if by:
        ends = vc.groupBy(*by).agg(F.expr("min(_v) AS _lo"), F.expr("max(_v) AS _hi"))
        ranged = matched(vc, ends, by)
    else:
        span = vc.agg(F.expr("struct(min(_v) AS lo, max(_v) AS hi)")).scalar()
        ranged = vc.select("*", span["lo"].alias("_lo"), span["hi"].alias("_hi"))
    placed = ranged.selectExpr(*keys, "_v", "_n", _LOG_BUCKET, _LINEAR_BUCKET)

    ranks = [(f"_{i}{side}", f"CAST({fn}({float(p)!r}D * (_total - 1)) AS BIGINT)")
             for i, p in enumerate(probs) for side, fn in (("l", "floor"), ("h", "ceil"))]
    holds = " OR ".join(f"({r} >= _start AND {r} < _start + _bn)" for _, r in ranks)
    sums = [F.expr("sum(_n) AS _bn"), F.expr("min(_v) AS _lo"), F.expr("max(_v) AS _hi")]

    # One row per bucket and group: small whatever the data size.
    part = "PARTITION BY " + ", ".join(keys or ["1"])
    hist = (placed.groupBy(*by, "_b1", "_b2").agg(*sums)
            .selectExpr("*", f"sum(_bn) OVER ({part} ORDER BY _b1, _b2 ROWS BETWEEN UNBOUNDED "
                        "PRECEDING AND CURRENT ROW) - _bn AS _start",
                        f"sum(_bn) OVER ({part}) AS _total"))
    cell, found = ["_b1", "_b2"], ["_lo", "_hi", "_start", "_total"]
    near = matched(placed, hist.filter(holds).select(*by, *cell, *found), [*by, *cell])
    for level in range(REFINEMENTS):
        own = f"_c{level}"
        cut = near.selectExpr(
            *keys, *cell, "_v", "_n", "_start AS _before", "_total",
            "CAST(CASE WHEN abs(_lo) < 1e300D AND abs(_hi) < 1e300D AND _hi > _lo THEN "
            f"floor(try_divide(_v - _lo, _hi - _lo) * {CELLS - 1}) ELSE 0 END AS BIGINT) AS {own}")
        inside = ", ".join([*keys, *cell])
        hist = (cut.groupBy(*by, *cell, own).agg(
                    *sums, F.expr("max(_before) AS _before"), F.expr("max(_total) AS _total"))
                .selectExpr("*", f"_before + sum(_bn) OVER (PARTITION BY {inside} ORDER BY {own} ROWS "
                            "BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - _bn AS _start"))
        cell.append(own)
        near = matched(cut.select(*by, *cell, "_v", "_n"),
                       hist.filter(holds).select(*by, *cell, *found), [*by, *cell])
    near = near.selectExpr(
        *keys, "_v", "_n", "_total",
        f"_start + sum(_n) OVER (PARTITION BY {', '.join([*keys, *cell])} ORDER BY _v ROWS BETWEEN "
        "UNBOUNDED PRECEDING AND CURRENT ROW) AS _to")
    picked = near.groupBy(*by).agg(
        F.expr("max(_total) AS n"),
        *[F.expr(f"max(CASE WHEN _to - _n <= {r} AND {r} < _to THEN _v END) AS {name}")
          for name, r in ranks])
    return picked.selectExpr(
        *keys, *[f"_{i}l + (_{i}h - _{i}l) * ({float(p)!r}D * (n - 1) - floor({float(p)!r}D * (n - 1)))"
                 f" AS q{i}" for i, p in enumerate(probs)], "n")


def median(df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Exact median per group, as column ``median``."""
    out = quantiles(df, value, [0.5], by)
    return out.select(*by, F.col("q0").alias("median"), "n")
