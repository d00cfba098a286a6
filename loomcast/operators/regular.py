"""Irregular readings onto a regular daily grid (problem 4).

Readings become daily means per source. A harmonic seasonal regression with trend is fitted to each source by distributed
normal equations (one aggregate of products), solved in blocks of sources, and predicts the missing days; the residuals at
the two readings that enclose a gap are bridged linearly, so the series meets the observations at both ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_DAYS = 365.2425
#: Ridge in units of the mean diagonal: keeps sources with few or repeated days solvable, and their prediction near the mean.
RIDGE = 1e-3


def _design(day: Column, first: Column, harmonics: int, period: float) -> list[Column]:
    angle = day * F.lit(2 * math.pi / period)
    return [F.lit(1.0), (day - first) / F.lit(period), *[f(angle * F.lit(float(k))) for k in range(1, harmonics + 1) for f in (F.sin, F.cos)]]


def daily_means(readings: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """``keys, day_no, n, y``: readings and mean value of each day; null values don't enter the mean (y null if none is left)."""
    return readings.groupBy(*keys, F.unix_date(F.col(day)).alias("day_no")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("y"))


def _terms(harmonics: int) -> list[tuple[int, int]]:
    size = 2 + 2 * harmonics
    return [(a, b) for a in range(size) for b in range(a, size)]


def normal_sums(daily: DataFrame, keys: Sequence[str], *, harmonics: int = 2, period: float = YEAR_DAYS) -> DataFrame:
    """``keys, first, last, days, s, v``: each source's span, its days in order, and the sums of its normal equations.

    ``s`` holds the sums of products of the design's terms (upper triangle, row by row), ``v`` those with the values; both are
    null for a source without values. ``days`` is an array of day_no, n, y, the days read before and after (prev, next), and
    day and mean of the last value up to the day and of the next one (p, q): a source has a row for each calendar day at most.
    """
    size, whole = 2 + 2 * harmonics, Window.partitionBy(*keys)
    known = F.when(F.col("y").isNotNull(), F.struct("day_no", "y"))
    onward, back = whole.orderBy("day_no"), whole.orderBy(F.desc("day_no"))
    rows = daily.withColumns({"q": F.last(known, True).over(back.rowsBetween(Window.unboundedPreceding, -1)), "next": F.lag("day_no").over(back)})
    rows = rows.withColumns({"p": F.last(known, True).over(onward.rowsBetween(Window.unboundedPreceding, 0)), "prev": F.lag("day_no").over(onward), "first": F.min("day_no").over(onward.rowsBetween(Window.unboundedPreceding, 0))})
    x = _design(F.col("day_no").cast("double"), F.col("first").cast("double"), harmonics, period)
    rows = rows.withColumns({f"__x{k}": c for k, c in enumerate(x)})
    used = F.col("y").isNotNull()
    sums = [F.sum(F.when(used, F.col(f"__x{a}") * F.col(f"__x{b}"))).alias(f"__s{a}_{b}") for a, b in _terms(harmonics)] + [F.sum(F.col(f"__x{a}") * F.col("y")).alias(f"__t{a}") for a in range(size)]
    day = F.struct("day_no", "n", "y", "prev", "next", "p", "q")
    out = rows.groupBy(*keys).agg(F.min("day_no").alias("first"), F.max("day_no").alias("last"), F.sort_array(F.collect_list(day)).alias("days"), *sums)
    return out.select(*keys, "first", "last", "days", F.array(*[f"__s{a}_{b}" for a, b in _terms(harmonics)]).alias("s"), F.array(*[f"__t{a}" for a in range(size)]).alias("v"))


def fit_harmonics(daily: DataFrame, keys: Sequence[str], *, harmonics: int = 2, period: float = YEAR_DAYS, ridge: float = RIDGE) -> DataFrame:
    """``keys, first, last, days, s, v, coef``: coefficients of 1, trend, and sine and cosine of each harmonic, for each source.

    The days have been reduced before; one shuffle brings each source's together. Only the p x p systems
    (p = 2 + 2 * harmonics) reach Python, a block of sources at a time. The intercept isn't penalised. A source without
    values gets null coefficients.
    """
    size, pair = 2 + 2 * harmonics, _terms(harmonics)
    packed = normal_sums(daily, keys, harmonics=harmonics, period=period)

    def solve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        up = np.array(pair)
        for s, v in batches:
            tri, rhs = np.array([*map(np.asarray, s)], float).reshape(-1, len(pair)), np.array([*map(np.asarray, v)], float).reshape(-1, size)
            known = np.isfinite(tri).all(1) & np.isfinite(rhs).all(1)
            out = pd.Series([None] * len(s), dtype=object)
            if known.any():
                a = np.zeros((int(known.sum()), size, size))
                a[:, up[:, 0], up[:, 1]] = tri[known]
                a[:, up[:, 1], up[:, 0]] = tri[known]
                weight = ridge * np.trace(a, axis1=1, axis2=2) / size
                a[:, range(1, size), range(1, size)] += weight[:, None]
                for k, c in zip(np.flatnonzero(known), np.linalg.solve(a, rhs[known][:, :, None])[:, :, 0]):
                    out[k] = c.tolist()
            yield out

    solver = F.pandas_udf(solve, "array<double>")
    return packed.withColumn("coef", solver("s", "v"))


def regular_series(readings: DataFrame, keys: Sequence[str], day: str, value: str, *, harmonics: int = 2, period: float = YEAR_DAYS) -> DataFrame:
    """One row for each source and calendar day between its first and last reading.

    Columns: ``keys, on_day, n_readings, value, filled, prev_day, next_day, observed, fitted``. On days with readings ``value`` is their
    mean and ``filled`` false; otherwise it is the regression's prediction plus the linearly bridged residual, and
    ``prev_day`` / ``next_day`` are the enclosing readings' days. Rows with a null key or day are left out. A day whose
    readings all lack a value counts as read, its ``value`` is filled and ``observed`` false; a source without any value has null values and a
    false ``fitted``.
    Repeated rows weigh in the mean as often as they lie. Empty input gives no rows.
    """
    good = readings.where(F.expr(" and ".join(f"`{c}` is not null" for c in [*keys, day])))
    fit = fit_harmonics(daily_means(good, keys, day, value), keys, harmonics=harmonics, period=period)
    first = F.col("first").cast("double")
    hat = lambda at: sum((F.get("coef", F.lit(k)) * x for k, x in enumerate(_design(at.cast("double"), first, harmonics, period)[1:], 1)), F.get("coef", F.lit(0)))
    left = lambda end: F.col(f"r.{end}.y") - hat(F.col(f"r.{end}.day_no"))
    reads = fit.select(*keys, "first", "coef", F.explode("days").alias("r")).withColumns({"rp": left("p"), "rq": left("q")})
    # each reading's day goes on up to the day before the next one
    days = reads.select("*", F.explode(F.sequence("r.day_no", F.coalesce(F.col("r.next") - 1, F.col("r.day_no")))).alias("day_no"))
    read, at = F.col("day_no") == F.col("r.day_no"), F.col("day_no").cast("double")
    share = (at - F.col("r.p.day_no")) / (F.col("r.q.day_no") - F.col("r.p.day_no"))
    bridge = F.coalesce(F.col("rp") + share * (F.col("rq") - F.col("rp")), F.col("rp"), F.col("rq"))
    y = F.when(read, F.col("r.y"))
    prev = F.when(read, F.col("r.prev")).otherwise(F.col("r.day_no"))
    return days.select(*keys, F.date_from_unix_date("day_no").alias("on_day"), F.when(read, F.col("r.n")).otherwise(0).alias("n_readings"), F.coalesce(y, hat(at) + bridge).alias("value"), (~read).alias("filled"), F.date_from_unix_date(prev).alias("prev_day"), F.date_from_unix_date("r.next").alias("next_day"), y.isNotNull().alias("observed"), F.col("coef").isNotNull().alias("fitted"))


def gaps(series: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame:
    """``keys, gap_first, gap_last, filled_mean``: maximal runs of at least ``at_least`` filled days between two readings.

    Every day of a gap must have been filled with a finite value, unless its source could not be fitted (then
    ``filled_mean`` is null); otherwise the query fails rather than report a gap that the series doesn't close.
    """
    open_day = F.col("fitted") & ~F.coalesce(F.abs("value") < float("inf"), F.lit(False))
    run = series.where("filled").groupBy(*keys, "prev_day").agg(F.min("on_day").alias("gap_first"), F.max("on_day").alias("gap_last"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("filled_mean"), F.max(open_day).alias("open"))
    closed = F.when(F.col("open"), F.raise_error(F.lit("a fitted series has a day without a finite value")).cast("boolean")).otherwise(True)
    return run.where((F.col("n") >= at_least) & closed).select(*keys, "gap_first", "gap_last", "filled_mean")
