"""Likelihoods and forecast scores as single aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.functions import stats


def logpmf(y: Column, mean: Column, family: str = "poisson", dispersion: float | None = None) -> Column:
    if family == "poisson":
        return stats.poisson_logpmf(y, mean)
    if family != "negbin":
        raise ValueError("family must be 'poisson' or 'negbin'")
    if dispersion is None:
        raise ValueError("dispersion is required for 'negbin'")
    return stats.negbin_logpmf(y, mean, dispersion)


def loglik(rows: DataFrame, family: str = "poisson", dispersion: float | None = None, *, y: str = "y", lam: str = "lam") -> DataFrame:
    """One row, ``loglik``."""
    return rows.agg(F.sum(logpmf(F.col(y), F.col(lam), family, dispersion)).alias("loglik"))


def observed_loglik_exact(rows: DataFrame, p: float, false_rate: float) -> DataFrame:
    """One row, ``loglik`` of ``y_true, y_obs``: pairs are counted first, so that the inner sum runs once for each distinct pair."""
    pairs = rows.groupBy("y_true", "y_obs").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.sum(F.col("n") * stats.observed_logpmf(F.col("y_true"), F.col("y_obs"), p, false_rate)).alias("loglik"))


def observed_mean(lam: Column, p: float, false_rate: float) -> Column:
    return F.lit(float(p)) * lam + F.lit(float(false_rate))


def mean_nll(rows: DataFrame, family: str = "poisson", dispersion: float | None = None) -> DataFrame:
    return rows.agg(F.avg(-logpmf(F.col("y"), F.col("lam"), family, dispersion)).alias("mean_nll"))


def errors(rows: DataFrame) -> DataFrame:
    """One row, ``rmse, mae`` of ``y`` and ``lam``."""
    d = F.col("y") - F.col("lam")
    return rows.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def coverage(rows: DataFrame) -> DataFrame:
    """One row, ``coverage``: the share of ``y`` within ``lo..hi``, ends included."""
    return rows.agg(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"))


def path_summary(paths: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """``cell, k, mean, quantiles`` over paths ``path, cell, k, y``; quantiles are exact, linearly interpolated."""
    return paths.groupBy("cell", "k").agg(F.avg("y").alias("mean"), F.percentile("y", F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantiles"))
