"""Workflows: observed fit and forecast, road fit and forecast, backtest, synthetic evaluation."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.functions.stats import lag_kernel
from loomcast.operators import fit, likelihood, simulate


def observed_fit_sample_summarize(spark: SparkSession, world: simulate.World, kernel: np.ndarray, y_obs: np.ndarray, horizon: int, n_paths: int, seed: int, p: float, false_rate: float, q: tuple[float, ...] = (0.05, 0.5, 0.95)) -> tuple[dict, DataFrame]:
    """Fit on observed counts, expected roll-forward, sampled paths, their mean and quantiles (``cell, k, mean, quantiles``)."""
    f = fit.fit_alpha_mu(world.weights, kernel, y_obs, p=p, false_rate=false_rate)
    lam = simulate.expected_observed(world.weights, simulate.Params(f["mu"], f["alpha"], kernel, p, false_rate), y_obs, horizon)
    paths = simulate.observed_paths(spark, lam, n_paths, seed).withColumnRenamed("y_obs", "y")
    return f, likelihood.path_summary(paths, q)


def road_forecast(seconds: np.ndarray, kernel: np.ndarray, fitted: dict, y: np.ndarray, horizon: int, reached: np.ndarray | None = None) -> np.ndarray:
    """Mean-field intensities (n, horizon) of a fitted road model."""
    w = simulate.road_weight_matrix(seconds, fitted["beta"], reached)
    return simulate.expected_observed(w, simulate.Params(fitted["mu"], fitted["alpha"], kernel), y, horizon)


def fit_forecast_road(seconds: np.ndarray, kernel: np.ndarray, y: np.ndarray, horizon: int, family: str = "poisson", reached: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    f = fit.fit_road(seconds, kernel, y, family=family, reached=reached)
    return f, road_forecast(seconds, kernel, f, y, horizon, reached)


def backtest(seconds: np.ndarray, kernel: np.ndarray, y: np.ndarray, n_train: int, horizon: int, family: str = "poisson", reached: np.ndarray | None = None) -> dict:
    """Fit on the first n_train steps, forecast the next ones, mean negative log-likelihood; a negative binomial is scored by its fitted dispersion."""
    if n_train <= 1 or horizon <= 0 or n_train + horizon > y.shape[1]:
        raise ValueError("n_train must exceed 1, horizon 0, and both together fit the steps")
    f, lam = fit_forecast_road(seconds, kernel, y[:, :n_train], horizon, family, reached)
    test = y[:, n_train : n_train + horizon]
    return {"n_train": n_train, "horizon": horizon, "nll": -fit.loglik(test, lam, f.get("dispersion")) / test.size}


@dataclass(frozen=True)
class EvalConfig:
    seed: int = 0
    n_locations: int = 5
    n_steps_train: int = 60
    horizon: int = 7
    n_lags: int = 6
    beta: float = 1.0
    mu: float = 0.5
    alpha: float = 0.6
    p_detect: float = 1.0
    false_rate: float = 0.0
    n_paths: int = 200
    q: tuple[float, ...] = (0.05, 0.5, 0.95)


def evaluate_synthetic(spark: SparkSession, c: EvalConfig) -> dict:
    """World (seed s), counts (s + 1), fit, paths (s + 2), then held-out error, likelihood and coverage."""
    world = simulate.random_world(c.n_locations, c.seed, lengthscale=0.5)
    truth = simulate.Params(np.full(c.n_locations, c.mu), c.alpha, np.array(lag_kernel(c.n_lags, c.beta)), c.p_detect, c.false_rate)
    y = simulate.counts(world.weights, truth, c.n_steps_train + c.horizon, c.seed + 1)["y_true"]
    train, test = y[:, : c.n_steps_train], y[:, c.n_steps_train :]
    f = fit.fit_lag_decay(world.weights, c.n_lags, train)
    hat = simulate.Params(f["mu"], f["alpha"], f["kernel"], c.p_detect, c.false_rate)
    paths = simulate.predictive_paths(spark, world.weights, hat, train, c.horizon, c.n_paths, c.seed + 2).withColumnRenamed("y_true", "y")
    rows = likelihood.path_summary(paths, tuple(c.q)).orderBy("cell", "k").toPandas()
    shape = (c.n_locations, c.horizon)
    mean = rows["mean"].to_numpy().reshape(shape)
    quantiles = np.array(rows["quantiles"].tolist()).reshape(*shape, len(c.q)).transpose(2, 0, 1)
    lam = f["mu"][:, None] + f["alpha"] * (world.weights @ fit.history(y, f["kernel"]))
    metrics = {"nll_test": -fit.loglik(test, lam[:, c.n_steps_train :]) / test.size, "rmse": float(np.sqrt(((test - mean) ** 2).mean())), "mae": float(np.abs(test - mean).mean())}
    if len(c.q) > 1:
        lo, hi = quantiles[int(np.argmin(c.q))], quantiles[int(np.argmax(c.q))]
        metrics["coverage"] = float(((test >= lo) & (test <= hi)).mean())
    return {"config": asdict(c) | {"q": list(c.q)}, "fit": {k: f[k] if k != "mu" else f[k].tolist() for k in ("mu", "alpha", "beta", "loglik", "loglik_init")}, "forecasts": {"q": list(c.q), "y_true_mean": mean.tolist(), "y_true_quantiles": quantiles.tolist()}, "metrics": metrics}


def recovery_medians(recovered: DataFrame) -> DataFrame:
    return recovered.agg(*[F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in ("mu_mae", "alpha_err", "beta_err")])
