"""Random worlds, simulated counts and predictive paths. Parallel over seeds and paths, sequential over time within one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class World:
    """Locations ``xy`` (n, 2) and weights (n, n), dense or as edges: weights[i, j] is what j contributes to i."""

    xy: np.ndarray
    weights: np.ndarray | Edges

    def __post_init__(self) -> None:
        n = len(self.xy)
        values = self.weights.w if isinstance(self.weights, Edges) else self.weights
        if self.weights.shape != (n, n) or not np.isfinite(values).all():
            raise ValueError("weights must be a finite square matrix of the locations")

    def to_dict(self) -> dict:
        return {"xy": self.xy.tolist(), "mobility": self.weights.tolist()}

    @staticmethod
    def from_dict(d: dict) -> World:
        return World(np.array(d["xy"], float), np.array(d["mobility"], float))


@dataclass(frozen=True)
class Params:
    mu: np.ndarray
    alpha: float
    kernel: np.ndarray
    p_detect: float = 1.0
    false_rate: float = 0.0

    def __post_init__(self) -> None:
        if self.alpha < 0 or len(self.kernel) == 0 or not 0 < self.p_detect <= 1 or self.false_rate < 0:
            raise ValueError("alpha and false_rate must not be negative, p_detect in (0, 1], the kernel not empty")

    def to_dict(self) -> dict:
        return {"mu": np.asarray(self.mu).tolist(), "alpha": self.alpha, "kernel": np.asarray(self.kernel).tolist(), "p_detect": self.p_detect, "false_rate": self.false_rate}

    @staticmethod
    def from_dict(d: dict) -> Params:
        return Params(np.array(d["mu"], float), d["alpha"], np.array(d["kernel"], float), d["p_detect"], d["false_rate"])


def random_world(n: int, seed: int, lengthscale: float = 1.0, self_weight: float = 1.0, row_normalize: bool = True) -> World:
    """Uniform locations in the unit square with radial weights; rows sum to 1 if normalised."""
    if n <= 0 or lengthscale <= 0:
        raise ValueError("the number of locations and the lengthscale must be positive")
    xy = np.random.default_rng(seed).uniform(0.0, 1.0, size=(n, 2))
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    w = np.exp(-0.5 * d2 / lengthscale**2)
    w[np.diag_indices(n)] *= self_weight
    if row_normalize:
        total = w.sum(1, keepdims=True)
        w = w / np.where(total == 0, 1.0, total)
    return World(xy, w)


#: Edges, and cells times steps, that are held as arrays at most; both are counted before.
ARRAY_EDGES, ARRAY_VALUES = 5_000_000, 50_000_000


@dataclass(frozen=True)
class Edges:
    """Sparse weights of n cells: ``Edges @ h`` sums w * h[j] into i, as a matrix would. h has a row a cell."""

    i: np.ndarray
    j: np.ndarray
    w: np.ndarray
    n: int

    def __matmul__(self, h: np.ndarray) -> np.ndarray:
        if h.ndim == 1:
            return np.bincount(self.i, self.w * h[self.j], self.n)
        return np.column_stack([self @ h[:, k] for k in range(h.shape[1])]) if h.shape[1] else np.zeros((self.n, 0))

    @property
    def shape(self) -> tuple[int, int]:
        return self.n, self.n

    def __len__(self) -> int:
        return self.n


def edges_from(weights: DataFrame, cells: Sequence[int]) -> Edges:
    """Sparse weights of a table ``i, j, w``; edges of other cells are left out. More than ARRAY_EDGES rows raise ValueError."""
    if (rows := weights.count()) > ARRAY_EDGES:
        raise ValueError(f"{rows} edges are more than the {ARRAY_EDGES} that are held as arrays")
    place = pd.Series(range(len(cells)), index=list(cells))
    t = weights.select("i", "j", "w").toPandas()
    t = t[t["i"].isin(place.index) & t["j"].isin(place.index)]
    return Edges(place.loc[t["i"]].to_numpy(), place.loc[t["j"]].to_numpy(), t["w"].to_numpy(float), len(cells))


def road_weight_matrix(seconds: np.ndarray, beta: float, reached: np.ndarray | None = None) -> np.ndarray:
    """exp(-beta * seconds) where reached (by default everywhere), 1 on the diagonal."""
    if (seconds < 0).any():
        raise ValueError("travel times must not be negative")
    w = np.exp(-beta * seconds) * (1 if reached is None else reached)
    w[np.diag_indices(len(w))] = 1.0
    return w


def _history(y: np.ndarray, kernel: np.ndarray, t: int) -> np.ndarray:
    n = min(len(kernel), t)
    return y[:, t - n : t] @ kernel[:n][::-1] if n else np.zeros(len(y))


def draw_negbin(rng: np.random.Generator, mean: np.ndarray, dispersion: float) -> np.ndarray:
    if dispersion <= 0:
        raise ValueError("dispersion must be positive")
    mean = np.maximum(mean, 0.0)
    return rng.negative_binomial(dispersion, dispersion / (dispersion + mean + 1e-12), size=mean.shape)


def counts(weights: np.ndarray | Edges, p: Params, n_steps: int, seed: int, family: str = "poisson", dispersion: float | None = None) -> dict[str, np.ndarray]:
    """``y_true, y_obs, intensity`` (n, n_steps) from one random stream: counts step by step, then thinning, then clutter."""
    if n_steps <= 0:
        raise ValueError("n_steps must be positive")
    if family not in ("poisson", "negbin") or (family == "negbin" and dispersion is None):
        raise ValueError("family must be 'poisson', or 'negbin' with a dispersion")
    rng, n = np.random.default_rng(seed), len(p.mu)
    y, lam = np.zeros((n, n_steps), int), np.zeros((n, n_steps))
    for t in range(n_steps):
        lam[:, t] = np.maximum(p.mu + p.alpha * (weights @ _history(y, p.kernel, t)), 0.0)
        y[:, t] = rng.poisson(lam[:, t]) if family == "poisson" else draw_negbin(rng, lam[:, t], dispersion)
    return {"y_true": y, "y_obs": _observe(rng, y, p), "intensity": lam}


def _observe(rng: np.random.Generator, y: np.ndarray, p: Params) -> np.ndarray:
    seen = rng.binomial(y, p.p_detect) if p.p_detect < 1 else y.copy()
    return seen + (rng.poisson(p.false_rate, size=y.shape) if p.false_rate > 0 else 0)


def simulate_seeds(spark: SparkSession, weights: np.ndarray | Edges, p: Params, n_steps: int, seeds: Sequence[int], family: str = "poisson", dispersion: float | None = None) -> DataFrame:
    """``seed, location, time, y_true, y_obs, intensity``: a task for each seed, the same numbers for the same seed."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        seed = int(part["seed"].iat[0])
        out = counts(weights, p, n_steps, seed, family, dispersion)
        i, t = np.indices(out["y_true"].shape)
        return pd.DataFrame({"seed": seed, "location": i.ravel(), "time": t.ravel(), **{k: v.ravel() for k, v in out.items()}})

    frame = spark.createDataFrame([(int(s),) for s in dict.fromkeys(seeds)], "seed bigint")
    return frame.groupBy("seed").applyInPandas(run, "seed bigint, location bigint, time bigint, y_true bigint, y_obs bigint, intensity double")


_PATHS = "path int, cell int, k int, y_true bigint, y_obs bigint, intensity double"


def predictive_paths(spark: SparkSession, weights: np.ndarray | Edges, p: Params, history: np.ndarray, horizon: int, n_paths: int, seed: int) -> DataFrame:
    """Latent roll-forward paths, a task for a block of them. Path i draws from the stream (seed, i), so the paths don't depend on the blocks."""
    if horizon <= 0 or n_paths <= 0:
        raise ValueError("horizon and n_paths must be positive")
    past = np.asarray(history, int)[:, -len(p.kernel) :]

    def one(path: int) -> tuple[np.ndarray, ...]:
        rng = np.random.default_rng([seed, path])
        y = np.concatenate([past, np.zeros((len(past), horizon), int)], 1)
        lam, obs = np.zeros((len(past), horizon)), np.zeros((len(past), horizon), int)
        for k in range(horizon):
            t = past.shape[1] + k
            lam[:, k] = np.maximum(p.mu + p.alpha * (weights @ _history(y, p.kernel, t)), 0.0)
            y[:, t] = rng.poisson(lam[:, k])
            obs[:, k] = _observe(rng, y[:, t], p)
        return y[:, past.shape[1] :], obs, lam

    return _blocks(spark, one, n_paths)


def observed_paths(spark: SparkSession, lam_obs: np.ndarray, n_paths: int, seed: int) -> DataFrame:
    """Independent draws around expected observed counts (n, horizon), which are the same on every path."""

    def one(path: int) -> tuple[np.ndarray, ...]:
        y = np.random.default_rng([seed, path]).poisson(lam_obs)
        return y, y, lam_obs

    return _blocks(spark, one, n_paths)


def _blocks(spark: SparkSession, one: Callable[[int], tuple[np.ndarray, ...]], n_paths: int) -> DataFrame:
    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for path in b["id"].tolist():
                y, obs, lam = one(path)
                i, k = np.indices(y.shape)
                yield pd.DataFrame({"path": path, "cell": i.ravel(), "k": k.ravel() + 1, "y_true": y.ravel(), "y_obs": obs.ravel(), "intensity": lam.ravel()})

    return spark.range(0, n_paths, 1, min(n_paths, 64)).mapInPandas(run, _PATHS)


def expected_observed(weights: np.ndarray | Edges, p: Params, history: np.ndarray, horizon: int) -> np.ndarray:
    """Expected observed counts (n, horizon), each step's being the next one's history."""
    y = np.concatenate([np.asarray(history, float)[:, -len(p.kernel) :], np.zeros((len(history), horizon))], 1)
    start = y.shape[1] - horizon
    for t in range(start, y.shape[1]):
        y[:, t] = np.maximum(p.p_detect * np.maximum(p.mu + p.alpha * (weights @ _history(y, p.kernel, t)), 0.0) + p.false_rate, 0.0)
    return y[:, start:]


def edges_of(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    i, j = np.nonzero(weights)
    return spark.createDataFrame([*zip(i.tolist(), j.tolist(), weights[i, j].tolist())], "i int, j int, w double")


def panel_of(spark: SparkSession, y: np.ndarray) -> DataFrame:
    i, t = np.indices(np.asarray(y).shape)
    return spark.createDataFrame([*zip(i.ravel().tolist(), t.ravel().tolist(), np.asarray(y).ravel().astype(int).tolist())], "cell int, t int, y bigint")


def matrix_of(panel: DataFrame, cells: Sequence[int], n_steps: int, y: str = "y") -> np.ndarray:
    """A dense panel as (cells, steps); one of more than ARRAY_VALUES values raises ValueError."""
    if len(cells) * n_steps > ARRAY_VALUES:
        raise ValueError(f"{len(cells)} cells and {n_steps} steps are more than the {ARRAY_VALUES} values that are held as arrays")
    place = {c: k for k, c in enumerate(cells)}
    out = np.zeros((len(cells), n_steps))
    t = panel.where(F.col(y) != 0).select("cell", "t", F.col(y).alias("y")).toPandas()
    t = t[t["cell"].isin(list(place))]
    out[t["cell"].map(place).to_numpy(int), t["t"].to_numpy(int)] = t["y"].to_numpy(float)
    return out
