"""Maximum likelihood without an optimiser library.

For fixed lag kernel and weights the intensity mu_i + alpha * x_it is linear, and each cell's mu a problem of its own at a given
alpha (see profile.py). Small panels run as arrays; large ones as one pass a step, with mu a table (here and in roadfit.py).
Decay rates and dispersion are outer one-dimensional searches.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcast.functions.stats import lag_kernel
from loomcast.operators import simulate
from loomcast.operators.profile import TINY, Cells, climb, evaluate
from loomcast.session import materialise

def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def loglik(y: np.ndarray, lam: np.ndarray, dispersion: float | None = None) -> float:
    m = np.maximum(lam, TINY)
    if dispersion is None:
        return float((y * np.log(m) - m - log_gamma(y + 1)).sum())
    k = dispersion
    return float((log_gamma(y + k) - math.lgamma(k) - log_gamma(y + 1) + k * (math.log(k) - np.log(k + m)) + y * (np.log(m) - np.log(k + m))).sum())


def history(y: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    h = np.zeros(y.shape)
    for k, g in enumerate(kernel, 1):
        if k < y.shape[1]:
            h[:, k:] += g * y[:, :-k]
    return h


def fit_linear(y: np.ndarray, x: np.ndarray, alpha: float, *, scale: float = 1.0, offset: float = 0.0, dispersion: float | None = None, steps: int = 60, tol: float = 1e-12) -> tuple[np.ndarray, float, float, dict]:
    """mu, alpha >= 0 that maximise the likelihood of y with mean scale * (mu_i + alpha * x) + offset, by the profile over alpha."""
    cells = Cells.of_panel(y, x)
    a, _, done, nit = climb(lambda at: evaluate(cells, at, scale, offset, dispersion), np.array([alpha]), steps, tol)
    mu = cells.best_mu(a, scale, offset, dispersion)[:, 0]
    value = loglik(y, scale * np.maximum(mu[:, None] + a[0] * x, TINY) + offset, dispersion)
    return mu, float(a[0]), value, {"success": bool(done[0]), "message": "converged" if done[0] else "step limit reached", "nit": nit}


def search(f: Callable[[float], float], lo: float, hi: float, *, grid: int = 12, steps: int = 24) -> float:
    """Maximum of f over lo..hi on a log scale: a coarse grid (profiles may have several modes), then golden sections."""
    pts = np.linspace(math.log(lo), math.log(hi), grid)
    values = [f(math.exp(p)) for p in pts]
    k = int(np.argmax(values))
    a, b = pts[max(0, k - 1)], pts[min(grid - 1, k + 1)]
    ratio = (math.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(math.exp(c)), f(math.exp(d))
    for _ in range(steps):
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(math.exp(c))
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(math.exp(d))
    inner = math.exp((a + b) / 2)
    return inner if f(inner) >= values[k] else math.exp(pts[k])


def fit_alpha_mu(weights: np.ndarray, kernel: np.ndarray, y: np.ndarray, *, init_alpha: float = 0.1, p: float = 1.0, false_rate: float = 0.0, steps: int = 60) -> dict:
    """Poisson fit of mu and alpha; p and false_rate as known observation parameters of thinned and cluttered counts."""
    x = weights @ history(y, kernel)
    mu0 = np.maximum(y.mean(1), 1e-3)
    start = loglik(y, p * (mu0[:, None] + init_alpha * x) + false_rate)
    mu, alpha, ll, result = fit_linear(y, x, init_alpha, scale=p, offset=false_rate, steps=steps)
    return {"mu": mu, "alpha": alpha, "loglik": ll, "loglik_init": start, "result": result}


def fit_lag_decay(weights: np.ndarray, n_lags: int, y: np.ndarray, *, init_alpha: float = 0.1, init_beta: float = 1.0) -> dict:
    """mu, alpha and the decay of the lag kernel."""
    mu0 = np.maximum(y.mean(1), 1e-3)

    def profile(beta: float) -> tuple:
        return fit_linear(y, weights @ history(y, np.array(lag_kernel(n_lags, beta))), init_alpha, steps=30)

    beta = search(lambda b: profile(b)[2], 1e-2, 10.0)
    mu, alpha, ll, result = profile(beta)
    start = loglik(y, mu0[:, None] + init_alpha * (weights @ history(y, np.array(lag_kernel(n_lags, init_beta)))))
    return {"mu": mu, "alpha": alpha, "beta": beta, "kernel": np.array(lag_kernel(n_lags, beta)), "loglik": ll, "loglik_init": start, "result": result}


def fit_road(seconds: np.ndarray, kernel: np.ndarray, y: np.ndarray, *, reached: np.ndarray | None = None, family: str = "poisson", init_alpha: float = 0.1, init_beta: float = 1e-3, dispersion: float = 10.0, weights: np.ndarray | None = None) -> dict:
    """mu, alpha, road decay beta (unless the weights are given), and the dispersion of a negative binomial."""
    if family not in ("poisson", "negbin"):
        raise ValueError("family must be 'poisson' or 'negbin'")
    h, mu0 = history(y, kernel), np.maximum(y.mean(1), 1e-3)
    of = lambda beta: weights if weights is not None else simulate.road_weight_matrix(seconds, beta, reached)
    nb = family == "negbin"
    start = loglik(y, mu0[:, None] + init_alpha * (of(init_beta) @ h), dispersion if nb else None)
    k, beta, out = (dispersion if nb else None), init_beta, None
    top = seconds[seconds > 0].max(initial=1.0)
    for _ in range(4 if nb else 1):
        profile = lambda b: fit_linear(y, of(b) @ h, init_alpha, dispersion=k, steps=30)  # noqa: B023, E731
        beta = search(lambda b: profile(b)[2], 0.01 / top, 30.0 / max(seconds[seconds > 0].min(initial=top), 1e-9)) if weights is None else beta
        out = profile(beta)
        if nb:
            lam = out[0][:, None] + out[1] * (of(beta) @ h)
            k = search(lambda d: loglik(y, lam, d), 1e-2, 1e4)  # noqa: B023
    mu, alpha, ll, result = out
    if nb:
        ll = loglik(y, mu[:, None] + alpha * (of(beta) @ h), k)
    return {"mu": mu, "alpha": alpha, "beta": beta, "loglik": ll, "loglik_init": start, "family": family, "result": result} | ({"dispersion": k} if nb else {})


def observed_loglik(pairs: np.ndarray, n: np.ndarray, p: float, false_rate: float) -> float:
    """Exact log-likelihood of counted pairs (y_true, y_obs)."""
    total = 0.0
    for (yt, yo), c in zip(pairs.tolist(), n.tolist()):
        k = np.arange(0, min(yt, yo) + 1)
        thin = math.lgamma(yt + 1) - log_gamma(k + 1) - log_gamma(yt - k + 1) + k * math.log(p) + (yt - k) * (math.log1p(-p) if p < 1 else -1e300)
        clutter = (yo - k) * (math.log(false_rate) if false_rate > 0 else -1e300) - false_rate - log_gamma(yo - k + 1)
        thin, clutter = np.where(yt == k, math.lgamma(yt + 1) - log_gamma(k + 1) + k * math.log(p), thin), np.where(yo == k, -false_rate, clutter)
        term = thin + clutter
        total += c * (term.max() + math.log(np.exp(term - term.max()).sum()))
    return total


def fit_observation(rows: DataFrame) -> dict:
    """Detection probability and clutter rate of ``y_true, y_obs``; the data shrink to a table of distinct pairs and their counts.

    By expectation-maximisation over the split of each observed count into detected and clutter. Pairs beyond 100,000 distinct
    ones (counted) are refused rather than collected.
    """
    table = rows.groupBy("y_true", "y_obs").agg(F.count(F.lit(1)).alias("n"))
    if table.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 distinct pairs of counts")
    t = table.toPandas()
    yt, yo, n = (t[c].to_numpy(np.int64) for c in ("y_true", "y_obs", "n"))
    p, f = 0.7, max(0.1, 0.3 * float((yo * n).sum() / n.sum()))
    first = last = observed_loglik(np.column_stack([yt, yo]), n, p, f)
    nit = 0
    for nit in range(1, 401):
        seen = 0.0
        for a, b, c in zip(yt.tolist(), yo.tolist(), n.tolist()):
            k = np.arange(0, min(a, b) + 1)
            w = math.lgamma(a + 1) - log_gamma(k + 1) - log_gamma(a - k + 1) + k * math.log(p) + (a - k) * math.log1p(-p) + (b - k) * math.log(f) - log_gamma(b - k + 1)
            w = np.exp(w - w.max())
            seen += c * float((w * k).sum() / w.sum())
        p = min(max(seen / max(1.0, float((yt * n).sum())), 1e-6), 1 - 1e-6)
        f = max((float((yo * n).sum()) - seen) / float(n.sum()), 1e-9)
        now = observed_loglik(np.column_stack([yt, yo]), n, p, f)
        if now - last < 1e-9 * (1 + abs(now)):
            break
        last = now
    return {"p_detect": p, "false_rate": f, "loglik": now, "loglik_init": first, "result": {"success": nit < 400, "message": "converged" if nit < 400 else "step limit reached", "nit": nit}}


def ridge_fit(rows: DataFrame, ridge: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Pooled regression of y on x within cells: one row ``alpha``, and ``cell, mu`` (both not negative). ``rows``: ``cell, y, x``."""
    w = Window.partitionBy("cell")
    means = rows.withColumns({"xd": F.col("x") - F.avg("x").over(w), "yd": F.col("y") - F.avg("y").over(w)})
    alpha = means.agg(F.greatest(F.sum(F.col("xd") * F.col("yd")) / (F.sum(F.col("xd") * F.col("xd")) + F.lit(ridge)), F.lit(0.0)).alias("alpha"))
    a = alpha.first()["alpha"]
    mu = rows.groupBy("cell").agg(F.greatest(F.avg("y") - F.lit(a) * F.avg("x"), F.lit(0.0)).alias("mu"))
    return alpha, mu


def fit_distributed(rows: DataFrame, *, init_alpha: float = 0.1, steps: int = 60, tol: float = 1e-12) -> dict:
    """mu and alpha of ``cell, y, x`` of any number of cells: ``cell, mu`` as a table, alpha, log-likelihood without the factorial term.

    At a fixed alpha every cell's mu is a concave problem of its own, solved where the cell lies, and the profile over alpha is
    concave. A pass returns its value, slope and curvature as one row; alpha moves by Newton steps kept within the bracket that
    the slopes' signs leave, until the gain in sight is below ``tol``. ``result`` tells whether that was reached within ``steps`` passes.
    A cell's rows with events meet in one list, no longer than the panel has steps.
    """
    seen = F.col("y") > 0
    cells = materialise(rows.select("cell", F.col("y").cast("double"), F.col("x").cast("double")).groupBy("cell").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"), F.collect_list(F.when(seen, F.col("y"))).alias("ys"), F.collect_list(F.when(seen, F.col("x"))).alias("xs")))
    kind = rows.schema["cell"].dataType.simpleString()
    at = lambda a: cells.mapInArrow(_profiled(a), f"cell {kind}, mu double, ll double, slope double, curve double")
    lo, hi, alpha, done, nit, best = -1.0, math.inf, max(init_alpha, 0.0), False, 0, (-math.inf, 0.0)
    for nit in range(1, steps + 1):
        t = at(alpha).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("ll", "slope", "curve")]).first()
        best = max(best, (t["ll"], alpha))
        if (alpha == 0 and t["slope"] <= 0) or t["slope"] ** 2 <= 2 * tol * (1 + abs(t["ll"])) * t["curve"]:
            best, done = (t["ll"], alpha), True
            break
        lo, hi = (alpha, hi) if t["slope"] > 0 else (lo, alpha)
        step = alpha + t["slope"] / max(t["curve"], 1e-10)
        if step <= 0 and lo < 0:
            step = 0.0
        elif not lo < step < hi:
            step = (max(lo, 0.0) + hi) / 2
        alpha = min(step, 10 * alpha + 1)
    mu = materialise(at(best[1]).select("cell", "mu"))
    return {"mu": mu, "alpha": best[1], "loglik": best[0], "result": {"success": done, "message": "converged" if done else "step limit reached", "nit": nit}}


def _profiled(alpha: float):  # noqa: ANN202
    """Each cell's best mu at ``alpha``, and its share of the profile's value, slope and (negated) curvature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            n, sx = (batch.column(c).to_numpy() for c in ("n", "sx"))
            who = np.repeat(np.arange(len(n)), batch.column("ys").value_lengths().to_numpy())
            y, x = (batch.column(c).flatten().to_numpy() for c in ("ys", "xs"))
            total = lambda v: np.bincount(who, v, len(n))  # noqa: B023, E731
            mu = np.zeros(len(n))
            np.maximum.at(mu, who, y / n[who] - alpha * x)  # not above the root; from there Newton steps rise towards it
            for _ in range(200):
                lam = np.maximum(mu[who] + alpha * x, TINY)
                up = (total(y / lam) - n) / np.maximum(total(y / lam**2), TINY)
                mu, last = np.maximum(mu + up, 0), mu
                if (np.abs(mu - last) <= 1e-14 * (1e-6 + mu)).all():
                    break
            lam = np.maximum(mu[who] + alpha * x, TINY)
            c, d = total(y * x / lam**2), np.maximum(total(y / lam**2), TINY)
            curve = total(y * x * x / lam**2) - np.where(mu > 0, c * c / d, 0)
            out = [total(y * np.log(lam)) - n * mu - alpha * sx, total(y * x / lam) - sx, curve]
            yield pa.RecordBatch.from_arrays([batch.column("cell"), *map(pa.array, (mu, *out))], ["cell", "mu", "ll", "slope", "curve"])

    return run


def fit_linear_distributed(rows: DataFrame, *, init_alpha: float = 0.1, steps: int = 60, tol: float = 1e-12) -> tuple[DataFrame, float, float]:
    """``cell, mu``, alpha and log-likelihood of ``fit_distributed``; warns if it hasn't converged."""
    f = fit_distributed(rows, init_alpha=init_alpha, steps=steps, tol=tol)
    if not f["result"]["success"]:
        warnings.warn(f"fit_linear_distributed: {f['result']['message']} after {f['result']['nit']} passes", stacklevel=2)
    return f["mu"], f["alpha"], f["loglik"]


def recover_seeds(spark: SparkSession, seconds: np.ndarray, p: simulate.Params, beta: float, n_steps: int, seeds: Iterable[int], family: str = "poisson", dispersion: float | None = None) -> DataFrame:
    """``seed, mu_mae, alpha, alpha_err, beta, beta_err, dispersion, loglik, loglik_init``: simulate and refit, a task for each seed."""
    w = simulate.road_weight_matrix(seconds, beta)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        seed = int(part["seed"].iat[0])
        y = simulate.counts(w, p, n_steps, seed, family, dispersion)["y_true"]
        f = fit_road(seconds, np.asarray(p.kernel), y, family=family)
        return pd.DataFrame([(seed, float(np.abs(f["mu"] - p.mu).mean()), f["alpha"], abs(f["alpha"] - p.alpha), f["beta"], abs(f["beta"] - beta), f.get("dispersion"), f["loglik"], f["loglik_init"])], columns=_RECOVERY.replace(" bigint", "").replace(" double", "").split(", "))

    frame = spark.createDataFrame([(int(s),) for s in dict.fromkeys(seeds)], "seed bigint")
    return frame.groupBy("seed").applyInPandas(run, _RECOVERY)


_RECOVERY = "seed bigint, mu_mae double, alpha double, alpha_err double, beta double, beta_err double, dispersion double, loglik double, loglik_init double"
