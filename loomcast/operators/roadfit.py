"""The road model fitted over tables: mu by cell, alpha, the decay of travel times, and the dispersion of a negative binomial.

No matrix of cells by cells is ever built. One join of edges and history gives the excitation of every cell and step for several
decay rates at once; a cell's rows then meet in one list, no longer than the panel has steps. At given alpha each cell's mu is a
problem of its own, solved where the cell lies, for all decay rates together; a pass returns a few sums for each of them.
Alpha moves by scoring steps within the bracket that the slopes leave, decay and dispersion by narrowing grids.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.operators import intensity, likelihood
from loomcast.operators.profile import TINY, Cells, climb, evaluate, value_at
from loomcast.session import materialise

#: Decay rates tried at once, and how often their grid narrows.
RATES, NARROWINGS = 9, 3
#: Dispersions tried at once, and their range.
DISPERSIONS, WIDEST = 17, (1e-2, 1e6)


@dataclass
class RoadFit:
    """``mu``: ``cell, mu``. ``dispersion`` is None for a Poisson model. ``loglik`` includes the factorial terms."""

    mu: DataFrame
    alpha: float
    beta: float
    dispersion: float | None
    loglik: float
    converged: bool
    passes: int


def excitations(panel: DataFrame, neighbours: DataFrame, kernel: Sequence[float], rates: Sequence[float]) -> DataFrame:
    """``cell, y, x`` of every cell and step, x being an array with the excitation at each decay rate; a cell weighs 1 on itself.

    Zeros of the history are left out before the join, the sums are reduced map-side; steps without any source have null x.
    """
    hist = intensity.lag_convolution(panel, kernel).select("cell", "t", F.col("y").cast("double").alias("y"), "h")
    own = neighbours.select(F.explode(F.array("i", "j")).alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("d"))
    edges = neighbours.where("i <> j").select("i", "j", F.col("travel_time_s").alias("d")).unionByName(own)
    sources = hist.where("h <> 0").select(F.col("cell").alias("j"), "t", "h")
    sums = [F.sum(F.exp(F.lit(-float(b)) * F.col("d")) * F.col("h")).alias(f"__x{k}") for k, b in enumerate(rates)]
    x = edges.join(sources, "j").groupBy(F.col("i").alias("cell"), "t").agg(*sums)
    return hist.select("cell", "t", "y").join(x, ["cell", "t"], "left").select("cell", "y", F.when(F.col("__x0").isNotNull(), F.array(*[f"__x{k}" for k in range(len(rates))])).alias("x"))


def _lists(rows: DataFrame, rates: int) -> DataFrame:
    """A row a cell: ``n0`` steps with neither events nor sources, and the others' ``ys`` and ``xs`` (rates after another)."""
    busy = (F.col("y") > 0) | F.col("x").isNotNull()
    x = F.coalesce("x", F.array_repeat(F.lit(0.0), rates))
    listed = F.collect_list(F.when(busy, F.struct("y", x.alias("x"))))
    cells = rows.groupBy("cell").agg(F.count_if(~busy).cast("double").alias("n0"), listed.alias("r"))
    return cells.select("cell", "n0", F.col("r.y").alias("ys"), F.flatten("r.x").alias("xs"))


def _pass(rates: int, alpha: np.ndarray, scale: float, offset: float, k: float | None):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sums = evaluate(Cells.of_lists(batch, rates), alpha, scale, offset, k)
            yield pa.RecordBatch.from_arrays([pa.array(range(rates), pa.int32()), *map(pa.array, sums)], ["rate", "value", "slope", "info"])

    return run


def _fit_alpha(cells: DataFrame, rates: int, alpha: np.ndarray, scale: float, offset: float, k: float | None, steps: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(alpha, value, converged, passes) of each rate."""

    def at(alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums = cells.mapInArrow(_pass(rates, alpha, scale, offset, k), "rate int, value double, slope double, info double").groupBy("rate").agg(*[F.sum(c).alias(c) for c in ("value", "slope", "info")])
        out = np.zeros((3, rates))
        for r in sums.collect():  # a row a rate
            out[:, r["rate"]] = r["value"], r["slope"], r["info"]
        return out[0], out[1], out[2]

    return climb(at, alpha, steps, tol)


def _fit_dispersion(cells: DataFrame, rates: int, which: int, alpha: float, k: float | None, scale: float, offset: float) -> tuple[float, int]:
    """The dispersion that suits the means best, by grids that narrow; several dispersions a pass."""
    lo, hi, used = *map(math.log, WIDEST), 0
    for _ in range(4):
        grid = np.linspace(lo, hi, DISPERSIONS)

        def run(batches: Iterable[pa.RecordBatch], grid: np.ndarray = grid) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                c = Cells.of_lists(batch, rates)
                c.x = c.x[:, [which]]
                a = np.array([alpha])
                lam = c.mean(c.best_mu(a, scale, offset, k), a, scale, offset)[:, 0]
                levels, back = np.unique(c.y, return_inverse=True)
                out = []
                for g in np.exp(grid):
                    log_gamma = np.array([math.lgamma(v + g) - math.lgamma(g) for v in levels])[back]
                    out.append(float((c.weight * (log_gamma + value_at(c.y, lam, g))).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(out)], ["at", "value"])

        sums = {r["at"]: r["value"] for r in cells.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}  # a row a dispersion
        used += 1
        if not sums:
            return math.exp(hi), used
        at = max(sums, key=sums.get)
        lo, hi = grid[max(0, at - 1)], grid[min(DISPERSIONS - 1, at + 1)]
    return math.exp(grid[at]), used


def fit_road(panel: DataFrame, neighbours: DataFrame, kernel: Sequence[float], *, beta: float | None = None, family: str = "poisson", p: float = 1.0, false_rate: float = 0.0, init_alpha: float = 0.1, rounds: int = 6, steps: int = 60, tol: float = 1e-10) -> RoadFit:
    """Fit ``panel`` (dense ``cell, t, y``) over ``neighbours`` (``i, j, travel_time_s``), beta too unless it is given.

    The mean of y is p * (mu_i + alpha * x_it) + false_rate. A negative binomial's dispersion and the other parameters take
    turns until the likelihood gains less than a thousandth, at most ``rounds`` times. ``converged`` tells whether that
    and every alpha's scoring steps ended so; a warning is given otherwise. Cells without a row in ``neighbours`` excite themselves
    only if listed there. An empty panel raises ValueError.
    """
    if family not in ("poisson", "negbin"):
        raise ValueError("family must be 'poisson' or 'negbin'")
    panel = materialise(panel.select("cell", "t", "y"))
    if panel.isEmpty():
        raise ValueError("the panel is empty")
    span = neighbours.where("i <> j and travel_time_s > 0").agg(F.min("travel_time_s").alias("lo"), F.max("travel_time_s").alias("hi")).first()
    nearest, furthest = span["lo"] or 1.0, span["hi"] or 1.0
    wide = (math.log(0.01 / furthest), math.log(30.0 / max(nearest, 1e-9)))
    k, alpha, passes, kept, converged = None, init_alpha, 0, None, True
    for turn in range(rounds if family == "negbin" else 1):
        lo, hi = wide if kept is None else (math.log(kept[1]) - 0.3, math.log(kept[1]) + 0.3)
        for narrowing in range(1 if beta is not None else NARROWINGS if kept is None else 1):
            rates = [beta] if beta is not None else np.exp(np.linspace(lo, hi, RATES)).tolist()
            if beta is None or kept is None:
                cells = materialise(_lists(excitations(panel, neighbours, kernel, rates), len(rates)))
            start = np.full(len(rates), alpha)
            a, value, done, used = _fit_alpha(cells, len(rates), start, p, false_rate, k, steps, tol)
            passes += used
            which = int(np.argmax(value))
            alpha, rate = float(a[which]), rates[which]
            grid = np.log(rates)
            lo, hi = grid[max(0, which - 1)], grid[min(len(rates) - 1, which + 1)]
        converged = bool(done[which])
        if family == "poisson":
            break
        fresh, used = _fit_dispersion(cells, len(rates), which, alpha, k, p, false_rate)
        passes += used
        same = kept is not None and abs(math.log(fresh) - math.log(kept[2])) < 1e-3 and abs(math.log(rate) - math.log(kept[1])) < 0.08 and abs(alpha - kept[0]) < 1e-3
        k, kept = fresh, (alpha, rate, fresh)
        if same:
            break
        converged = False
    mu = materialise(cells.mapInArrow(_mus(len(rates), which, alpha, p, false_rate, k), f"cell {panel.schema['cell'].dataType.simpleString()}, mu double"))
    x = cells_rows(cells, len(rates), which).join(mu, "cell")
    lam = F.lit(p) * F.greatest(F.col("mu") + F.lit(alpha) * F.col("x"), F.lit(TINY)) + F.lit(false_rate)
    loglik = x.agg(F.sum(F.col("weight") * likelihood.logpmf(F.col("y"), lam, family, k))).first()[0]
    if not converged:
        warnings.warn(f"fit_road: not converged after {passes} passes", stacklevel=2)
    return RoadFit(mu, alpha, float(rate), k, float(loglik), converged, passes)


def _mus(rates: int, which: int, alpha: float, scale: float, offset: float, k: float | None):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            c = Cells.of_lists(batch, rates)
            c.x = c.x[:, [which]]
            yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(c.best_mu(np.array([alpha]), scale, offset, k)[:, 0])], ["cell", "mu"])

    return run


def cells_rows(cells: DataFrame, rates: int, which: int) -> DataFrame:
    """``cell, y, x, weight`` of the lists, at one rate; a cell's idle steps are one row."""
    busy = cells.select("cell", F.posexplode("ys").alias("k", "y"), "xs").select("cell", "y", F.get("xs", F.col("k") * rates + which).alias("x"), F.lit(1.0).alias("weight"))
    return busy.unionByName(cells.select("cell", F.lit(0.0).alias("y"), F.lit(0.0).alias("x"), F.col("n0").alias("weight")))


def forecast(panel: DataFrame, neighbours: DataFrame, kernel: Sequence[float], fitted: RoadFit, horizon: int, t_next: int) -> DataFrame:
    """``cell, k, lam``: mean-field intensities of a fitted road model beyond the panel."""
    weights = intensity.road_weights(neighbours, fitted.beta)
    return intensity.roll_forward(panel, weights, kernel, fitted.mu, fitted.alpha, horizon, t_next)


def backtest(panel: DataFrame, neighbours: DataFrame, kernel: Sequence[float], n_train: int, horizon: int, **options: object) -> dict:
    """Fit on the first n_train steps, forecast the next ones: mean negative log-likelihood; a negative binomial is scored by its fitted dispersion."""
    last = panel.agg(F.max("t")).first()[0]
    if n_train <= 1 or horizon <= 0 or last is None or n_train + horizon > last + 1:
        raise ValueError("n_train must exceed 1, horizon 0, and both together fit the steps")
    train = panel.where(F.col("t") < n_train)
    fitted = fit_road(train, neighbours, kernel, **options)
    lam = forecast(train, neighbours, kernel, fitted, horizon, n_train).select("cell", (F.col("k") + F.lit(n_train - 1)).alias("t"), "lam")
    test = panel.where(F.col("t").between(n_train, n_train + horizon - 1)).join(lam, ["cell", "t"])
    nll = test.agg(F.avg(-likelihood.logpmf(F.col("y"), F.col("lam"), "poisson" if fitted.dispersion is None else "negbin", fitted.dispersion))).first()[0]
    return {"n_train": n_train, "horizon": horizon, "nll": float(nll), "fit": fitted}


