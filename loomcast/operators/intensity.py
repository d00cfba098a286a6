"""Self-exciting intensities: lag convolution by window, excitation by sparse join, roll-forward forecasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.functions import stats
from loomcast.session import materialise

#: Cells up to which a recurrence runs as arrays on the driver (an L-deep buffer and the edges); counted before.
DRIVER_CELLS = 100_000
DRIVER_EDGES = 5_000_000


def lag_convolution(panel: DataFrame, kernel: Sequence[float]) -> DataFrame:
    """Adds ``h``: sum of kernel[l - 1] * y(t - l), strictly past; short histories aren't renormalised. The panel must be dense."""
    w = Window.partitionBy("cell").orderBy("t")
    h = sum((F.lit(float(g)) * F.coalesce(F.lag("y", k).over(w), F.lit(0)) for k, g in enumerate(kernel, 1)), F.lit(0.0))
    return panel.withColumn("h", h)


def lag_convolution_next(panel: DataFrame, kernel: Sequence[float], t_next: int) -> DataFrame:
    """``cell, h`` for the step after the last, from the last steps alone (the kernel is a literal of its length)."""
    g = F.array(*[F.lit(float(x)) for x in kernel])
    recent = panel.where(F.col("t").between(t_next - len(kernel), t_next - 1))
    return recent.groupBy("cell").agg(F.sum(F.get(g, F.lit(t_next - 1) - F.col("t")) * F.col("y")).alias("h"))


def road_weights(neighbours: DataFrame, beta: float | None = None, kernel: stats.KernelFn | None = None) -> DataFrame:
    """``i, j, w``: exp(-beta * seconds), or a kernel of them; w is 1 on the diagonal, which is added where absent."""
    if (beta is None) == (kernel is None):
        raise ValueError("give either beta or a kernel")
    d = F.col("travel_time_s")
    w = F.exp(F.lit(-float(beta)) * d) if kernel is None else stats.kernel_column(kernel, d)
    edges = neighbours.where("i <> j").select("i", "j", w.alias("w"))
    cells = neighbours.select(F.explode(F.array("i", "j")).alias("i")).groupBy("i").agg(F.lit(1.0).alias("w")).select("i", F.col("i").alias("j"), "w")
    return edges.unionByName(cells)


def check_weights(weights: DataFrame) -> DataFrame:
    """``weights`` itself; ValueError if any is negative, NaN or infinite."""
    if bad := weights.where("w < 0 or isnan(w) or w = double('infinity') or w is null").count():
        raise ValueError(f"{bad} weights are negative or not finite")
    return weights


def excitation(weights: DataFrame, history: DataFrame, frame: DataFrame) -> DataFrame:
    """Adds ``x`` = sum over j of w[i, j] * h[j, t] to ``frame`` (``cell, t, ...``); 0 where a cell has no sources.

    Zeros of h are left out before the join, sums are reduced map-side, and no size is assumed of either side.
    """
    part = weights.join(history.where("h <> 0").select(F.col("cell").alias("j"), "t", "h"), "j").groupBy(F.col("i").alias("cell"), "t").agg(F.sum(F.col("w") * F.col("h")).alias("x"))
    return frame.join(part, ["cell", "t"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


def excitation_next(weights: DataFrame, h: DataFrame) -> DataFrame:
    """``cell, x`` for one step; cells come from the weights' rows."""
    part = weights.join(h.select(F.col("cell").alias("j"), "h"), "j", "left").groupBy(F.col("i").alias("cell"))
    return part.agg(F.coalesce(F.sum(F.col("w") * F.col("h")), F.lit(0.0)).alias("x"))


def intensity_column(mu: Column, alpha: float, x: Column) -> Column:
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    return F.greatest(mu + F.lit(float(alpha)) * x, F.lit(0.0))


def in_sample(panel: DataFrame, weights: DataFrame, kernel: Sequence[float], mu: Column, alpha: float) -> DataFrame:
    """``cell, t, y, h, x, lam`` over a dense panel: one window pass, one join, no recursion. ``mu`` may use ``cell``.

    The history is written once, as both sides of the join read it.
    """
    hist = materialise(lag_convolution(panel, kernel))
    return excitation(weights, hist, hist).withColumn("lam", intensity_column(mu, alpha, F.col("x")))


def next_step(panel: DataFrame, weights: DataFrame, kernel: Sequence[float], mu: Column, alpha: float, t_next: int) -> DataFrame:
    """``cell, lam`` for the step after the last."""
    return excitation_next(weights, lag_convolution_next(panel, kernel, t_next)).select("cell", intensity_column(mu, alpha, F.col("x")).alias("lam"))


def trailing_mean(panel: DataFrame, window: int, bias: Column, weight: float, t_last: int) -> DataFrame:
    """``cell, feature, lam``: softplus of bias + weight * mean of the last steps (fewer if the history is short)."""
    if weight < 0:
        raise ValueError("weight must not be negative")
    feature = panel.where(F.col("t").between(t_last - window + 1, t_last)).groupBy("cell").agg(F.avg("y").alias("feature"))
    return feature.withColumn("lam", stats.softplus(bias + F.lit(float(weight)) * F.col("feature")))


def roll_forward(panel: DataFrame, weights: DataFrame, kernel: Sequence[float], mu: DataFrame, alpha: float, horizon: int, t_next: int, *, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """``cell, k, lam`` for k = 1..horizon: each step's (scaled and offset) intensity is the next one's history.

    The recurrence needs only the last L steps. Up to DRIVER_CELLS cells and DRIVER_EDGES edges (counted) it runs as arrays
    on the driver; beyond, a step is a join over an L-deep buffer table.
    """
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    deep = len(kernel)
    recent = panel.where(F.col("t").between(t_next - deep, t_next - 1)).select("cell", "t", F.col("y").cast("double").alias("y"))
    if mu.count() <= DRIVER_CELLS and weights.count() <= DRIVER_EDGES:
        m = mu.select("cell", "mu").orderBy("cell").toPandas()
        cells = m["cell"].to_numpy()
        place = {c: k for k, c in enumerate(cells.tolist())}
        buffer = np.zeros((len(cells), deep + horizon))
        for r in recent.toPandas().itertuples():
            if r.cell in place:
                buffer[place[r.cell], r.t - (t_next - deep)] = r.y
        w = weights.select("i", "j", "w").toPandas()
        i, j = w["i"].map(place), w["j"].map(place)
        ok = (i.notna() & j.notna()).to_numpy()
        i, j, w = i[ok].astype(int).to_numpy(), j[ok].astype(int).to_numpy(), w["w"].to_numpy()[ok]
        g, out = np.array(kernel)[::-1], []
        for k in range(horizon):
            h = buffer[:, k : k + deep] @ g
            x = np.bincount(i, w * h[j], len(cells)) if len(i) else np.zeros(len(cells))
            lam = np.maximum(scale * np.maximum(m["mu"].to_numpy() + alpha * x, 0) + offset, 0)
            buffer[:, deep + k] = lam
            out += zip(cells.tolist(), [k + 1] * len(cells), lam.tolist())
        return panel.sparkSession.createDataFrame(out, "cell int, k int, lam double")
    buffer, steps = recent, None
    for k in range(horizon):
        h = lag_convolution_next(buffer, kernel, t_next + k)
        x = mu.select("cell", "mu").join(excitation_next(weights, h), "cell", "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
        lam = F.greatest(F.lit(scale) * intensity_column(F.col("mu"), alpha, F.col("x")) + F.lit(offset), F.lit(0.0))
        step = materialise(x.select(F.col("cell").cast("int").alias("cell"), F.lit(k + 1).alias("k"), lam.alias("lam")))
        steps = step if steps is None else steps.unionByName(step)
        buffer = buffer.where(F.col("t") >= t_next + k + 1 - deep).unionByName(step.select("cell", F.lit(t_next + k).alias("t"), F.col("lam").alias("y")))
    return steps
