"""Road graphs: travel times, nearest nodes, cutoff shortest paths between cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.operators.skew import salted_join
from loomcast.session import materialise

# Default speeds in km/h by road class; any other class gets DEFAULT_KPH.
SPEED_KPH = {"motorway": 110.0, "trunk": 90.0, "primary": 70.0, "secondary": 60.0, "tertiary": 50.0, "residential": 30.0, "service": 20.0}
DEFAULT_KPH = 50.0


def impute_travel_time(edges: DataFrame) -> DataFrame:
    """Fills missing ``travel_time`` (s) from ``length`` (m) and the class's speed. Every edge that lacks one is filled, also if others have theirs."""
    kph = F.lit(DEFAULT_KPH)
    if "highway" in edges.columns:
        for name, v in SPEED_KPH.items():
            kph = F.when(F.col("highway") == name, v).otherwise(kph)
    own = F.col("travel_time") if "travel_time" in edges.columns else F.lit(None).cast("double")
    return edges.withColumn("travel_time", F.coalesce(own, F.col("length") / (kph / 3.6)))


def nearest_node(points: DataFrame, nodes: DataFrame, tile: float) -> DataFrame:
    """``cell, node``: the nearest node of each point (both ``x, y`` in metres), searched in tiles of ``tile`` metres.

    A point meets the nodes of its own and the eight tiles around; any nearer than ``tile`` is the true nearest. Rings widen
    (tile doubled) for the points left, until one tile spans all nodes. Ties go to the least node id; no nodes, no rows.
    """
    box = nodes.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    if box[0] is None:
        return points.select("cell", F.lit(None).cast("bigint").alias("node")).where("false")
    reach = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    far = points.agg(F.max(F.greatest(F.abs(F.col("x") - reach[0]), F.abs(F.col("x") - reach[1]), F.abs(F.col("y") - reach[2]), F.abs(F.col("y") - reach[3])))).first()[0] or 0.0
    left, out = points.select("cell", "x", "y"), None
    while True:
        t = F.lit(tile)
        near = left.withColumns({"tx": F.floor(F.col("x") / t), "ty": F.floor(F.col("y") / t)})
        ring = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a, b))))"))
        ringed = near.withColumn("r", ring).select("cell", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("tx") + F.col("r.a")).alias("tx"), (F.col("ty") + F.col("r.b")).alias("ty"))
        tiled = nodes.select("node", "x", "y", F.floor(F.col("x") / t).alias("tx"), F.floor(F.col("y") / t).alias("ty"))
        d2 = F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)
        best = salted_join(tiled, ringed, ["tx", "ty"], F.col("node")).groupBy("cell").agg(F.min(F.struct(d2.alias("d2"), "node")).alias("b"))
        last = tile >= far
        done = best.where(F.lit(last) | (F.col("b.d2") <= tile * tile)).select("cell", F.col("b.node").alias("node"))
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        left = materialise(left.join(done, "cell", "left_anti"))
        if left.isEmpty():
            return out
        tile *= 2


def cutoff_paths(edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """``src, node, d``: shortest times up to ``cutoff`` (inclusive) from every source, itself at 0.

    Frontier relaxation: only pairs improved in the last round are extended, so a round's work follows the frontier; every
    round is a checkpoint. Weights must not be negative; parallel edges count by their least, edges without time not at all.
    """
    if edges.where("travel_time < 0").limit(1).count():
        raise ValueError("travel times must not be negative")
    e = materialise(edges.where("travel_time is not null").groupBy(F.col("u").alias("node"), F.col("v").alias("to")).agg(F.min("travel_time").alias("w")))
    best = materialise(sources.select(F.col("node").alias("src"), "node").distinct().withColumn("d", F.lit(0.0)))
    front = best
    while not front.isEmpty():
        step = front.join(e, "node").select("src", F.col("to").alias("node"), (F.col("d") + F.col("w")).alias("d")).where(F.col("d") <= cutoff)
        step = step.groupBy("src", "node").agg(F.min("d").alias("d"))
        front = materialise(step.join(best.withColumnRenamed("d", "old"), ["src", "node"], "left").where("old is null or d < old").select("src", "node", "d"))
        best = materialise(best.unionByName(front).groupBy("src", "node").agg(F.min("d").alias("d")))
    return best


def cell_neighbours(edges: DataFrame, cell_nodes: DataFrame, cutoff: float) -> DataFrame:
    """``i, j, travel_time_s`` between cells by way of their nodes (``cell, node``); paths are found once for each distinct node."""
    paths = cutoff_paths(edges, cell_nodes.select("node"), cutoff)
    a = cell_nodes.select(F.col("cell").alias("i"), F.col("node").alias("src"))
    b = cell_nodes.select(F.col("cell").alias("j"), "node")
    return paths.join(a, "src").join(b, "node").groupBy("i", "j").agg(F.min("d").alias("travel_time_s"))
