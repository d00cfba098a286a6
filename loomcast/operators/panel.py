"""Count panels: binning events by cell and day, dense frames, location order, splits."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.operators.rolling import once_per_id
from loomcast.session import materialise


def near_whole(x: Column) -> Column:
    """Whether x is a whole number but for rounding noise."""
    return F.abs(x - F.rint(x)) <= 1e-8 + 1e-5 * F.abs(F.rint(x))


def clean_events(events: DataFrame) -> DataFrame:
    """``cell, day, value``: each event once; dateless, negative and cell-less rows left out."""
    good = events.where("t <> DATE '1970-01-01' and value >= 0 and cell_id >= 0").select("event_id", "t", "cell_id", "value")
    return once_per_id(good, "event_id", ["cell_id", "t", "value"]).select(F.col("cell_id").alias("cell"), F.col("t").alias("day"), "value")


def counts(events: DataFrame, value: str | None = None) -> DataFrame:
    """``cell, day, y``: number of events, or sum of a column, by cell and day."""
    y = F.count(F.lit(1)) if value is None else F.sum(F.col(value).cast("bigint"))
    return events.groupBy("cell", "day").agg(y.alias("y"))


def dense_panel(sparse: DataFrame, cells: DataFrame) -> DataFrame:
    """``cell, t, y`` for every cell of ``cells`` and calendar day of ``sparse`` (t counts from its first day); absent pairs are 0.

    The frame is made from the cells and two dates, without a join of all with all; cells not in the frame are left out.
    """
    span = sparse.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    frame = cells.select("cell")
    lo, hi = span["lo"], span["hi"]
    days = F.sequence(F.lit(0), F.lit((hi - lo).days)) if lo else F.array().cast("array<int>")
    frame = frame.select("cell", F.explode(days).alias("t"), F.lit(0).cast("bigint").alias("y"))
    known = sparse.join(cells.select("cell"), "cell", "left_semi").select("cell", F.datediff("day", F.lit(lo)).alias("t"), "y")
    return frame.unionByName(known).groupBy("cell", "t").agg(F.sum("y").alias("y"))


def with_ordinal(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Adds ``out``: position from 0 in the order of ``columns`` (which identify a row), without gathering rows in one task.

    Rows are range-partitioned and checkpointed, numbered within partitions, and moved up by the sizes of earlier partitions;
    the driver sees one count a partition.
    """
    ranged = materialise(df.repartitionByRange(*columns).withColumn("__p", F.spark_partition_id()))
    sizes = sorted((r["__p"], r["count"]) for r in ranged.groupBy("__p").count().collect())
    moved = dict(zip([p for p, _ in sizes], [0, *accumulate(n for _, n in sizes)]))
    base = F.lit(0)
    if moved:
        base = F.create_map(*[F.lit(x) for item in moved.items() for x in item])[F.col("__p")]
    number = F.row_number().over(Window.partitionBy("__p").orderBy(*columns)) - 1 + base
    return ranged.withColumn(out, number.cast("int")).drop("__p")


def locations(readings: DataFrame) -> DataFrame:
    """``lon, lat, cell``: distinct locations numbered from 0 in order of (lon, lat)."""
    return with_ordinal(readings.groupBy("lon", "lat").agg(F.lit(1).alias("one")).select("lon", "lat"), ["lon", "lat"], "cell")


def observed_days(readings: DataFrame, day: str = "event_date") -> DataFrame:
    """``day, t``: days that occur, numbered from 0; gaps aren't filled."""
    return with_ordinal(readings.groupBy(F.col(day).alias("day")).agg(F.lit(1).alias("one")).select("day"), ["day"], "t")


def location_panel(readings: DataFrame, value: str | None) -> DataFrame:
    """``cell, t, y`` over all locations and observed days of ``event_date, lat, lon, fatalities``."""
    places, days = locations(readings), observed_days(readings)
    y = F.count(F.lit(1)) if value is None else F.sum(value)
    known = readings.groupBy("lon", "lat", F.col("event_date").alias("day")).agg(y.alias("y"))
    held = known.join(places, ["lon", "lat"]).join(days, "day").select("cell", "t", "y")
    n = days.count()
    frame = places.select("cell", F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")).alias("t"), F.lit(0).cast("bigint").alias("y"))
    return frame.unionByName(held).groupBy("cell", "t").agg(F.sum("y").alias("y"))


def densify_simulation(rows: DataFrame) -> DataFrame:
    """``location, time, y_true, y_obs`` for every location and time up to the last; absent pairs are 0, of repeated rows the
    greatest value holds, and a null observation becomes 0."""
    last = rows.agg(F.max("time").alias("hi")).first()["hi"]
    zero = F.lit(0).cast("bigint")
    times = F.sequence(zero, F.lit(last).cast("bigint")) if last is not None else F.array().cast("array<bigint>")
    frame = rows.where("location is not null").groupBy("location").agg(F.lit(1).alias("one")).select("location", F.explode(times).alias("time"), zero.alias("y_true"), zero.alias("y_obs"))
    both = frame.unionByName(rows.select("location", "time", F.coalesce("y_true", zero).alias("y_true"), F.coalesce("y_obs", zero).alias("y_obs")))
    return both.where("location is not null and time is not null").groupBy("location", "time").agg(F.max("y_true").alias("y_true"), F.max("y_obs").alias("y_obs"))


def split(panel: DataFrame, n_train: int, horizon: int) -> tuple[DataFrame, DataFrame]:
    return panel.where(F.col("t") < n_train), panel.where(F.col("t").between(n_train, n_train + horizon - 1))
