"""Rolling totals over trailing periods (problem 3).

Rows are reduced to sparse daily totals; after each active day the calendar adds rows for the quiet days up to the next one
(after the last, for a tail); range frames over the integer day number then give each trailing total, and averages divide by the period's fixed length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def once_per_id(events: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` of every event, each id once (of rows that disagree, the least of each column); rows without id all stay.

    Rows without id bypass the shuffle by id, where they would all meet in one task.
    """
    named = events.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.min(c).alias(c) for c in columns]).select(*columns)
    return named.unionByName(events.where(F.col(id_col).isNull()).select(*columns))


def daily_totals(events: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """``entity, day_no, total``: sparse, day_no in days since 1970-01-01. Rows with null entity or day are left out; null values add 0."""
    rows = events.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    return rows.groupBy(F.col(entity).alias("entity"), F.unix_date(F.col(day).cast("date")).alias("day_no")).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("total"))


def trailing_totals(daily: DataFrame, periods: Sequence[int], *, tail: int = 0) -> DataFrame:
    """``entity, on_day, total, total_{p}, avg_{p}`` for every calendar day from an entity's first day to ``tail`` days after its last.

    ``daily``: ``entity, day_no, total``, one row for each active day. A window ends with the day itself; days before
    the first count as zero and averages divide by the period's length. Days have been summed before, so an entity's
    rows number its calendar days at most, whatever its share of the events. The daily totals are read once and shuffled
    once, by entity. Empty input gives no rows.
    """
    base = Window.partitionBy("entity").orderBy("day_no")
    until = F.coalesce(F.lead("day_no").over(base) - 1, F.col("day_no") + F.lit(tail))
    active = daily.select("entity", "day_no", "total", until.alias("until"))
    days = active.select("entity", "day_no", "total", F.explode(F.sequence("day_no", "until")).alias("on"))
    out = days.select("entity", F.col("on").alias("day_no"), F.when(F.col("on") == F.col("day_no"), F.col("total")).otherwise(0).alias("total"))
    for p in periods:
        out = out.withColumn(f"total_{p}", F.sum("total").over(base.rangeBetween(-(p - 1), 0)))
    return out.select("entity", F.date_from_unix_date("day_no").alias("on_day"), "total", *[f"total_{p}" for p in periods], *[(F.col(f"total_{p}") / F.lit(float(p))).alias(f"avg_{p}") for p in periods])
