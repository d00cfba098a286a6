"""Canonical events: a strict schema, row checks as column expressions, and table checks as one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = (("t", T.DateType()), ("lat", T.DoubleType()), ("lon", T.DoubleType()), ("value", T.LongType()))
OPTIONAL = (("event_id", T.StringType()), ("cell_id", T.IntegerType()), ("mark", T.StringType()), ("meta_json", T.StringType()))
EVENTS = T.StructType([T.StructField(n, k) for n, k in (*REQUIRED, *OPTIONAL)])


def check_schema(df: DataFrame) -> DataFrame:
    """``df`` itself if it has the required columns, then any optional ones, in order and of the exact types; else ValueError."""
    have = {f.name: f.dataType for f in df.schema.fields}
    allowed = [n for n, _ in (*REQUIRED, *OPTIONAL)]
    if missing := [n for n, _ in REQUIRED if n not in have]:
        raise ValueError(f"missing columns: {missing}")
    if extra := [n for n in df.columns if n not in allowed]:
        raise ValueError(f"columns not allowed: {extra}")
    for name, kind in (*REQUIRED, *OPTIONAL):
        if name in have and have[name] != kind:
            raise ValueError(f"column {name} must be {kind.simpleString()}, not {have[name].simpleString()}")
    if df.columns != [n for n in allowed if n in have]:
        raise ValueError(f"columns must be in the order {allowed}")
    return df


def rules() -> dict[str, Column]:
    """Each rule's name and the condition under which a row breaks it; nulls in optional columns break none."""
    inside = lambda c, most: F.col(c).isNotNull() & (F.abs(c) <= most)  # NaN and infinities exceed any bound
    return {
        "t": F.col("t").isNull(),
        "lat": ~inside("lat", 90),
        "lon": ~inside("lon", 180),
        "value": F.col("value").isNull() | (F.col("value") < 0),
        "event_id": F.coalesce(F.col("event_id") == "", F.lit(False)),
        "cell_id": F.coalesce(F.col("cell_id") < 0, F.lit(False)),
        "mark": F.coalesce(F.col("mark") == "", F.lit(False)),
        "meta": F.col("meta_json").isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json("meta_json")).startswith("OBJECT"), F.lit(False)),
    }


def with_errors(df: DataFrame) -> DataFrame:
    """Adds ``error``: the first rule a row breaks, or null."""
    return df.withColumn("error", F.coalesce(*[F.when(bad, name) for name, bad in rules().items()]))


def error_counts(df: DataFrame) -> DataFrame:
    """One row: how many rows break each rule, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(bad).alias(f"bad_{name}") for name, bad in rules().items()])


def require_valid(df: DataFrame) -> DataFrame:
    """``df`` itself; ValueError if it has no rows or any row breaks a rule."""
    counts = error_counts(df).first().asDict()
    if not counts.pop("n_rows"):
        raise ValueError("there are no events")
    if bad := {k: v for k, v in counts.items() if v}:
        raise ValueError(f"invalid events: {bad}")
    return df


def canonical(df: DataFrame) -> DataFrame:
    """Optional columns that are all null are dropped (ids and cells only); cell -1 becomes null; order as required."""
    df = df.withColumn("cell_id", F.when(F.col("cell_id") >= 0, F.col("cell_id")))
    held = df.agg(F.count("event_id").alias("event_id"), F.count("cell_id").alias("cell_id")).first()
    drop = [c for c in ("event_id", "cell_id") if held[c] == 0]
    return df.select(*[n for n, _ in (*REQUIRED, *OPTIONAL) if n not in drop])
