"""Point-of-interest features of cells: counts, counts by tag, least travel time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_features(tags: Mapping[str, object] | None) -> list[tuple[str, str | None]]:
    """(key, value or None) in sorted order: True asks for a key's presence, a list for each of its values; others are ignored."""
    asked = {str(k): [None] if v is True else [*map(str, v)] for k, v in (tags or {}).items() if v is True or isinstance(v, (list, tuple, set))}
    return sorted(((k, v) for k, values in asked.items() for v in values), key=lambda kv: (kv[0], kv[1] or ""))


def tag_filter(key: str, value: str | None) -> Column:
    return F.col(key).isNotNull() if value is None else F.coalesce(F.col(key).cast("string") == value, F.lit(False))


def feature_name(key: str, value: str | None) -> str:
    return key if value is None else f"{key}={value}"


def poi_counts(pois: DataFrame, cells: DataFrame, features: Sequence[tuple[str, str | None]] = ()) -> DataFrame:
    """``cell, poi_count`` and one count a feature, in one pass, 0 for cells without; keys the POIs lack are left out."""
    features = [(k, v) for k, v in features if k in pois.columns]
    names = ["poi_count", *(feature_name(k, v) for k, v in features)]
    aggs = [F.count(F.lit(1)).cast("double"), *(F.count_if(tag_filter(k, v)).cast("double") for k, v in features)]
    held = pois.groupBy("cell").agg(*[a.alias(n) for a, n in zip(aggs, names)])
    return cells.select("cell").join(held, "cell", "left").select("cell", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])


def min_travel_times(neighbours: DataFrame, masks: DataFrame, names: Sequence[str], default: float, *, suffix: str = "min_travel_time_s") -> DataFrame:
    """``cell`` and ``{name}_{suffix}``: least time to a cell whose mask is set, 0 where its own is, ``default`` if none is reached.

    ``masks``: ``cell`` and a boolean column a name, one row a cell. All masks share one join and one aggregate.
    """
    at = masks.select(F.col("cell").alias("j"), *[F.col(f"`{n}`").alias(f"__{k}") for k, n in enumerate(names)])
    own = masks.select(F.col("cell").alias("i"), *[F.col(f"`{n}`").alias(f"__own{k}") for k, n in enumerate(names)])
    least = neighbours.join(at, "j").groupBy("i").agg(*[F.min(F.when(F.col(f"__{k}"), F.col("travel_time_s"))).alias(f"__m{k}") for k in range(len(names))])
    values = [F.when(F.col(f"__own{k}"), 0.0).otherwise(F.coalesce(F.col(f"__m{k}"), F.lit(float(default)))).alias(f"{n}_{suffix}") for k, n in enumerate(names)]
    return own.join(least, "i", "left").select(F.col("i").alias("cell"), *values)


def poi_features(pois: DataFrame, cells: DataFrame, neighbours: DataFrame | None = None, tags: Mapping[str, object] | None = None, default: float = 900.0) -> DataFrame:
    """All features in order: ``poi_count``, least travel times (where neighbours are given), counts by tag."""
    features = [(k, v) for k, v in tag_features(tags) if k in pois.columns]
    counted = poi_counts(pois, cells, features)
    if neighbours is None:
        return counted
    names = ["poi_count", *(feature_name(k, v) for k, v in features)]
    prefixes = ["poi", *(f"poi_{n}" for n in names[1:])]
    masks = counted.select("cell", *[(F.col(f"`{n}`") > 0).alias(p) for n, p in zip(names, prefixes)])
    times = min_travel_times(neighbours, masks, prefixes, default)
    order = ["cell", "poi_count", *(c for c in times.columns if c != "cell"), *names[1:]]
    return counted.join(times, "cell").select(*[F.col(f"`{c}`") for c in order])
