"""Road graphs from GraphML and points of interest from GeoJSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``nodes(node, x, y)`` and ``edges(u, v, length, travel_time, highway)`` of a GraphML file, read in splits by the executors.

    Only the declared attributes, a handful, reach the driver. An undirected graph's edges are doubled. Nodes without
    coordinates raise ValueError.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    names = read("key", "_id string, `_attr.name` string").select("_id", F.col("`_attr.name`").alias("name")).where("_id is not null").collect()
    head = spark.read.text(path).where(F.col("value").contains("<graph ")).select(F.regexp_extract("value", r"<graph [^>]*edgedefault=\"(\w+)\"", 1)).first()
    data = "data array<struct<_key string, _VALUE string>>"

    def held(name: str):  # noqa: ANN202
        keys = [name, *[r["_id"] for r in names if r["name"] == name]]
        return F.get(F.filter("data", lambda d: d["_key"].isin(keys)), F.lit(0))["_VALUE"]

    nodes = read("node", f"_id string, {data}").select(F.col("_id").alias("node"), held("x").cast("double").alias("x"), held("y").cast("double").alias("y"))
    if lost := nodes.where("x is null or y is null").first():
        raise ValueError(f"node {lost['node']} has no coordinates")
    edges = read("edge", f"_source string, _target string, {data}").select(F.col("_source").alias("u"), F.col("_target").alias("v"), held("length").cast("double").alias("length"), held("travel_time").cast("double").alias("travel_time"), held("highway").alias("highway"))
    if head and head[0] == "undirected":
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length", "travel_time", "highway"))
    return nodes, edges


def from_network(*_: object, **__: object) -> None:
    """Downloads of road graphs or points by place or box need a network and are not offered."""
    raise NotImplementedError("road graphs and points must be given as files: this build makes no network requests")


def read_pois(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``lon, lat`` and the properties ``keys`` of a GeoJSON file's features; other geometries count at the mean of their corners.

    Features without coordinates are left out; missing properties are null.
    """
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.features", "array<variant>")).alias("f"))
    corners = F.try_variant_get("f", "$.geometry.coordinates", "string")
    numbers = F.transform(F.regexp_extract_all(corners, F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*-?[0-9.eE+-]+"), 1), lambda x: x.cast("double"))
    second = F.transform(F.regexp_extract_all(corners, F.lit(r"\[\s*-?[0-9.eE+-]+\s*,\s*(-?[0-9.eE+-]+)"), 1), lambda x: x.cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    props = [F.try_variant_get("f", f"$.properties.{json.dumps(k)[1:-1]}", "string").alias(k) for k in keys]
    return doc.select(mean(numbers).alias("lon"), mean(second).alias("lat"), *props).where("lon is not null and lat is not null")
