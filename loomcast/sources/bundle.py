"""Substrate bundles: grid, neighbours and points of interest built once, kept as Parquet with hashes of their content."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.functions import utm
from loomcast.operators import graph, poi, spatial
from loomcast.sources import files
from loomcast.sources.files import lines_hash, remove, write_text
from loomcast.sources.graph import from_network, read_graphml, read_pois

VERSION = 1
PARTS = ("grid", "neighbours", "poi", "graph_nodes", "graph_edges")


@dataclass(frozen=True)
class SubstrateConfig:
    graphml_path: str | None = None
    place: str | None = None
    bbox: tuple[float, float, float, float] | None = None
    cell_size_m: float = 250.0
    max_travel_time_s: float = 900.0
    poi_path: str | None = None
    poi_tags: Mapping[str, object] | None = None
    poi_travel_time_features: bool = False
    cache_dir: str | None = None


@dataclass
class Substrate:
    grid: DataFrame
    neighbours: DataFrame
    poi: DataFrame | None
    shape: spatial.GridShape
    meta: dict = field(default_factory=dict)


def content_hash(df: DataFrame) -> str:
    """Hash of a table's content, whatever the order and the files: the sum of the rows' hashes, with their number.

    Parquet bytes aren't stable, rows are; the sum needs one aggregate and no sort.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    digest = F.sha2(text, 256)
    halves = [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).cast("string").alias(f"h{k}") for k, h in enumerate(halves)]).first()
    return hashlib.sha256("\0".join([",".join(sorted(df.columns)), *map(str, row)]).encode()).hexdigest()


def created_at() -> str:
    """SOURCE_DATE_EPOCH, or 1970, so that bundles of equal content are equal."""
    return datetime.fromtimestamp(int(os.environ.get("SOURCE_DATE_EPOCH", "0")), UTC).isoformat()


def build(spark: SparkSession, config: SubstrateConfig) -> Substrate:
    """Load the bundle if the cache holds one made from the same configuration and content of its files, else build and keep it."""
    if config.graphml_path is None:
        from_network()
    sources = {p: lines_hash(spark, p) for p in (config.graphml_path, config.poi_path) if p}
    key = hashlib.sha256(json.dumps([asdict(config), sources], sort_keys=True, default=list).encode()).hexdigest()
    if config.cache_dir and exists(spark, config.cache_dir):
        held = load(spark, config.cache_dir)
        if held.meta["config_sha256"] == key:
            return held
    nodes, edges = read_graphml(spark, config.graphml_path)
    shape = spatial.grid_of_nodes(nodes, config.cell_size_m)
    cells = spatial.grid_cells(spark, shape)
    xy = utm.apply(cells.withColumnRenamed("cell_id", "cell"), utm.forward("lon", "lat", shape.zone, south=shape.south), ["u_x", "u_y"]).select("cell", F.col("u_x").alias("x"), F.col("u_y").alias("y"))
    node_xy = utm.apply(nodes.withColumnsRenamed({"x": "lon", "y": "lat"}), utm.forward("lon", "lat", shape.zone, south=shape.south), ["u_x", "u_y"]).select("node", F.col("u_x").alias("x"), F.col("u_y").alias("y"))
    near = graph.nearest_node(xy, node_xy, 4 * config.cell_size_m)
    neighbours = graph.cell_neighbours(graph.impute_travel_time(edges), near, config.max_travel_time_s).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "travel_time_s")
    features = None
    if config.poi_path:
        tags = [k for k, _ in poi.tag_features(config.poi_tags)]
        placed = spatial.nearest_cell(read_pois(spark, config.poi_path, tuple(dict.fromkeys(tags))), shape)
        ids = cells.select(F.col("cell_id").alias("cell"))
        features = poi.poi_features(placed, ids, neighbours if config.poi_travel_time_features else None, config.poi_tags, config.max_travel_time_s)
    out = Substrate(cells, neighbours, features, shape, {"config_sha256": key, "config": asdict(config), "provenance_sha256": sources})
    if config.cache_dir:
        save(out, config.cache_dir, nodes, edges)
        return load(spark, config.cache_dir)
    return out


def save(s: Substrate, path: str, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
    """Parquet folders and ``meta.json`` with the hashes; whatever the folder held of an earlier bundle is removed first."""
    spark = s.grid.sparkSession
    for name in PARTS:
        remove(spark, f"{path}/{name}")
    hashes = {}
    for name, df, order in (("grid", s.grid, ["cell_id"]), ("neighbours", s.neighbours, ["i", "j"]), ("poi", s.poi, ["cell"]), ("graph_nodes", nodes, ["node"]), ("graph_edges", edges, ["u", "v"])):
        if df is not None:
            df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")
            hashes[name] = content_hash(spark.read.parquet(f"{path}/{name}"))
    whole = hashlib.sha256("".join(f"{n}\0{h}\0" for n, h in sorted(hashes.items())).encode()).hexdigest()
    meta = {"version": VERSION, "created_at": created_at(), "shape": asdict(s.shape), "files": hashes, "bundle_sha256": whole, **s.meta}
    write_text(spark, f"{path}/meta.json", json.dumps(meta, sort_keys=True, default=list))


def exists(spark: SparkSession, path: str) -> bool:
    return all(files.exists(spark, f"{path}/{p}") for p in ("meta.json", "grid", "neighbours"))


def load(spark: SparkSession, path: str) -> Substrate:
    meta = json.loads(files.read_bytes(spark, f"{path}/meta.json"))
    if meta["version"] != VERSION:
        raise ValueError(f"bundle version {meta['version']} isn't {VERSION}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Substrate(read("grid"), read("neighbours"), read("poi") if "poi" in meta["files"] else None, spatial.GridShape(**meta["shape"]), meta)
