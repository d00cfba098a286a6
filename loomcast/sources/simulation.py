"""Simulated panels with their parameters: long Parquet beside a JSON sidecar; JSON configurations."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomcast.operators import panel
from loomcast.sources import files

SCHEMA_NAME = "long-v1"


def save_simulation(rows: DataFrame, path: str, world: dict, params: dict) -> None:
    """``location, time, y_true, y_obs`` as Parquet; world and parameters as JSON in ``_meta.json`` (floats round-trip exactly)."""
    rows.select("location", "time", "y_true", "y_obs").sortWithinPartitions("location", "time").write.mode("overwrite").parquet(path)
    files.write_text(rows.sparkSession, f"{path}/_meta.json", json.dumps({"schema": SCHEMA_NAME, "world": world, "params": params}, sort_keys=True))


def load_simulation(spark: SparkSession, path: str) -> tuple[DataFrame, dict, dict]:
    """Dense ``location, time, y_true, y_obs`` (absent pairs 0), world, parameters."""
    if not files.exists(spark, f"{path}/_meta.json"):
        raise ValueError("the simulation has no world and params")
    held = json.loads(files.read_bytes(spark, f"{path}/_meta.json"))
    return panel.densify_simulation(spark.read.parquet(path)), held["world"], held["params"]


def config_from_json(kind: type, path: str):  # noqa: ANN201
    """A dataclass from a JSON object; unknown keys raise TypeError."""
    return kind(**json.loads(Path(path).read_text()))


def to_json(config) -> str:  # noqa: ANN001
    return json.dumps(dataclasses.asdict(config), sort_keys=True)
