"""A grid's shape from whatever holds one: a bundle, an ``.npz`` of centroids, or a table of cells."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomcast.operators import spatial
from loomcast.sources import bundle, files


def load_shape(spark: SparkSession, path: str) -> spatial.GridShape:
    """Shape of the grid at ``path``.

    A folder with ``meta.json`` is a bundle; an ``.npz`` file, or a folder with ``grid.npz``, holds ``lat``, ``lon`` and
    ``cell_size_m`` in the order of the cells; anything else is Parquet with ``cell_id``, ``lat``, ``lon``, ``cell_size_m``.
    FileNotFoundError if there is nothing, ValueError if keys are missing or the cells fill no rectangle.
    """
    path = path.rstrip("/")
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    if files.exists(spark, f"{path}/meta.json"):
        return bundle.load(spark, path).shape
    if files.exists(spark, f"{path}/grid.npz"):
        path = f"{path}/grid.npz"
    if path.endswith(".npz"):
        held = np.load(io.BytesIO(files.read_bytes(spark, path)))
        if missing := [k for k in ("lat", "lon", "cell_size_m") if k not in held]:
            raise ValueError(f"{path} has no {missing}")
        lat, lon = held["lat"].ravel().tolist(), held["lon"].ravel().tolist()
        cells = spark.createDataFrame([*zip(range(len(lat)), lat, lon)], "cell_id int, lat double, lon double")
        return spatial.recover_grid(cells, float(held["cell_size_m"].ravel()[0]))
    return of_table(spark.read.parquet(path))


def of_table(cells: DataFrame) -> spatial.GridShape:
    if missing := [c for c in ("cell_id", "lat", "lon", "cell_size_m") if c not in cells.columns]:
        raise ValueError(f"the table has no {missing}")
    sizes = cells.select("cell_size_m").distinct().limit(2).collect()
    if len(sizes) != 1:
        raise ValueError("the cells differ in size")
    return spatial.recover_grid(cells, float(sizes[0][0]))
