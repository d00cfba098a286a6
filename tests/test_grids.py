import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.operators import spatial
from loomcast.sources import grids

SHAPE = spatial.GridShape(31, 402500.0, 5205000.0, 6, 4, 5000.0)


def test_shapes_from_arrays_and_tables(spark, tmp_path):
    cells = spatial.grid_cells(spark, SHAPE)
    rows = cells.orderBy("cell_id").collect()
    np.savez(tmp_path / "grid.npz", lat=[r["lat"] for r in rows], lon=[r["lon"] for r in rows], cell_size_m=5000.0)
    cells.withColumn("cell_size_m", F.lit(5000.0)).write.parquet(str(tmp_path / "cells.parquet"))
    for path in (tmp_path, tmp_path / "grid.npz", tmp_path / "cells.parquet"):
        g = grids.load_shape(spark, str(path))
        assert (g.nx, g.ny, g.size, g.zone) == (6, 4, 5000.0, 31) and abs(g.x0 - SHAPE.x0) < 1e-3 and abs(g.y0 - SHAPE.y0) < 1e-3
    np.savez(tmp_path / "bad.npz", lat=[1.0])
    with pytest.raises(ValueError, match="lon"):
        grids.load_shape(spark, str(tmp_path / "bad.npz"))
    with pytest.raises(FileNotFoundError):
        grids.load_shape(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="cell_size_m"):
        grids.of_table(cells)
    with pytest.raises(ValueError, match="differ"):
        grids.of_table(cells.withColumn("cell_size_m", F.col("cell_id").cast("double")))
