"""Regular UTM grids: building, recovering shape, point to cell."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.functions import utm


@dataclass(frozen=True)
class GridShape:
    """Lower left corner in metres of one UTM zone, cells a side, cell size. Zone and origin stay with the grid, so that
    grids which touch a zone's edge are built and looked up alike."""

    zone: int
    x0: float
    y0: float
    nx: int
    ny: int
    size: float
    south: bool = False

    @property
    def epsg(self) -> str:
        return f"EPSG:{(32700 if self.south else 32600) + self.zone}"


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of a position's zone; longitude 180 gives zone 61, which isn't a zone, as the plain formula does."""
    return F.concat(F.lit("EPSG:"), (F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6) + 1).cast("int").cast("string"))


def _extent(lon0: float, lat0: float, lon1: float, lat1: float) -> tuple[int, bool, float, float, float, float]:
    """Zone of a box's centre, and the box between its projected lower left and upper right corners."""
    zone, south = utm.zone_of((lon0 + lon1) / 2), (lat0 + lat1) / 2 < 0
    (xa, ya), (xb, yb) = project(lon0, lat0, zone, south), project(lon1, lat1, zone, south)
    return zone, south, min(xa, xb), min(ya, yb), max(xa, xb), max(ya, yb)


def grid_of_bounds(lon0: float, lat0: float, lon1: float, lat1: float, size: float) -> GridShape:
    """Grid over a box: as many whole steps as put a centroid before the far edge."""
    if size <= 0:
        raise ValueError("cell size must be positive")
    zone, south, x0, y0, x1, y1 = _extent(lon0, lat0, lon1, lat1)
    nx, ny = (math.ceil((hi - lo - size / 2) / size) for lo, hi in ((x0, x1), (y0, y1)))
    if min(nx, ny) <= 0:
        raise ValueError("the bounds are smaller than a cell")
    return GridShape(zone, x0, y0, nx, ny, size, south)


def grid_of_nodes(nodes: DataFrame, size: float) -> GridShape:
    """Grid over the box of road nodes ``x`` (lon), ``y`` (lat): whole steps that cover it, at least one cell a side."""
    b = nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    zone, south, x0, y0, x1, y1 = _extent(*b)
    return GridShape(zone, x0, y0, max(1, math.ceil((x1 - x0) / size)), max(1, math.ceil((y1 - y0) / size)), size, south)


def project(lon: float, lat: float, zone: int, south: bool = False) -> tuple[float, float]:
    """The forward series in plain Python, for the few corners of a grid."""
    e = math.sqrt(utm.FLATTENING * (2 - utm.FLATTENING))
    s, d = math.sin(math.radians(lat)), math.radians(lon - (6 * zone - 183))
    t = math.sinh(math.atanh(s) - e * math.atanh(e * s))
    xi, eta = math.atan2(t, math.cos(d)), math.asinh(math.sin(d) / math.hypot(t, math.cos(d)))
    k = utm.SCALE * utm.RECTIFYING_M
    x = k * (eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(utm.ALPHA, 1)))
    y = k * (xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(utm.ALPHA, 1)))
    return utm.FALSE_EASTING + x, y + (utm.FALSE_NORTHING if south else 0.0)


def grid_cells(spark: SparkSession, g: GridShape) -> DataFrame:
    """``cell_id, ix, iy, lat, lon``: centroids, numbered row by row from the lower left."""
    cells = spark.range(g.nx * g.ny).select(F.col("id").cast("int").alias("cell_id"), (F.col("id") % g.nx).cast("int").alias("ix"), F.floor(F.col("id") / g.nx).cast("int").alias("iy"))
    cells = cells.withColumns({"x": F.lit(g.x0) + (F.col("ix") + 0.5) * g.size, "y": F.lit(g.y0) + (F.col("iy") + 0.5) * g.size})
    out = utm.apply(cells, utm.inverse("x", "y", g.zone, south=g.south), ["g_lat", "g_lon"])
    return out.select("cell_id", "ix", "iy", F.col("g_lat").alias("lat"), F.col("g_lon").alias("lon"))


def recover_grid(cells: DataFrame, size: float, zone: int | None = None, south: bool = False) -> GridShape:
    """Shape of a grid given by its centroids ``cell_id, lat, lon``; ValueError unless they fill a rectangle row by row.

    One aggregate over the projected centroids; a single cell can't show a shape and is refused.
    """
    if zone is None:
        m = cells.agg(F.avg("lon"), F.avg("lat")).first()
        zone, south = utm.zone_of(m[0]), m[1] < 0
    xy = utm.apply(cells, utm.forward("lon", "lat", zone, south=south), ["u_x", "u_y"])
    b = xy.agg(F.count(F.lit(1)), F.min("u_x"), F.min("u_y"), F.max("u_x"), F.max("u_y")).first()
    if b[0] < 2:
        raise ValueError("a grid needs two cells at least")
    nx, ny = round((b[3] - b[1]) / size) + 1, round((b[4] - b[2]) / size) + 1
    place = F.rint((F.col("u_y") - b[2]) / size) * nx + F.rint((F.col("u_x") - b[1]) / size)
    off = F.greatest(F.abs((F.col("u_x") - b[1]) / size - F.rint((F.col("u_x") - b[1]) / size)), F.abs((F.col("u_y") - b[2]) / size - F.rint((F.col("u_y") - b[2]) / size)))
    seen = xy.agg(F.count_distinct("cell_id"), F.count_if(place != F.col("cell_id")), F.max(off)).first()
    if nx * ny != b[0] or seen[0] != b[0] or seen[1] or seen[2] > 1e-3:
        raise ValueError("the cells are no full rectangular grid")
    return GridShape(zone, b[1] - size / 2, b[2] - size / 2, nx, ny, size, south)


def cell_sql(g: GridShape, x: str, y: str) -> str:
    """Cell of a projected point as SQL text, -1 outside; left and lower edges belong to the cell, right and upper don't."""
    n = utm.num
    inside = f"{x} >= {n(g.x0)} AND {x} < {n(g.x0 + g.nx * g.size)} AND {y} >= {n(g.y0)} AND {y} < {n(g.y0 + g.ny * g.size)}"
    return f"CAST(CASE WHEN {inside} THEN floor(({y} - {n(g.y0)}) / {n(g.size)}) * {g.nx} + floor(({x} - {n(g.x0)}) / {n(g.size)}) ELSE -1 END AS INT)"


def point_to_cell(df: DataFrame, g: GridShape, lon: str = "lon", lat: str = "lat", out: str = "cell") -> DataFrame:
    """Adds ``out`` by column arithmetic alone; null, NaN and out-of-range positions give -1."""
    ok = f"abs({lat}) <= 90 and abs({lon}) <= 180"
    guarded = df.withColumns({"__lo": F.expr(f"case when {ok} then {lon} end"), "__la": F.expr(f"case when {ok} then {lat} end")})
    xy = utm.apply(guarded, utm.forward("__lo", "__la", g.zone, south=g.south), ["u_x", "u_y"])
    return xy.withColumn(out, F.expr(cell_sql(g, "u_x", "u_y"))).drop("__lo", "__la", "u_x", "u_y")


def nearest_cell_sql(g: GridShape, x: str, y: str) -> str:
    """Cell of the nearest centroid: on a regular grid the clamped column and row."""
    n = utm.num
    ix = f"least({g.nx - 1}, greatest(0, floor(({x} - {n(g.x0)}) / {n(g.size)})))"
    iy = f"least({g.ny - 1}, greatest(0, floor(({y} - {n(g.y0)}) / {n(g.size)})))"
    return f"CAST({iy} * {g.nx} + {ix} AS INT)"


def nearest_cell(df: DataFrame, g: GridShape, lon: str = "lon", lat: str = "lat", out: str = "cell") -> DataFrame:
    xy = utm.apply(df, utm.forward(lon, lat, g.zone, south=g.south), ["u_x", "u_y"])
    return xy.withColumn(out, F.expr(nearest_cell_sql(g, "u_x", "u_y"))).drop("u_x", "u_y")
