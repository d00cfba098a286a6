"""Queries for every modelling operator over whole tables, and equal SQL.

The event tables play the raw events, grid_cells and road_neighbours the substrate, sim_counts a simulated panel,
acled_small the event CSV, suppliers the points of interest (at coordinates derived from their keys).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast import schema
from loomcast.functions import stats, utm
from loomcast.functions.utm import num
from loomcast.operators import evaluate, fit, graph, intensity, likelihood, marks, panel, poi, roadfit, simulate, spatial
from loomcast.session import materialise, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KERNEL = (0.55, 0.30, 0.15)
ROAD_BETA, ALPHA, DISPERSION, CUTOFF_S, HORIZON, TRAIN_STEPS = 1.2e-3, 0.05, 4.0, 900.0, 4, 120
MU_SQL = "(0.05e0 + 0.01e0 * (cell % 7))"
P_DETECT, FALSE_RATE = 0.8, 0.3
GRID = spatial.GridShape(31, 402500.0, 5205000.0, 40, 30, 5000.0)
SECONDS = np.array([[0.0, 300.0, 900.0], [300.0, 0.0, 600.0], [900.0, 600.0, 0.0]])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- shared pieces: the panel, its history, weights, intensities -----------------


def _panel(spark: SparkSession, data: str) -> DataFrame:
    events = panel.clean_events(table(spark, data, "events_roundtrip"))
    return panel.dense_panel(panel.counts(events, "value"), table(spark, data, "grid_cells").select(F.col("cell_id").alias("cell")))


def _neighbours(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "road_neighbours")


def _mu() -> Column:
    return F.expr(MU_SQL)


def _road(spark: SparkSession, data: str) -> DataFrame:
    return intensity.in_sample(_panel(spark, data), intensity.road_weights(_neighbours(spark, data), ROAD_BETA), KERNEL, _mu(), ALPHA)


def _simulated(spark: SparkSession, data: str) -> DataFrame:
    return panel.densify_simulation(table(spark, data, "sim_counts"))


def _mobility(spark: SparkSession, data: str) -> DataFrame:
    """Radial weights between the locations 0..n-1 of sim_counts on a lattice, rows normalised: a dense matrix by definition, its columns unrolled from n."""
    held = table(spark, data, "sim_counts").where("location is not null").groupBy("location").agg(F.lit(1).alias("one"))
    n = held.agg(F.max("location")).first()[0]
    i, j = F.col("i"), F.col("j")
    pairs = spark.range(n + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n))).alias("j"))
    d2 = F.pow((i % 4 - j % 4) / 4.0, 2) + F.pow((F.floor(i / 4) - F.floor(j / 4)) / 4.0, 2)
    for end in ("i", "j"):
        pairs = pairs.join(held.select(F.col("location").alias(end)), end, "left_semi")
    w = pairs.withColumn("w", stats.rbf(d2, 0.5))
    return w.join(w.groupBy("i").agg(F.sum("w").alias("s")), "i").select("i", "j", (F.col("w") / F.col("s")).alias("w"))


def _sim_panel(spark: SparkSession, data: str, y: str = "y_true") -> DataFrame:
    return _simulated(spark, data).select(F.col("location").alias("cell"), F.col("time").alias("t"), F.col(y).alias("y"))


def _mobile(spark: SparkSession, data: str) -> DataFrame:
    return intensity.in_sample(_sim_panel(spark, data), _mobility(spark, data), KERNEL, F.lit(0.4), 0.3)


def _logfact(y: str) -> str:
    return f"lgamma({y} + 1)"


_PANEL = """WITH good AS (SELECT event_id, t, cell_id, value FROM events_roundtrip WHERE t <> DATE '1970-01-01' AND value >= 0 AND cell_id >= 0),
once AS (SELECT min(cell_id) AS cell, min(t) AS day, min(value) AS value FROM good WHERE event_id IS NOT NULL GROUP BY event_id
  UNION ALL SELECT cell_id, t, value FROM good WHERE event_id IS NULL),
cnt AS (SELECT cell, day, CAST(sum(value) AS BIGINT) AS y FROM once GROUP BY cell, day),
span AS (SELECT min(day) AS lo, max(day) AS hi FROM cnt),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
panel AS MATERIALIZED (SELECT g.cell_id AS cell, CAST(d.day - s.lo AS INT) AS t, coalesce(c.y, 0) AS y FROM grid_cells g CROSS JOIN days d CROSS JOIN span s LEFT JOIN cnt c ON c.cell = g.cell_id AND c.day = d.day)"""
_HIST = " + ".join(f"{num(g)} * coalesce(lag(y, {k}) OVER w, 0)" for k, g in enumerate(KERNEL, 1))
_W = f"""nb AS (SELECT i, j, exp(-{num(ROAD_BETA)} * travel_time_s) AS w FROM road_neighbours WHERE i <> j UNION ALL SELECT i, i, 1e0 FROM (SELECT i FROM road_neighbours UNION SELECT j FROM road_neighbours))"""
_ROAD = f"""{_PANEL}, h AS MATERIALIZED (SELECT cell, t, y, {_HIST} AS h FROM panel WINDOW w AS (PARTITION BY cell ORDER BY t)), {_W},
ex AS (SELECT nb.i AS cell, h.t, sum(nb.w * h.h) AS x FROM nb JOIN h ON nb.j = h.cell WHERE h.h <> 0 GROUP BY nb.i, h.t),
lam AS (SELECT h.cell, h.t, h.y, h.h, coalesce(ex.x, 0) AS x, greatest({MU_SQL.replace("cell", "h.cell")} + {num(ALPHA)} * coalesce(ex.x, 0), 0) AS lam FROM h LEFT JOIN ex ON ex.cell = h.cell AND ex.t = h.t)"""
_SIM = """WITH sim AS (SELECT l.location, s.time, coalesce(v.y_true, 0) AS y_true, coalesce(v.y_obs, 0) AS y_obs
  FROM (SELECT DISTINCT location FROM sim_counts WHERE location IS NOT NULL) l CROSS JOIN (SELECT unnest(generate_series(0, max(time))) AS time FROM sim_counts) s
  LEFT JOIN (SELECT location, time, max(coalesce(y_true, 0)) AS y_true, max(coalesce(y_obs, 0)) AS y_obs FROM sim_counts GROUP BY location, time) v ON v.location = l.location AND v.time = s.time)"""
_MOB = """locs AS (SELECT DISTINCT location, location % 4 / 4e0 AS x, (location // 4) / 4e0 AS y FROM sim_counts WHERE location IS NOT NULL),
raw AS (SELECT a.location AS i, b.location AS j, exp(-0.5e0 * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 0.25e0) AS w FROM locs a CROSS JOIN locs b),
mob AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM raw)"""
_MOBILE = f"""{_SIM}, {_MOB}, p AS (SELECT location AS cell, time AS t, y_true AS y FROM sim), h AS (SELECT cell, t, y, {_HIST} AS h FROM p WINDOW w AS (PARTITION BY cell ORDER BY t)),
ex AS (SELECT i AS cell, t, sum(w * h) AS x FROM mob JOIN h ON mob.j = h.cell GROUP BY i, t),
lam AS (SELECT h.cell, h.t, h.y, h.h, ex.x, greatest(0.4e0 + 0.3e0 * ex.x, 0) AS lam FROM h JOIN ex ON ex.cell = h.cell AND ex.t = h.t)"""
_POIS = f"y * ln(greatest(lam, 1e-12)) - greatest(lam, 1e-12) - {_logfact('y')}"
_NB = f"lgamma(y + {num(DISPERSION)}) - lgamma({num(DISPERSION)}) - {_logfact('y')} + {num(DISPERSION)} * (ln({num(DISPERSION)}) - ln({num(DISPERSION)} + lam)) + y * (ln(lam) - ln({num(DISPERSION)} + lam))"


# --- events ------------------------------------------------------------------------


def _raw_events(spark: SparkSession, data: str) -> DataFrame:
    u = F.col("user_id")
    lon, lat = F.lit(-0.5) + F.lit(0.4) * (u * 37 % 1000) / F.lit(1000.0), F.lit(51.4) + F.lit(0.2) * (u * 91 % 1000) / F.lit(1000.0)
    return table(spark, data, "events").select(F.to_date("ts").alias("t"), lat.alias("lat"), lon.alias("lon"), F.floor("value").cast("bigint").alias("value"), F.col("event_id").cast("string").alias("event_id"), (u % 25).cast("int").alias("cell_id"), F.col("event_type").alias("mark"), F.col("props").alias("meta_json"))


@query("""SELECT CAST(ts AS DATE) AS t, round(51.4e0 + 0.2e0 * (user_id * 91 % 1000) / 1000e0, 9) AS lat, round(-0.5e0 + 0.4e0 * (user_id * 37 % 1000) / 1000e0, 9) AS lon, CAST(floor(value) AS BIGINT) AS value,
 CAST(event_id AS VARCHAR) AS event_id, CAST(user_id % 25 AS INT) AS cell_id, event_type AS mark, props AS meta_json FROM events""")
def canonical_events(spark: SparkSession, data: str) -> DataFrame:
    """Canonical columns in order; the schema gate S4 applies."""
    return rounded(schema.check_schema(schema.canonical(_raw_events(spark, data))), "lat", "lon", digits=9)


_FAULTS = {
    "t": "t IS NULL",
    "lat": "lat IS NULL OR isnan(lat) OR abs(lat) > 90",
    "lon": "lon IS NULL OR isnan(lon) OR abs(lon) > 180",
    "value": "value IS NULL OR value < 0",
    "event_id": "coalesce(event_id = '', false)",
    "cell_id": "coalesce(cell_id < 0, false)",
    "mark": "coalesce(mark = '', false)",
    "meta": "meta_json IS NOT NULL AND NOT coalesce(CASE WHEN json_valid(meta_json) THEN json_type(meta_json) = 'OBJECT' END, false)",
}
_FLAG = "CASE " + " ".join(f"WHEN {bad} THEN '{name}'" for name, bad in _FAULTS.items()) + " END"


@query(f"SELECT event_id, t, {_FLAG} AS error FROM events_roundtrip")
def event_quality_flags(spark: SparkSession, data: str) -> DataFrame:
    """The first rule each row breaks."""
    return schema.with_errors(table(spark, data, "events_roundtrip")).select("event_id", "t", "error")


@query("SELECT count(*) AS n_rows, " + ", ".join(f"count(*) FILTER ({bad}) AS bad_{name}" for name, bad in _FAULTS.items()) + " FROM events_roundtrip")
def invalid_event_counts(spark: SparkSession, data: str) -> DataFrame:
    """Rows that break each rule, in one pass."""
    return schema.error_counts(table(spark, data, "events_roundtrip"))


_OK = "abs(lat) <= 90 AND abs(lon) <= 180 AND NOT isnan(lat) AND NOT isnan(lon)"
_XY = utm.nested_sql(f"(SELECT *, CASE WHEN {_OK} THEN lat END AS la, CASE WHEN {_OK} THEN lon END AS lo FROM events_roundtrip) AS e", utm.forward("lo", "la", GRID.zone))


@query(f"SELECT event_id, t, {spatial.cell_sql(GRID, 'u_x', 'u_y')} AS cell FROM {_XY}")
def point_to_cell(spark: SparkSession, data: str) -> DataFrame:
    """Cell of every event by column arithmetic, -1 outside."""
    return spatial.point_to_cell(table(spark, data, "events_roundtrip").select("event_id", "t", "lat", "lon"), GRID).select("event_id", "t", "cell")


@query(f"SELECT cell, count(*) AS n FROM (SELECT {spatial.cell_sql(GRID, 'u_x', 'u_y')} AS cell FROM {_XY}) WHERE cell >= 0 GROUP BY cell")
def events_inside_grid(spark: SparkSession, data: str) -> DataFrame:
    """P5: events inside the grid, counted by cell."""
    return point_to_cell(spark, data).where("cell >= 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT t, CAST(sum(value) AS BIGINT) AS total FROM events_roundtrip GROUP BY t")
def daily_value_sum(spark: SparkSession, data: str) -> DataFrame:
    """A4: sum of value by day."""
    return table(spark, data, "events_roundtrip").groupBy("t").agg(F.sum("value").alias("total"))


@query(f"{_PANEL} SELECT cell, t, y FROM panel")
def panel_sums(spark: SparkSession, data: str) -> DataFrame:
    """Dense panel of summed values."""
    return _panel(spark, data)


@query(_PANEL.replace("CAST(sum(value) AS BIGINT) AS y", "count(*) AS y") + " SELECT cell, t, y FROM panel")
def panel_counts(spark: SparkSession, data: str) -> DataFrame:
    """Dense panel of event counts."""
    events = panel.clean_events(table(spark, data, "events_roundtrip"))
    return panel.dense_panel(panel.counts(events), table(spark, data, "grid_cells").select(F.col("cell_id").alias("cell")))


_READ = "SELECT trim(event_date, ' ')[1:10] AS event_date, lat, lon, fatalities FROM acled_small WHERE NOT isnan(lat) AND NOT isnan(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND fatalities >= 0 AND event_date IS NOT NULL"
_READ = f"SELECT event_date, round(lat, 4) + 0e0 AS lat, round(lon, 4) + 0e0 AS lon, fatalities FROM ({_READ})"


def _readings(spark: SparkSession, data: str) -> DataFrame:
    rows = table(spark, data, "acled_small").where("lat between -90 and 90 and lon between -180 and 180 and fatalities >= 0 and event_date is not null")
    day = F.substring(F.btrim("event_date", F.lit(" ")), 1, 10)
    return rows.select(day.alias("event_date"), (F.round("lat", 4) + F.lit(0.0)).alias("lat"), (F.round("lon", 4) + F.lit(0.0)).alias("lon"), "fatalities")


_LOC = "SELECT lon, lat, CAST(row_number() OVER (ORDER BY lon, lat) - 1 AS INT) AS cell FROM (SELECT DISTINCT lon, lat FROM r)"


@query(f"WITH r AS ({_READ}) {_LOC}")
def location_index(spark: SparkSession, data: str) -> DataFrame:
    """Locations numbered in order of (lon, lat)."""
    return panel.locations(_readings(spark, data))


@query(f"""WITH r AS ({_READ}), l AS ({_LOC}), d AS (SELECT event_date AS day, CAST(row_number() OVER (ORDER BY event_date) - 1 AS INT) AS t FROM (SELECT DISTINCT event_date FROM r)),
v AS (SELECT lon, lat, event_date AS day, sum(fatalities) AS y FROM r GROUP BY ALL)
SELECT l.cell, d.t, CAST(coalesce(v.y, 0) AS BIGINT) AS y FROM l CROSS JOIN d LEFT JOIN v ON v.lon = l.lon AND v.lat = l.lat AND v.day = d.day""")
def location_panel(spark: SparkSession, data: str) -> DataFrame:
    """Fatalities by location and observed day, dense."""
    return panel.location_panel(_readings(spark, data), "fatalities")


@query(f"{_PANEL} SELECT cell, round(avg(y), 9) AS rate FROM panel GROUP BY cell")
def location_mean_rate(spark: SparkSession, data: str) -> DataFrame:
    """Mean count by cell."""
    return _panel(spark, data).groupBy("cell").agg(F.round(F.avg("y"), 9).alias("rate"))


@query(f"{_PANEL} SELECT CASE WHEN t < {TRAIN_STEPS} THEN 'train' ELSE 'test' END AS part, cell, CAST(sum(y) AS BIGINT) AS y FROM panel WHERE t < {TRAIN_STEPS + 7} GROUP BY ALL")
def train_test_split(spark: SparkSession, data: str) -> DataFrame:
    """Time split, summed by cell."""
    train, test = panel.split(_panel(spark, data), TRAIN_STEPS, 7)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "cell").agg(F.sum("y").alias("y"))


@query(f"{_SIM} SELECT location, time, y_true, y_obs FROM sim")
def simulation_table(spark: SparkSession, data: str) -> DataFrame:
    """Simulated panel with absent pairs as 0."""
    return _simulated(spark, data)


@query("SELECT o_custkey % 25 AS cell, CAST(count(*) AS BIGINT) AS whole, CAST(count(*) FILTER (abs(o_totalprice - round_even(o_totalprice, 0)) > 1e-8 + 1e-5 * abs(round_even(o_totalprice, 0))) AS BIGINT) AS fractional FROM orders GROUP BY 1")
def whole_number_check(spark: SparkSession, data: str) -> DataFrame:
    """Values that aren't whole numbers but for rounding noise."""
    v = F.col("o_totalprice").cast("double")
    return table(spark, data, "orders").groupBy((F.col("o_custkey") % 25).alias("cell")).agg(F.count(F.lit(1)).alias("whole"), F.count_if(~panel.near_whole(v)).alias("fractional"))


# --- grid, road, points of interest ---------------------------------------------------


@query("SELECT cell_id, ix, iy, round(lat, 8) AS lat, round(lon, 8) AS lon FROM grid_cells")
def grid_centroids(spark: SparkSession, data: str) -> DataFrame:
    """The grid built from its shape by the inverse projection; must equal the table."""
    return rounded(spatial.grid_cells(spark, GRID), "lat", "lon", digits=8)


@query(f"SELECT round(min(u_x) - 2500, 2) AS x0, round(min(u_y) - 2500, 2) AS y0, CAST(round((max(u_x) - min(u_x)) / 5000) + 1 AS INT) AS nx, CAST(round((max(u_y) - min(u_y)) / 5000) + 1 AS INT) AS ny FROM {utm.nested_sql('grid_cells', utm.forward('lon', 'lat', GRID.zone))}")
def grid_shape(spark: SparkSession, data: str) -> DataFrame:
    """Shape recovered from the centroids."""
    g = spatial.recover_grid(table(spark, data, "grid_cells"), 5000.0)
    return spark.createDataFrame([(round(g.x0, 2), round(g.y0, 2), g.nx, g.ny)], "x0 double, y0 double, nx int, ny int")


@query("SELECT epsg, count(*) AS n FROM (SELECT 'EPSG:' || CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + CAST(floor((lon + 180) / 6) AS INT) + 1 AS VARCHAR) AS epsg FROM acled_small WHERE NOT isnan(lat) AND NOT isnan(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) GROUP BY epsg")
def utm_zone(spark: SparkSession, data: str) -> DataFrame:
    """projection code of every valid reading, counted."""
    rows = table(spark, data, "acled_small").where("lat between -90 and 90 and lon between -180 and 180")
    return rows.groupBy(spatial.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MOB} SELECT i, j, round(w, 9) AS w FROM mob")
def rbf_mobility(spark: SparkSession, data: str) -> DataFrame:
    """Radial weights, rows normalised."""
    return rounded(_mobility(spark, data), "w", digits=9)


@query(f"WITH {_W} SELECT i, j, round(w, 9) AS w FROM nb")
def road_weights(spark: SparkSession, data: str) -> DataFrame:
    """Exponential weights with diagonal 1."""
    return rounded(intensity.check_weights(intensity.road_weights(_neighbours(spark, data), ROAD_BETA)), "w", digits=9)


@query("WITH nb AS (SELECT i, j, exp(-travel_time_s / 500e0) AS w FROM road_neighbours WHERE i <> j UNION ALL SELECT i, i, 1e0 FROM (SELECT i FROM road_neighbours UNION SELECT j FROM road_neighbours)) SELECT i, j, round(w, 9) AS w FROM nb")
def exp_decay_weights(spark: SparkSession, data: str) -> DataFrame:
    """A column kernel, diagonal 1 whatever the kernel says of 0."""
    return rounded(intensity.road_weights(_neighbours(spark, data), kernel=lambda d: stats.exp_decay(d, 500.0)), "w", digits=9)


@query("WITH nb AS (SELECT i, j, 1e0 / (1e0 + travel_time_s / 300e0) AS w FROM road_neighbours WHERE i <> j UNION ALL SELECT i, i, 1e0 FROM (SELECT i FROM road_neighbours UNION SELECT j FROM road_neighbours)) SELECT i, j, round(w, 9) AS w FROM nb")
def numpy_kernel_weights(spark: SparkSession, data: str) -> DataFrame:
    """A numpy kernel, probed on the driver and run in Arrow batches."""

    def kernel(d: np.ndarray) -> np.ndarray:
        if not isinstance(d, np.ndarray):
            raise TypeError("arrays only")
        return 1 / (1 + d / 300.0)

    return rounded(intensity.road_weights(_neighbours(spark, data), kernel=kernel), "w", digits=9)


def _paths_sql(rounds: int) -> str:
    parts = ["e AS (SELECT i AS u, j AS v, min(travel_time_s) AS w FROM road_neighbours WHERE i <> j GROUP BY i, j), d0 AS (SELECT DISTINCT i AS src, i AS node, 0e0 AS d FROM road_neighbours)"]
    for k in range(rounds):
        parts.append(f"d{k + 1} AS MATERIALIZED (SELECT src, node, min(d) AS d FROM (SELECT * FROM d{k} UNION ALL SELECT src, v, d + w FROM d{k} JOIN e ON e.u = d{k}.node WHERE d + w <= {num(CUTOFF_S)}) GROUP BY src, node)")
    return "WITH " + ", ".join(parts) + f" SELECT src AS i, node AS j, round(d, 6) AS travel_time_s FROM d{rounds}"


@query(_paths_sql(10))
def cutoff_travel_times(spark: SparkSession, data: str) -> DataFrame:
    """Shortest times up to the cutoff between all cells, a cell being its own node."""
    edges = _neighbours(spark, data).where("i <> j").select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("travel_time_s").alias("travel_time"))
    nodes = _neighbours(spark, data).select(F.col("i").alias("cell"), F.col("i").alias("node")).distinct()
    return rounded(graph.cell_neighbours(edges, nodes, CUTOFF_S), "travel_time_s")


_POI = "SELECT s_suppkey, 1.8e0 + 2.2e0 * (s_suppkey * 37 % 1000) / 1000e0 AS lon, 47.1e0 + 1.1e0 * (s_suppkey * 91 % 1000) / 1000e0 AS lat, CASE WHEN s_suppkey % 3 = 0 THEN 'school' WHEN s_suppkey % 3 = 1 THEN 'hospital' END AS amenity FROM supplier"
_POI_XY = utm.nested_sql(f"({_POI}) AS p", utm.forward("lon", "lat", GRID.zone))
_POI_CELL = f"poi AS (SELECT s_suppkey, amenity, {spatial.nearest_cell_sql(GRID, 'u_x', 'u_y')} AS cell FROM {_POI_XY})"


def _pois(spark: SparkSession, data: str) -> DataFrame:
    k = F.col("s_suppkey")
    at = table(spark, data, "supplier").select(k, (F.lit(1.8) + F.lit(2.2) * (k * 37 % 1000) / F.lit(1000.0)).alias("lon"), (F.lit(47.1) + F.lit(1.1) * (k * 91 % 1000) / F.lit(1000.0)).alias("lat"), F.when(k % 3 == 0, "school").when(k % 3 == 1, "hospital").alias("amenity"))
    return spatial.nearest_cell(at, GRID)


@query(f"WITH {_POI_CELL} SELECT s_suppkey, cell FROM poi")
def nearest_cell(spark: SparkSession, data: str) -> DataFrame:
    """Nearest centroid of every point."""
    return _pois(spark, data).select("s_suppkey", "cell")


@query("WITH c AS (SELECT cell_id AS cell, (cell_id % 40) * 5000e0 AS x, (cell_id // 40) * 5000e0 AS y FROM grid_cells), n AS (SELECT s_suppkey AS node, (s_suppkey * 7919 % 200000) + 0e0 AS x, (s_suppkey * 104729 % 150000) + 0e0 AS y FROM supplier) SELECT c.cell, arg_min(n.node, struct_pack(d := (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y), k := n.node)) AS node FROM c CROSS JOIN n GROUP BY c.cell")
def nearest_node(spark: SparkSession, data: str) -> DataFrame:
    """Nearest graph node of every centroid, by tiles."""
    k, c = F.col("s_suppkey"), F.col("cell_id")
    nodes = table(spark, data, "supplier").select(k.alias("node"), (k * 7919 % 200000).cast("double").alias("x"), (k * 104729 % 150000).cast("double").alias("y"))
    cells = table(spark, data, "grid_cells").select(c.alias("cell"), ((c % 40) * F.lit(5000.0)).alias("x"), (F.floor(c / 40) * F.lit(5000.0)).alias("y"))
    return graph.nearest_node(cells, nodes, 20000.0)


@query(f"""WITH {_POI_CELL}, n AS (SELECT cell, count(*) AS c, count(*) FILTER (amenity IS NOT NULL) AS a, count(*) FILTER (amenity = 'school') AS s FROM poi GROUP BY cell)
SELECT cell_id AS cell, coalesce(c, 0) + 0e0 AS poi_count, coalesce(a, 0) + 0e0 AS amenity, coalesce(s, 0) + 0e0 AS "amenity=school" FROM grid_cells LEFT JOIN n ON n.cell = cell_id""")
def poi_counts(spark: SparkSession, data: str) -> DataFrame:
    """Counts by cell and tag."""
    cells = table(spark, data, "grid_cells").select(F.col("cell_id").alias("cell"))
    return poi.poi_counts(_pois(spark, data), cells, [("amenity", None), ("amenity", "school")])


@query(f"""WITH {_POI_CELL}, m AS (SELECT cell_id AS cell, count(poi.cell) > 0 AS poi, count(poi.cell) FILTER (amenity = 'school') > 0 AS school, count(poi.cell) AS c, count(poi.cell) FILTER (amenity = 'school') AS s FROM grid_cells LEFT JOIN poi ON poi.cell = cell_id GROUP BY cell_id),
l AS (SELECT i, min(travel_time_s) FILTER (m.poi) AS a, min(travel_time_s) FILTER (m.school) AS b FROM road_neighbours JOIN m ON m.cell = j GROUP BY i)
SELECT m.cell, m.c + 0e0 AS poi_count, CASE WHEN m.poi THEN 0e0 ELSE coalesce(l.a, {num(CUTOFF_S)}) END AS poi_min_travel_time_s, CASE WHEN m.school THEN 0e0 ELSE coalesce(l.b, {num(CUTOFF_S)}) END AS "poi_amenity=school_min_travel_time_s", m.s + 0e0 AS "amenity=school" FROM m LEFT JOIN l ON l.i = m.cell""")
def poi_features(spark: SparkSession, data: str) -> DataFrame:
    """Counts, least travel times, counts by tag, in order."""
    cells = table(spark, data, "grid_cells").select(F.col("cell_id").alias("cell"))
    return poi.poi_features(_pois(spark, data), cells, _neighbours(spark, data), {"amenity": ["school"]}, CUTOFF_S)


# --- intensities -----------------------------------------------------------------------


@query("WITH k AS (SELECT unnest(generate_series(1, 6)) AS lag) SELECT CAST(lag AS INT) AS lag, round(exp(-0.7e0 * (lag - 1)) / (SELECT sum(exp(-0.7e0 * (lag - 1))) FROM k), 9) AS g FROM k")
def lag_kernel(spark: SparkSession, data: str) -> DataFrame:
    """normalised exponential lag kernel."""
    return rounded(spark.createDataFrame([*enumerate(stats.lag_kernel(6, 0.7), 1)], "lag int, g double"), "g", digits=9)


@query(f"{_PANEL}, h AS (SELECT cell, t, y, {_HIST} AS h FROM panel WINDOW w AS (PARTITION BY cell ORDER BY t)) SELECT cell, t, round(h, 6) AS h FROM h")
def lag_convolution(spark: SparkSession, data: str) -> DataFrame:
    """Causal convolution of every cell's history."""
    return rounded(intensity.lag_convolution(_panel(spark, data), KERNEL), "h").select("cell", "t", "h")


def _t_next(p: DataFrame) -> int:
    return p.agg(F.max("t")).first()[0] + 1


_H_NEXT = f"hn AS (SELECT cell, sum(CASE (SELECT max(t) FROM panel) - t {' '.join(f'WHEN {k} THEN {num(g)}' for k, g in enumerate(KERNEL))} ELSE 0e0 END * y) AS h FROM panel GROUP BY cell)"


@query(f"{_PANEL}, {_H_NEXT} SELECT cell, round(h, 6) AS h FROM hn")
def lag_convolution_last(spark: SparkSession, data: str) -> DataFrame:
    """Convolution for the next step."""
    p = _panel(spark, data)
    return rounded(intensity.lag_convolution_next(p, KERNEL, _t_next(p)), "h")


@query(f"{_PANEL}, f AS (SELECT cell, avg(y) AS feature FROM panel WHERE t > (SELECT max(t) FROM panel) - 7 GROUP BY cell) SELECT cell, round(feature, 6) AS feature, round(ln(1 + exp(-abs(0.1e0 + 0.5e0 * feature))) + greatest(0.1e0 + 0.5e0 * feature, 0), 6) AS lam FROM f")
def trailing_mean_intensity(spark: SparkSession, data: str) -> DataFrame:
    """Softplus of the trailing mean."""
    p = _panel(spark, data)
    return rounded(intensity.trailing_mean(p, 7, F.lit(0.1), 0.5, _t_next(p) - 1), "feature", "lam")


@query(f"{_ROAD} SELECT cell, t, round(x, 6) AS x FROM lam")
def road_excitation(spark: SparkSession, data: str) -> DataFrame:
    """Sparse matrix times history, all steps at once."""
    return rounded(_road(spark, data), "x").select("cell", "t", "x")


@query(f"{_MOBILE} SELECT cell, t, round(x, 6) AS x FROM lam")
def mobility_excitation(spark: SparkSession, data: str) -> DataFrame:
    """Dense matrix times history."""
    return rounded(_mobile(spark, data), "x").select("cell", "t", "x")


@query(f"{_MOBILE} SELECT cell, t, y, round(lam, 6) AS lam FROM lam")
def hawkes_intensity(spark: SparkSession, data: str) -> DataFrame:
    """Intensities of the dense model."""
    return rounded(_mobile(spark, data), "lam").select("cell", "t", "y", "lam")


@query(f"{_ROAD} SELECT cell, t, y, round(lam, 6) AS lam FROM lam")
def road_intensity(spark: SparkSession, data: str) -> DataFrame:
    """Intensities of the road model."""
    return rounded(_road(spark, data), "lam").select("cell", "t", "y", "lam")


@query(f"{_PANEL}, {_H_NEXT}, {_W}, ex AS (SELECT i AS cell, sum(w * h) AS x FROM nb JOIN hn ON nb.j = hn.cell GROUP BY i) SELECT cell, round(greatest({MU_SQL} + {num(ALPHA)} * x, 0), 6) AS lam FROM ex")
def next_step_intensity(spark: SparkSession, data: str) -> DataFrame:
    """M4: intensity of the step after the last."""
    p = _panel(spark, data)
    return rounded(intensity.next_step(p, intensity.road_weights(_neighbours(spark, data), ROAD_BETA), KERNEL, _mu(), ALPHA, _t_next(p)), "lam")


@query(f"{_SIM}, {_MOB}, panel AS (SELECT location AS cell, time AS t, y_true AS y FROM sim), {_H_NEXT} SELECT i AS cell, round(0.4e0 + 0.3e0 * sum(w * h), 6) AS lam FROM mob JOIN hn ON mob.j = hn.cell GROUP BY i")
def next_step_dense(spark: SparkSession, data: str) -> DataFrame:
    """M5: next intensity of the dense model."""
    p = _sim_panel(spark, data)
    return rounded(intensity.next_step(p, _mobility(spark, data), KERNEL, F.lit(0.4), 0.3, _t_next(p)), "lam")


def _forward_sql(head: str, weights: str, mu: str, alpha: float, scale: float, offset: float) -> str:
    """Roll-forward unrolled: step k reads the last observed steps and the intensities before it."""
    parts = ["tn AS (SELECT max(t) + 1 AS tn FROM panel)", "b0 AS (SELECT cell, t, y + 0e0 AS y FROM panel, tn WHERE t >= tn - 3)"]
    for k in range(HORIZON):
        g = " ".join(f"WHEN {n + 1} THEN {num(v)}" for n, v in enumerate(KERNEL))
        parts.append(f"h{k} AS (SELECT cell, sum(CASE tn + {k} - t {g} ELSE 0e0 END * y) AS h FROM b{k}, tn GROUP BY cell)")
        parts.append(f"l{k} AS MATERIALIZED (SELECT i AS cell, greatest({num(scale)} * greatest({mu} + {num(alpha)} * sum(w * h), 0) + {num(offset)}, 0) AS lam FROM {weights} JOIN h{k} ON {weights}.j = h{k}.cell GROUP BY i)")
        parts.append(f"b{k + 1} AS (SELECT * FROM b{k} UNION ALL SELECT cell, tn + {k}, lam FROM l{k}, tn)")
    return f"{head}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT CAST(cell AS INT) AS cell, {k + 1} AS k, round(lam, 6) AS lam FROM l{k}" for k in range(HORIZON))


@query(_forward_sql(f"{_PANEL}, {_W}", "nb", MU_SQL.replace("cell", "i"), ALPHA, 1.0, 0.0))
def mean_field_forecast(spark: SparkSession, data: str) -> DataFrame:
    """Mean-field roll-forward of the road model."""
    p = _panel(spark, data)
    mu = table(spark, data, "grid_cells").select(F.col("cell_id").alias("cell")).withColumn("mu", _mu())
    return rounded(intensity.roll_forward(p, intensity.road_weights(_neighbours(spark, data), ROAD_BETA), KERNEL, mu, ALPHA, HORIZON, _t_next(p)), "lam")


_SIM_PANEL = f"{_SIM}, {_MOB}, panel AS (SELECT location AS cell, time AS t, y_true AS y FROM sim)"


def _dense_forward(spark: SparkSession, data: str, y: str, scale: float, offset: float) -> DataFrame:
    p = _sim_panel(spark, data, y)
    mu = p.groupBy("cell").agg(F.lit(0.4).alias("mu"))
    return rounded(intensity.roll_forward(p, _mobility(spark, data), KERNEL, mu, 0.3, HORIZON, _t_next(p), scale=scale, offset=offset), "lam")


@query(_forward_sql(_SIM_PANEL, "mob", "0.4e0", 0.3, 1.0, 0.0))
def dense_forecast(spark: SparkSession, data: str) -> DataFrame:
    """M6: mean-field roll-forward of the dense model."""
    return _dense_forward(spark, data, "y_true", 1.0, 0.0)


@query(_forward_sql(_SIM_PANEL.replace("y_true AS y FROM sim", "y_obs AS y FROM sim"), "mob", "0.4e0", 0.3, P_DETECT, FALSE_RATE))
def observed_mean_forecast(spark: SparkSession, data: str) -> DataFrame:
    """Expected observed counts, rolled forward on their own scale."""
    return _dense_forward(spark, data, "y_obs", P_DETECT, FALSE_RATE)


# --- likelihoods and scores ---------------------------------------------------------------


@query(f"{_MOBILE} SELECT round(sum({_POIS}), 4) AS loglik FROM lam")
def poisson_loglik(spark: SparkSession, data: str) -> DataFrame:
    """Poisson log-likelihood of the dense model."""
    return rounded(likelihood.loglik(_mobile(spark, data)), "loglik", digits=4)


@query(f"{_ROAD} SELECT cell, count(*) AS n, round(sum({_POIS}), 5) AS loglik FROM lam GROUP BY cell")
def road_poisson_loglik(spark: SparkSession, data: str) -> DataFrame:
    """M9: Poisson log-likelihood of the road model, by cell."""
    return _road(spark, data).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(likelihood.logpmf(F.col("y"), F.col("lam"))), 5).alias("loglik"))


@query(f"{_ROAD} SELECT round(sum({_NB}), 4) AS loglik FROM lam")
def negbin_loglik(spark: SparkSession, data: str) -> DataFrame:
    """Negative binomial log-likelihood of the road model."""
    return rounded(likelihood.loglik(_road(spark, data), "negbin", DISPERSION), "loglik", digits=4)


_OBS_LAM = f"{_MOBILE}, o AS (SELECT s.y_obs AS y, {num(P_DETECT)} * l.lam + {num(FALSE_RATE)} AS lam FROM lam l JOIN sim s ON s.location = l.cell AND s.time = l.t)"


def _observed(spark: SparkSession, data: str) -> DataFrame:
    obs = _sim_panel(spark, data, "y_obs").withColumnRenamed("y", "y_obs")
    return _mobile(spark, data).join(obs, ["cell", "t"]).select(F.col("y_obs").alias("y"), likelihood.observed_mean(F.col("lam"), P_DETECT, FALSE_RATE).alias("lam"))


@query(f"{_OBS_LAM} SELECT round(sum({_POIS}), 4) AS loglik FROM o")
def observed_loglik_approx(spark: SparkSession, data: str) -> DataFrame:
    """Observed counts as Poisson around the thinned and cluttered intensity."""
    return rounded(likelihood.loglik(_observed(spark, data)), "loglik", digits=4)


_EXACT = f"""list_sum(list_transform(generate_series(0, least(y_true, y_obs)), lambda k: exp({_logfact('y_true')} - {_logfact('k')} - lgamma(y_true - k + 1) + k * ln({num(P_DETECT)}) + (y_true - k) * ln(1 - {num(P_DETECT)})
 + (y_obs - k) * ln({num(FALSE_RATE)}) - {num(FALSE_RATE)} - lgamma(y_obs - k + 1))))"""


@query(f"{_SIM} SELECT round(sum(ln({_EXACT})), 4) AS loglik FROM sim")
def observed_loglik_exact(spark: SparkSession, data: str) -> DataFrame:
    """Exact thinning and clutter likelihood."""
    return rounded(likelihood.observed_loglik_exact(_simulated(spark, data), P_DETECT, FALSE_RATE), "loglik", digits=4)


@query(f"{_OBS_LAM}, a AS (SELECT sum({_POIS}) AS approx FROM o), e AS (SELECT sum(ln({_EXACT})) AS exact FROM sim) SELECT round(exact, 4) AS exact, round(approx, 4) AS approx, round(exact - approx, 4) AS delta FROM a, e")
def observed_loglik_compare(spark: SparkSession, data: str) -> DataFrame:
    """Exact against approximate."""
    exact = likelihood.observed_loglik_exact(_simulated(spark, data), P_DETECT, FALSE_RATE).first()[0]
    approx = likelihood.loglik(_observed(spark, data)).select(F.col("loglik").alias("approx"))
    return rounded(approx.select(F.lit(exact).alias("exact"), "approx", (F.lit(exact) - F.col("approx")).alias("delta")), "exact", "approx", "delta", digits=4)


@query(f"{_ROAD} SELECT round(avg(-({_POIS})), 7) AS mean_nll FROM lam WHERE t >= {TRAIN_STEPS}")
def mean_nll(spark: SparkSession, data: str) -> DataFrame:
    """Mean negative log-likelihood over the held-out steps."""
    return rounded(likelihood.mean_nll(_road(spark, data).where(F.col("t") >= TRAIN_STEPS)), "mean_nll", digits=7)


@query(f"{_ROAD} SELECT round(sqrt(avg((y - lam) * (y - lam))), 7) AS rmse, round(avg(abs(y - lam)), 7) AS mae FROM lam")
def rmse_mae(spark: SparkSession, data: str) -> DataFrame:
    """Errors of the intensities."""
    return rounded(likelihood.errors(_road(spark, data)), "rmse", "mae", digits=7)


def _paths(spark: SparkSession, data: str) -> DataFrame:
    """Weeks of the simulated panel as paths: path = week, k = day of the week."""
    t = F.col("t")
    return _sim_panel(spark, data).select(F.floor(t / 7).alias("path"), "cell", (t % 7).alias("k"), "y")


@query(f"{_SIM} SELECT location AS cell, time % 7 AS k, round(avg(y_true), 6) AS mean, round(quantile_cont(y_true, 0.05), 6) AS q05, round(quantile_cont(y_true, 0.5), 6) AS q50, round(quantile_cont(y_true, 0.95), 6) AS q95 FROM sim GROUP BY ALL")
def path_quantiles(spark: SparkSession, data: str) -> DataFrame:
    """Mean and exact interpolated quantiles over paths."""
    out = likelihood.path_summary(_paths(spark, data), (0.05, 0.5, 0.95))
    return rounded(out.select("cell", "k", "mean", *[F.col("quantiles")[n].alias(c) for n, c in enumerate(("q05", "q50", "q95"))]), "mean", "q05", "q50", "q95")


@query(f"{_SIM}, q AS (SELECT location, time % 7 AS k, quantile_cont(y_true, 0.1) AS lo, quantile_cont(y_true, 0.9) AS hi FROM sim GROUP BY ALL) SELECT round(avg(CASE WHEN y_obs BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END), 7) AS coverage FROM sim JOIN q ON q.location = sim.location AND q.k = sim.time % 7")
def interval_coverage(spark: SparkSession, data: str) -> DataFrame:
    """A10: share of observations within an interval of quantiles."""
    q = likelihood.path_summary(_paths(spark, data), (0.1, 0.9)).select("cell", "k", F.col("quantiles")[0].alias("lo"), F.col("quantiles")[1].alias("hi"))
    rows = _sim_panel(spark, data, "y_obs").withColumn("k", F.col("t") % 7).join(q, ["cell", "k"])
    return rounded(likelihood.coverage(rows), "coverage", digits=7)


_RIDGE = f"""{_MOBILE}, d AS (SELECT cell, y, x, x - avg(x) OVER (PARTITION BY cell) AS xd, y - avg(y) OVER (PARTITION BY cell) AS yd FROM lam),
a AS (SELECT greatest(sum(xd * yd) / (sum(xd * xd) + 1e-6), 0) AS alpha FROM d)"""


@query(f"{_RIDGE} SELECT d.cell, round(any_value(a.alpha), 6) AS alpha, round(greatest(avg(y) - any_value(a.alpha) * avg(x), 0), 6) AS mu FROM d, a GROUP BY d.cell")
def ridge_fit(spark: SparkSession, data: str) -> DataFrame:
    """Pooled regression on demeaned rows."""
    alpha, mu = fit.ridge_fit(_mobile(spark, data))
    return rounded(mu.withColumn("alpha", F.lit(alpha.first()[0])), "alpha", "mu").select("cell", "alpha", "mu")


def _marks(spark: SparkSession, data: str) -> DataFrame:
    return _sim_panel(spark, data).select("cell", "t", (F.col("y") % 4).cast("int").alias("mark"))


@query(f"{_SIM} SELECT location AS cell, time AS t, CAST(y_true % 4 = 0 AS INT) + 0e0 AS m0, CAST(y_true % 4 = 1 AS INT) + 0e0 AS m1, CAST(y_true % 4 = 2 AS INT) + 0e0 AS m2, CAST(y_true % 4 = 3 AS INT) + 0e0 AS m3 FROM sim")
def marks_onehot(spark: SparkSession, data: str) -> DataFrame:
    """One-hot marks, spread to columns for comparison."""
    hot = marks.one_hot(_marks(spark, data), 4)
    return hot.select("cell", "t", *[F.col("onehot")[k].cast("double").alias(f"m{k}") for k in range(4)])


@query(f"{_SIM} SELECT 0::BIGINT AS missing, 0::BIGINT AS outside, 0::BIGINT AS negative, count(*) FILTER (y_true % 4 >= 3) AS too_great FROM sim")
def mark_contract(spark: SparkSession, data: str) -> DataFrame:
    """Faults of marks against a panel and a number of marks."""
    return marks.mark_faults(_sim_panel(spark, data), _marks(spark, data), 3)


# --- fits, simulation, workflows: random or optimised, so without SQL -------------------------


def _arrays(spark: SparkSession, data: str, y: str = "y_true") -> tuple[simulate.Edges, np.ndarray]:
    """sim_counts and its mobility as arrays, their sizes checked; the weights stay a list of edges."""
    p = _sim_panel(spark, data, y)
    n, steps = p.select("cell").distinct().count(), _t_next(p)
    if n * steps > simulate.ARRAY_VALUES:
        raise ValueError(f"{n} cells and {steps} steps are more than the {simulate.ARRAY_VALUES} values that are held as arrays")
    cells = sorted(r["cell"] for r in p.select("cell").distinct().collect())
    return simulate.edges_from(_mobility(spark, data), cells), simulate.matrix_of(p, cells, steps)


def _row(spark: SparkSession, f: dict) -> DataFrame:
    keep = {k: float(f[k]) for k in ("alpha", "beta", "dispersion", "loglik", "loglik_init") if k in f}
    return spark.createDataFrame([(*keep.values(), float(np.mean(f["mu"])), f["result"]["nit"])], ", ".join(f"{k} double" for k in [*keep, "mean_mu"]) + ", nit int")


@query()
def simulate_counts(spark: SparkSession, data: str) -> DataFrame:
    """Dense simulation with thinning and clutter, a task a seed."""
    w = simulate.random_world(5, 0, 0.5).weights
    return simulate.simulate_seeds(spark, w, simulate.Params(np.full(5, 0.5), 0.4, np.array(KERNEL), P_DETECT, FALSE_RATE), 60, range(8))


@query()
def simulate_road(spark: SparkSession, data: str) -> DataFrame:
    """Negative binomial simulation over the road's edges, which are never made a matrix."""
    cells = sorted(r["cell_id"] for r in table(spark, data, "grid_cells").select("cell_id").distinct().limit(simulate.ARRAY_EDGES).collect())
    w = simulate.edges_from(intensity.road_weights(_neighbours(spark, data), ROAD_BETA), cells)
    return simulate.simulate_seeds(spark, w, simulate.Params(np.full(len(cells), 0.2), 0.05, np.array(KERNEL)), 60, range(8), "negbin", 20.0)


@query()
def predictive_paths(spark: SparkSession, data: str) -> DataFrame:
    """Latent paths beyond the simulated panel."""
    w, y = _arrays(spark, data)
    return simulate.predictive_paths(spark, w, simulate.Params(np.full(len(w), 0.4), 0.3, np.array(KERNEL), P_DETECT, FALSE_RATE), y, HORIZON, 100, 3)


@query()
def fit_poisson(spark: SparkSession, data: str) -> DataFrame:
    """Mu and alpha."""
    w, y = _arrays(spark, data)
    return _row(spark, fit.fit_alpha_mu(w, np.array(KERNEL), y))


@query()
def fit_poisson_distributed(spark: SparkSession, data: str) -> DataFrame:
    """M20 at scale: Newton steps over the road panel until converged, which is reported; mu by cell."""
    f = fit.fit_distributed(_road(spark, data).select("cell", "y", "x"))
    return f["mu"].withColumns({"alpha": F.lit(f["alpha"]), "loglik": F.lit(f["loglik"]), "converged": F.lit(f["result"]["success"])})


@query()
def fit_lag_decay(spark: SparkSession, data: str) -> DataFrame:
    """With the lag kernel's decay."""
    w, y = _arrays(spark, data)
    return _row(spark, fit.fit_lag_decay(w, 3, y))


@query()
def fit_observed(spark: SparkSession, data: str) -> DataFrame:
    """From observed counts."""
    w, y = _arrays(spark, data, "y_obs")
    return _row(spark, fit.fit_alpha_mu(w, np.array(KERNEL), y, p=P_DETECT, false_rate=FALSE_RATE))


@query()
def fit_observation(spark: SparkSession, data: str) -> DataFrame:
    """Detection and clutter."""
    f = fit.fit_observation(_simulated(spark, data))
    return spark.createDataFrame([tuple(float(f[k]) for k in ("p_detect", "false_rate", "loglik", "loglik_init"))], "p_detect double, false_rate double, loglik double, loglik_init double")


@query()
def fit_complete(spark: SparkSession, data: str) -> DataFrame:
    """Latent fit with the exact observation likelihood."""
    w, y = _arrays(spark, data)
    f = fit.fit_alpha_mu(w, np.array(KERNEL), y)
    obs = likelihood.observed_loglik_exact(_simulated(spark, data), P_DETECT, FALSE_RATE).first()[0]
    return spark.createDataFrame([(f["alpha"], f["loglik"], obs, f["loglik"] + obs)], "alpha double, loglik_latent double, loglik_obs_exact double, loglik_joint double")


#: The cells' own counts of events, whose values are small whole numbers: the panel that the road model is fitted to.
def _events(spark: SparkSession, data: str) -> DataFrame:
    events = panel.clean_events(table(spark, data, "events_roundtrip"))
    return panel.dense_panel(panel.counts(events), table(spark, data, "grid_cells").select(F.col("cell_id").alias("cell")))


def _fit_row(spark: SparkSession, f: roadfit.RoadFit, *more: float) -> DataFrame:
    names = ["alpha double", "beta double", "dispersion double", "loglik double", "converged boolean", "nll double"]
    row = (f.alpha, f.beta, f.dispersion, f.loglik, f.converged, *more)
    return spark.createDataFrame([row], ", ".join(names[: len(row)]))


@query()
def fit_road(spark: SparkSession, data: str) -> DataFrame:
    """Mu, alpha, road decay and dispersion over the road's edges and the panel of events, all as tables."""
    return _fit_row(spark, roadfit.fit_road(_events(spark, data), _neighbours(spark, data), KERNEL, family="negbin"))


@query()
def fit_road_poisson(spark: SparkSession, data: str) -> DataFrame:
    """The Poisson model; mu by cell."""
    f = roadfit.fit_road(_events(spark, data), _neighbours(spark, data), KERNEL)
    return f.mu.withColumns({"alpha": F.lit(f.alpha), "beta": F.lit(f.beta), "loglik": F.lit(f.loglik), "converged": F.lit(f.converged)})


@query()
def observed_workflow(spark: SparkSession, data: str) -> DataFrame:
    """Fit on observed counts, paths, summary."""
    w, y = _arrays(spark, data, "y_obs")
    _, out = evaluate.observed_fit_sample_summarize(spark, simulate.World(np.zeros((len(w), 2)), w), np.array(KERNEL), y, HORIZON, 100, 0, P_DETECT, FALSE_RATE)
    return out


@query()
def fit_forecast(spark: SparkSession, data: str) -> DataFrame:
    """Road fit and forecast."""
    p = materialise(_events(spark, data))
    f = roadfit.fit_road(p, _neighbours(spark, data), KERNEL, beta=ROAD_BETA)
    return roadfit.forecast(p, _neighbours(spark, data), KERNEL, f, HORIZON, _t_next(p))


@query()
def backtest(spark: SparkSession, data: str) -> DataFrame:
    """Hold-out score of the last week."""
    p = materialise(_events(spark, data))
    b = roadfit.backtest(p, _neighbours(spark, data), KERNEL, _t_next(p) - 7, 7)
    return _fit_row(spark, b["fit"], b["nll"]).withColumns({"n_train": F.lit(b["n_train"]), "horizon": F.lit(b["horizon"])})


@query()
def synthetic_eval(spark: SparkSession, data: str) -> DataFrame:
    """Synthetic evaluation's metrics."""
    m = evaluate.evaluate_synthetic(spark, evaluate.EvalConfig())["metrics"]
    return spark.createDataFrame([tuple(m.values())], ", ".join(f"{k} double" for k in m))


@query()
def parameter_recovery(spark: SparkSession, data: str) -> DataFrame:
    """Simulate and refit, a task a seed."""
    p = simulate.Params(np.array([0.6, 0.9, 0.5]), 0.35, np.array(KERNEL))
    return fit.recover_seeds(spark, SECONDS, p, ROAD_BETA, 180, (3, 5, 7, 11, 13))




# --- what fits and simulations must satisfy, which SQL can state ---------------------------------


def _optimal(rows: DataFrame, mu: DataFrame, alpha: float) -> DataFrame:
    """``cell, optimal``: whether each cell's slope vanishes (or points below a mu of 0), and alpha's likewise as cell -1; rows: ``cell, y, x``."""
    lam = F.greatest(F.col("mu") + F.lit(alpha) * F.col("x"), F.lit(1e-12))
    r = rows.join(mu, "cell").withColumn("r", F.col("y") / lam - 1)
    flat = lambda slope, at, scale: F.when(at > 1e-9, F.abs(slope) <= 1e-5 * scale).otherwise(slope <= 1e-5 * scale)
    cells = r.groupBy("cell").agg(F.sum("r").alias("s"), F.max("mu").alias("mu"), F.count(F.lit(1)).alias("n")).select("cell", flat(F.col("s"), F.col("mu"), F.col("n") + F.lit(1e3) * F.col("mu")).alias("optimal"))
    whole = r.agg(F.sum(F.col("r") * F.col("x")).alias("s"), F.sum("x").alias("x")).select(F.lit(-1).alias("cell"), flat(F.col("s"), F.lit(alpha), F.col("x") + 1).alias("optimal"))
    return cells.unionByName(whole)


_OPTIMAL = "SELECT cell_id AS cell, true AS optimal FROM grid_cells UNION ALL SELECT -1, true"


@query(_OPTIMAL)
def fit_poisson_optimal(spark: SparkSession, data: str) -> DataFrame:
    """At the fitted mu and alpha no slope is left, computed anew from the panel."""
    rows = materialise(_road(spark, data).select("cell", "y", "x"))
    f = fit.fit_distributed(rows)
    return _optimal(rows, f["mu"], f["alpha"])


@query(_OPTIMAL)
def fit_road_optimal(spark: SparkSession, data: str) -> DataFrame:
    """The same of the road fit at a given decay, from intensities computed another way."""
    p = materialise(_events(spark, data))
    f = roadfit.fit_road(p, _neighbours(spark, data), KERNEL, beta=ROAD_BETA, tol=1e-13)
    rows = intensity.in_sample(p, intensity.road_weights(_neighbours(spark, data), ROAD_BETA), KERNEL, F.lit(0.0), 1.0)
    return _optimal(rows.select("cell", "y", "x"), f.mu, f.alpha)


@query("SELECT true AS is_maximum")
def fit_observation_maximum(spark: SparkSession, data: str) -> DataFrame:
    """No step of a hundredth in detection or clutter gains likelihood, computed anew from the panel."""
    rows = materialise(_simulated(spark, data))
    f = fit.fit_observation(rows)
    p, c = f["p_detect"], f["false_rate"]
    at = lambda p, c: likelihood.observed_loglik_exact(rows, min(p, 1.0), c).first()[0]
    top = at(p, c)
    return spark.createDataFrame([(all(at(p * a, c * b) <= top + 1e-6 * abs(top) for a, b in ((1.01, 1), (0.99, 1), (1, 1.01), (1, 0.99))),)], "is_maximum boolean")


def _plausible(rows: DataFrame, spread: Column) -> Column:
    """Counts within six deviations of their intensities' sum."""
    return F.abs(F.sum(F.col("y_true") - F.col("intensity"))) <= 6 * F.sqrt(F.sum(spread))


@query("SELECT CAST(unnest(generate_series(0, 7)) AS BIGINT) AS seed, CAST(300 AS BIGINT) AS n, true AS plausible, true AS thinned")
def simulate_counts_checks(spark: SparkSession, data: str) -> DataFrame:
    """Cells times steps rows a seed, counts near their intensities, observations near what detection and clutter leave."""
    seen = F.col("y_obs") - F.lit(P_DETECT) * F.col("y_true") - F.lit(FALSE_RATE)
    near = F.abs(F.sum(seen)) <= 6 * F.sqrt(F.sum(F.lit(P_DETECT * (1 - P_DETECT)) * F.col("y_true") + F.lit(FALSE_RATE)))
    rows = simulate_counts(spark, data)
    return rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), _plausible(rows, F.col("intensity")).alias("plausible"), near.alias("thinned"))


@query("SELECT CAST(s.seed AS BIGINT) AS seed, count(*) * 60 AS n, true AS plausible FROM grid_cells, (SELECT unnest(generate_series(0, 7)) AS seed) s GROUP BY 1")
def simulate_road_checks(spark: SparkSession, data: str) -> DataFrame:
    """The same of the negative binomial simulation over the road, whose variance exceeds its mean."""
    rows = simulate_road(spark, data)
    lam = F.col("intensity")
    return rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), _plausible(rows, lam + lam * lam / 20.0).alias("plausible"))


@query(f"SELECT CAST(k AS INT) AS k, count(DISTINCT location) * 100 AS n, true AS plausible FROM sim_counts, (SELECT unnest(generate_series(1, {HORIZON})) AS k) WHERE location IS NOT NULL GROUP BY 1")
def predictive_paths_checks(spark: SparkSession, data: str) -> DataFrame:
    """Cells times paths rows a step, counts near their intensities."""
    rows = predictive_paths(spark, data)
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), _plausible(rows, F.col("intensity")).alias("plausible"))


@query("SELECT true AS medians, true AS most_seeds, true AS gains")
def recovery_gates(spark: SparkSession, data: str) -> DataFrame:
    """The accuracy asked of five seeds: medians of the errors, four of five within wider bounds, likelihood above the start's."""
    errors = ("mu_mae", "alpha_err", "beta_err")
    rows = parameter_recovery(spark, data)
    medians = [F.percentile(c, F.lit(0.5)) <= b for c, b in zip(errors, (0.25, 0.15, 6e-4))]
    wide = [F.col(c) <= b for c, b in zip(errors, (0.35, 0.22, 9e-4))]
    return rows.agg((medians[0] & medians[1] & medians[2]).alias("medians"), (F.count_if(wide[0] & wide[1] & wide[2]) >= 4).alias("most_seeds"), F.every(F.col("loglik") >= F.col("loglik_init") - 1e-6).alias("gains"))
