"""Queries of the general problems 1 to 5 over whole tables, and equal SQL where SQL can express them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.functions import utm
from loomcast.operators import malformed, proximity, regular, rolling, skew
from loomcast.session import table

EPOCH = "DATE '1970-01-01'"
HEAVY_KEY_SHARE = 0.01
NEAR_M, NEAR_DAYS = 30.0, 2
PERIODS = (7, 30)
GAP_DAYS = 7
#: UTM zone of grid_cells.
GRID_ZONE = 31


def p1_cell_totals(spark: SparkSession, data: str) -> DataFrame:
    events = table(spark, data, "events_roundtrip")
    out = skew.skewed_aggregate(events, "cell_id", {"n": ("count", "*"), "total": ("sum", "value"), "least": ("min", "value"), "most": ("max", "value"), "days": ("count_distinct", "t")})
    return out.drop("is_heavy")


def _lat_keys(spark: SparkSession, data: str) -> DataFrame:
    lat = F.col("lat")
    return table(spark, data, "acled_small").select(F.when(lat.between(-90, 90), F.round(lat * 10000).cast("bigint")).alias("lat_e4"), "fatalities")


def p1_lat_totals(spark: SparkSession, data: str) -> DataFrame:
    return skew.skewed_aggregate(_lat_keys(spark, data), "lat_e4", {"n": ("count", "*"), "total": ("sum", "fatalities")}).drop("is_heavy")


def p1_found(spark: SparkSession, data: str) -> DataFrame:
    cells = table(spark, data, "events_roundtrip").select(F.when(F.col("cell_id") >= 0, F.col("cell_id")).cast("bigint").alias("key_id"))
    lats = _lat_keys(spark, data).select(F.col("lat_e4").alias("key_id"))
    parts = [skew.keys_over_share(df, "key_id", HEAVY_KEY_SHARE).select(F.lit(name).alias("table_name"), "key_id") for name, df in (("events_roundtrip", cells), ("acled_small", lats))]
    return parts[0].unionByName(parts[1])


def grid_polygons(cells: DataFrame) -> DataFrame:
    """``region_id, xs, ys``: squares in UTM metres around the centroids, corners to the millimetre so that neighbours share them."""
    xy = utm.apply(cells, utm.forward("lon", "lat", GRID_ZONE), ["u_x", "u_y"])
    h = F.col("cell_size_m") / 2
    w, e, s, n = (F.round(v, 3) for v in (F.col("u_x") - h, F.col("u_x") + h, F.col("u_y") - h, F.col("u_y") + h))
    return xy.select(F.col("cell_id").cast("bigint").alias("region_id"), F.array(w, e, e, w).alias("xs"), F.array(s, s, n, n).alias("ys"))


def _event_cells(spark: SparkSession, data: str, **options: int) -> DataFrame:
    events = table(spark, data, "events_roundtrip").select("event_id", "t", "cell_id", "lat", "lon")
    usable = proximity.valid_position()
    events = events.withColumns({"la": F.when(usable, F.col("lat")), "lo": F.when(usable, F.col("lon"))})
    xy = utm.apply(events, utm.forward("lo", "la", GRID_ZONE), ["u_x", "u_y"])
    out = proximity.region_of_points(xy, grid_polygons(table(spark, data, "grid_cells")), "u_x", "u_y", out="in_cell", **options)
    return out.select("event_id", "t", "cell_id", F.col("in_cell").cast("int").alias("in_cell"))


def p2_event_cells(spark: SparkSession, data: str) -> DataFrame:
    """Every event row with the cell that contains its position, beside the cell it came with."""
    return _event_cells(spark, data)


def p2_event_cells_by_leaf(spark: SparkSession, data: str) -> DataFrame:
    """The same by the way taken for more regions than go to every task: points and triangles meet leaf by leaf."""
    return _event_cells(spark, data, sent=0)


def _usable(spark: SparkSession, data: str) -> DataFrame:
    events = table(spark, data, "events_roundtrip").select("event_id", "t", "lat", "lon")
    return events.where(F.col("event_id").isNotNull() & (F.col("t") != F.expr(EPOCH)) & proximity.valid_position())


def p2_found(spark: SparkSession, data: str) -> DataFrame:
    return proximity.close_pairs(_usable(spark, data), NEAR_M, NEAR_DAYS)


def p2_site_links(spark: SparkSession, data: str) -> DataFrame:
    """A row for each place and day: its events, and its links to others within reach."""
    return proximity.site_links(_usable(spark, data), NEAR_M, NEAR_DAYS)


def _cell_days(spark: SparkSession, data: str) -> DataFrame:
    events = table(spark, data, "events_roundtrip").select("event_id", "t", "cell_id", "value")
    good = events.where(f"t <> {EPOCH} and value >= 0 and cell_id >= 0")
    once = rolling.once_per_id(good, "event_id", ["cell_id", "t", "value"])
    return rolling.trailing_totals(rolling.daily_totals(once, "cell_id", "t", "value"), PERIODS, tail=30)


def p3_cell_days(spark: SparkSession, data: str) -> DataFrame:
    return _cell_days(spark, data).withColumnRenamed("entity", "cell_id")


def p3_found(spark: SparkSession, data: str) -> DataFrame:
    # total_7 / 7 >= 3 * total_30 / 30, in whole numbers
    return _cell_days(spark, data).where("total_30 >= 20 and 10 * total_7 >= 7 * total_30").select(F.col("entity").alias("cell_id"), F.col("on_day").cast("string").alias("on_day"))


PLACE = ("lat_e4", "lon_e4")


def _readings(spark: SparkSession, data: str) -> DataFrame:
    rows = table(spark, data, "acled_small").where("lat between -90 and 90 and lon between -180 and 180")
    e4 = lambda c: F.round(F.col(c) * 10000).cast("bigint").alias(f"{c}_e4")
    return rows.select(e4("lat"), e4("lon"), malformed.valid_day(F.col("event_date")).alias("day"), F.when(F.col("fatalities") >= 0, F.col("fatalities")).alias("fatalities"))


def p4_series(spark: SparkSession, data: str) -> DataFrame:
    out = regular.regular_series(_readings(spark, data), PLACE, "day", "fatalities")
    return out.drop("observed", "fitted").withColumn("value", F.round("value", 6))


def p4_calendar(spark: SparkSession, data: str) -> DataFrame:
    """The series without the values that the fit gives: every day, its readings and their mean, and the readings around it."""
    s = regular.regular_series(_readings(spark, data), PLACE, "day", "fatalities")
    return s.select(*PLACE, "on_day", "n_readings", "filled", "prev_day", "next_day", "fitted", F.when(F.col("observed"), F.round("value", 6)).alias("value"))


def _daily(spark: SparkSession, data: str) -> DataFrame:
    rows = _readings(spark, data).where("lat_e4 is not null and lon_e4 is not null and day is not null")
    return regular.daily_means(rows, PLACE, "day", "fatalities")


def p4_normal_sums(spark: SparkSession, data: str) -> DataFrame:
    """The sums of each location's normal equations, one row each."""
    sums = regular.normal_sums(_daily(spark, data), PLACE)
    return sums.select(*PLACE, F.posexplode(F.concat("s", "v")).alias("k", "total")).withColumn("total", F.round("total", 5))


def p4_fit_gradient(spark: SparkSession, data: str) -> DataFrame:
    """What the normal equations leave at the fitted coefficients, relative to their right-hand side: 0 of every location with values."""
    fit = regular.fit_harmonics(_daily(spark, data), PLACE).where("coef is not null")
    size = 6
    at = {pair: k for k, pair in enumerate((a, b) for a in range(size) for b in range(a, size))}
    s, c, v = (lambda k, n=n: F.get(n, F.lit(k)) for n in ("s", "coef", "v"))
    weight = sum((s(at[k, k]) for k in range(1, size)), s(0)) * F.lit(regular.RIDGE / size)
    rows = [sum((s(at[min(a, b), max(a, b)]) * c(b) for b in range(1, size)), s(at[0, a]) * c(0)) + (weight * c(a) if a else F.lit(0.0)) - v(a) for a in range(size)]
    scale = F.lit(1.0) + sum((F.abs(v(a)) for a in range(1, size)), F.abs(v(0)))
    return fit.select(*PLACE, F.round(F.greatest(*[F.abs(r) for r in rows]) / scale, 6).alias("left_over"))


def p4_found(spark: SparkSession, data: str) -> DataFrame:
    series = regular.regular_series(_readings(spark, data), PLACE, "day", "fatalities")
    return regular.gaps(series, PLACE, GAP_DAYS).select(*PLACE, F.col("gap_first").cast("string").alias("gap_first"), F.col("gap_last").cast("string").alias("gap_last"))


def _checked(spark: SparkSession, data: str) -> malformed.Checked:
    return malformed.check_records(table(spark, data, "acled_raw"), table(spark, data, "acled_small"))


def p5_found(spark: SparkSession, data: str) -> DataFrame:
    return _checked(spark, data).errors


def p5_clean(spark: SparkSession, data: str) -> DataFrame:
    return _checked(spark, data).clean


def p5_counts(spark: SparkSession, data: str) -> DataFrame:
    """Records of each origin: erroneous and clean ones add up to all."""
    return _checked(spark, data).counts


def p5_error_rows(spark: SparkSession, data: str) -> DataFrame:
    return malformed.error_rows(_checked(spark, data).errors)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_cell_totals, p1_lat_totals, p2_found, p2_site_links, p2_event_cells, p2_event_cells_by_leaf, p3_found, p3_cell_days, p4_found, p4_series, p4_calendar, p4_normal_sums, p4_fit_gradient, p5_found, p5_clean, p5_counts, p5_error_rows)}

# --- equal SQL -------------------------------------------------------------------

_LAT = "CASE WHEN lat BETWEEN -90 AND 90 AND NOT isnan(lat) THEN CAST(round(lat * 10000) AS BIGINT) END"
_OK = "lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)"
_EVENTS_XY = utm.nested_sql(f"(SELECT *, CASE WHEN {_OK} THEN lat END AS la, CASE WHEN {_OK} THEN lon END AS lo FROM events_roundtrip) AS e", utm.forward("lo", "la", GRID_ZONE))
_CELL_DAYS = """
WITH good AS (SELECT event_id, t, cell_id, value FROM events_roundtrip WHERE t <> DATE '1970-01-01' AND value >= 0 AND cell_id >= 0),
once AS (SELECT min(cell_id) AS cell_id, min(t) AS t, min(value) AS value FROM good WHERE event_id IS NOT NULL GROUP BY event_id
         UNION ALL SELECT cell_id, t, value FROM good WHERE event_id IS NULL),
daily AS (SELECT cell_id, t, CAST(sum(value) AS BIGINT) AS total FROM once GROUP BY cell_id, t),
span AS (SELECT cell_id, min(t) AS lo, max(t) + 30 AS hi FROM daily GROUP BY cell_id),
cal AS (SELECT cell_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS on_day FROM span),
full_days AS (SELECT c.cell_id, c.on_day, coalesce(d.total, 0) AS total FROM cal c LEFT JOIN daily d ON d.cell_id = c.cell_id AND d.t = c.on_day),
rolled AS (SELECT cell_id, on_day, CAST(total AS BIGINT) AS total,
  CAST(sum(total) OVER (PARTITION BY cell_id ORDER BY on_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS total_7,
  CAST(sum(total) OVER (PARTITION BY cell_id ORDER BY on_day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS total_30 FROM full_days)
"""
_DAY_RE = r"[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?)?"
_DEC_RE = r"[+-]?[0-9]+([.][0-9]+)?"


def _day_sql(x: str) -> str:
    s = f"trim({x}, ' ')"
    return f"CASE WHEN regexp_full_match({s}, '{_DAY_RE}') AND NOT starts_with({s}, '0000') THEN try_cast({s}[1:10] AS DATE) END"


_RECORDS = r"""
WITH h0 AS (SELECT file_name, replace(arg_min(raw_line, line_id), chr(65279), '') AS header FROM acled_raw WHERE line_no = 1 GROUP BY file_name),
h AS (SELECT *, CASE WHEN contains(header, chr(9)) THEN chr(9) WHEN contains(header, ';') THEN ';' ELSE ',' END AS sep FROM h0),
hn AS (SELECT file_name, sep, string_split(header, sep) AS names FROM h),
r AS (SELECT line_id, raw_line, coalesce(sep, ',') AS sep, names FROM acled_raw LEFT JOIN hn USING (file_name) WHERE line_no <> 1 AND trim(raw_line, ' ') <> ''),
w AS (SELECT *, CASE sep
   WHEN ',' THEN regexp_full_match(raw_line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's')
   WHEN ';' THEN regexp_full_match(raw_line, '("([^"]|"")*"|[^";]*)(;("([^"]|"")*"|[^";]*))*', 's')
   ELSE regexp_full_match(raw_line, '("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*', 's') END AS well FROM r),
c AS (SELECT *, CASE sep
   WHEN ',' THEN regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",]*)', 1)
   WHEN ';' THEN regexp_extract_all(';' || raw_line, ';("(?:[^"]|"")*"|[^";]*)', 1)
   ELSE regexp_extract_all(chr(9) || raw_line, '\t("(?:[^"]|"")*"|[^"\t]*)', 1) END AS cells FROM w),
u AS (SELECT *, list_transform(cells, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS vals FROM c),
ex AS (SELECT line_id, unnest(names) AS "column", unnest(vals) AS text FROM u WHERE well AND len(vals) = len(names)),
cell AS (SELECT 'acled_raw' AS origin, line_id AS row_key, lower(trim("column", ' ')) AS "column", text,
   CASE WHEN regexp_full_match(trim(text, ' '), '__DEC__') THEN try_cast(trim(text, ' ') AS DOUBLE) END AS number FROM ex
  UNION ALL SELECT 'acled_small', row_id, 'event_date', event_date, NULL FROM acled_small
  UNION ALL SELECT 'acled_small', row_id, 'lat', NULL, CASE WHEN isfinite(lat) THEN lat END FROM acled_small
  UNION ALL SELECT 'acled_small', row_id, 'lon', NULL, CASE WHEN isfinite(lon) THEN lon END FROM acled_small
  UNION ALL SELECT 'acled_small', row_id, 'fatalities', NULL, CAST(fatalities AS DOUBLE) FROM acled_small),
judged AS (SELECT *, __DAY__ AS day FROM cell WHERE "column" IN ('event_date', 'lat', 'lon', 'fatalities')),
bad AS (SELECT origin, row_key, "column" AS reason FROM judged WHERE NOT coalesce(CASE "column" WHEN 'event_date' THEN day IS NOT NULL
   WHEN 'lat' THEN number BETWEEN -90 AND 90 WHEN 'lon' THEN number BETWEEN -180 AND 180 ELSE number >= 0 AND number = floor(number) END, false)),
errors AS (SELECT 'acled_raw' AS origin, line_id AS row_key, CASE WHEN NOT well THEN 'quoting' ELSE 'columns' END AS reason FROM u WHERE NOT well OR names IS NULL OR len(vals) <> len(names)
  UNION SELECT origin, row_key, reason FROM bad)
""".replace("__DEC__", _DEC_RE).replace("__DAY__", _day_sql("text"))

_P4 = f"""
WITH rd AS (SELECT CAST(round(lat * 10000) AS BIGINT) AS lat_e4, CAST(round(lon * 10000) AS BIGINT) AS lon_e4, {_day_sql("event_date")} AS day FROM acled_small
  WHERE NOT isnan(lat) AND NOT isnan(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
d AS (SELECT DISTINCT lat_e4, lon_e4, day FROM rd WHERE day IS NOT NULL),
n AS (SELECT *, lead(day) OVER (PARTITION BY lat_e4, lon_e4 ORDER BY day) AS nx FROM d)
SELECT lat_e4, lon_e4, CAST(day + 1 AS VARCHAR) AS gap_first, CAST(nx - 1 AS VARCHAR) AS gap_last FROM n WHERE nx - day > {GAP_DAYS}
"""

_P4_DAILY = f"""
WITH rd AS (SELECT CAST(round(lat * 10000) AS BIGINT) AS lat_e4, CAST(round(lon * 10000) AS BIGINT) AS lon_e4, {_day_sql("event_date")} AS day, CASE WHEN fatalities >= 0 THEN fatalities END AS f FROM acled_small
  WHERE NOT isnan(lat) AND NOT isnan(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
d AS (SELECT lat_e4, lon_e4, day, count(*) AS n, avg(f) AS y, CAST(day - DATE '1970-01-01' AS INT) AS day_no FROM rd WHERE day IS NOT NULL GROUP BY ALL)"""
_ANGLE = f"(day_no * {utm.num(2 * math.pi / regular.YEAR_DAYS)})"
_TERMS = ("1e0", f"((day_no - first) / {utm.num(regular.YEAR_DAYS)})", f"sin({_ANGLE})", f"cos({_ANGLE})", f"sin(2e0 * {_ANGLE})", f"cos(2e0 * {_ANGLE})")
_SUMS = [f"sum(CASE WHEN y IS NOT NULL THEN {_TERMS[a]} * {_TERMS[b]} END)" for a in range(6) for b in range(a, 6)] + [f"sum({x} * y)" for x in _TERMS]
_P4_SUMS = f"""{_P4_DAILY}, f AS (SELECT *, min(day_no) OVER (PARTITION BY lat_e4, lon_e4) AS first FROM d), s AS (SELECT lat_e4, lon_e4, [{", ".join(_SUMS)}] AS s FROM f GROUP BY lat_e4, lon_e4)
SELECT lat_e4, lon_e4, CAST(k AS INT) AS k, round(s[k + 1], 5) AS total FROM s, (SELECT unnest(generate_series(0, 26)) AS k)"""
_P4_CALENDAR = f"""{_P4_DAILY}, g AS (SELECT *, lead(day) OVER (PARTITION BY lat_e4, lon_e4 ORDER BY day) AS nx, lag(day) OVER (PARTITION BY lat_e4, lon_e4 ORDER BY day) AS pv, count(y) OVER (PARTITION BY lat_e4, lon_e4) > 0 AS fitted FROM d),
e AS (SELECT *, CAST(unnest(generate_series(day, coalesce(nx - 1, day), INTERVAL 1 DAY)) AS DATE) AS on_day FROM g)
SELECT lat_e4, lon_e4, on_day, CASE WHEN on_day = day THEN n ELSE 0 END AS n_readings, on_day <> day AS filled, CASE WHEN on_day = day THEN pv ELSE day END AS prev_day, nx AS next_day, fitted,
 CASE WHEN on_day = day THEN round(y, 6) END AS value FROM e"""

_RAD = "2e0 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"

SQL: dict[str, str] = {
    "p1_cell_totals": "SELECT cell_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, min(value) AS least, max(value) AS most, count(DISTINCT t) AS days FROM events_roundtrip GROUP BY cell_id",
    "p1_lat_totals": f"SELECT {_LAT} AS lat_e4, count(*) AS n, CAST(sum(fatalities) AS BIGINT) AS total FROM acled_small GROUP BY 1",
    "p1_found": f"""
SELECT 'events_roundtrip' AS table_name, CAST(cell_id AS BIGINT) AS key_id FROM events_roundtrip WHERE cell_id >= 0 GROUP BY cell_id HAVING count(*) >= {HEAVY_KEY_SHARE} * (SELECT count(*) FROM events_roundtrip)
UNION ALL SELECT 'acled_small', {_LAT} AS k FROM acled_small WHERE {_LAT} IS NOT NULL GROUP BY k HAVING count(*) >= {HEAVY_KEY_SHARE} * (SELECT count(*) FROM acled_small)""",
    "p2_event_cells": f"""
SELECT event_id, t, cell_id, CAST(CASE WHEN u_x >= 402500 AND u_x < 602500 AND u_y >= 5205000 AND u_y < 5355000 THEN floor((u_y - 5205000) / 5000) * 40 + floor((u_x - 402500) / 5000) END AS INT) AS in_cell FROM {_EVENTS_XY}""",
    "p2_site_links": f"""
WITH s AS (SELECT lat + 0e0 AS lat, lon + 0e0 AS lon, t, count(DISTINCT event_id) AS n FROM events_roundtrip WHERE event_id IS NOT NULL AND t <> DATE '1970-01-01' AND {_OK} GROUP BY ALL),
k AS (SELECT *, CAST(floor(lat / 0.001) AS BIGINT) AS gy FROM s), o AS (SELECT unnest([-1, 0, 1]) AS dy), kb AS (SELECT k.*, gy + dy AS gj FROM k, o),
l AS (SELECT a.lat, a.lon, a.t, count(*) AS near_sites, CAST(sum(b.n) AS BIGINT) AS near_events FROM k a JOIN kb b ON a.gy = b.gj
 WHERE abs(a.t - b.t) <= {NEAR_DAYS} AND (a.lat <> b.lat OR a.lon <> b.lon) AND {_RAD} <= {NEAR_M} GROUP BY ALL)
SELECT s.lat, s.lon, s.t AS day, s.n AS events, coalesce(near_sites, 0) AS near_sites, coalesce(near_events, 0) AS near_events FROM s LEFT JOIN l USING (lat, lon, t)""",
    "p2_found": f"""
WITH e AS (SELECT event_id, min(t) AS t, min(lat) AS lat, min(lon) AS lon FROM events_roundtrip WHERE event_id IS NOT NULL AND t <> DATE '1970-01-01' AND {_OK} GROUP BY event_id),
k AS (SELECT *, CAST(floor(lat / 0.001) AS BIGINT) AS gy FROM e), o AS (SELECT unnest([-1, 0, 1]) AS dy), kb AS (SELECT k.*, gy + dy AS gj FROM k, o)
SELECT a.event_id AS event_id_a, b.event_id AS event_id_b FROM k a JOIN kb b ON a.gy = b.gj AND a.event_id < b.event_id
WHERE abs(a.t - b.t) <= {NEAR_DAYS} AND (a.lat <> b.lat OR a.lon <> b.lon) AND {_RAD} <= {NEAR_M}""",
    "p3_cell_days": _CELL_DAYS + "SELECT cell_id, on_day, total, total_7, total_30, total_7 / 7e0 AS avg_7, total_30 / 30e0 AS avg_30 FROM rolled",
    "p3_found": _CELL_DAYS + "SELECT cell_id, CAST(on_day AS VARCHAR) AS on_day FROM rolled WHERE total_30 >= 20 AND 10 * total_7 >= 7 * total_30",
    "p4_found": _P4,
    "p4_normal_sums": _P4_SUMS,
    "p4_fit_gradient": f"{_P4_DAILY} SELECT lat_e4, lon_e4, 0e0 AS left_over FROM d GROUP BY lat_e4, lon_e4 HAVING count(y) > 0",
    "p4_calendar": _P4_CALENDAR,
    "p5_counts": _RECORDS + ", n AS (SELECT 'acled_raw' AS origin, line_id AS row_key FROM u UNION ALL SELECT 'acled_small', row_id FROM acled_small), b AS (SELECT DISTINCT origin, row_key FROM errors) SELECT n.origin, count(*) AS records, count(b.row_key) AS erroneous, count(*) - count(b.row_key) AS clean FROM n LEFT JOIN b ON b.origin = n.origin AND b.row_key = n.row_key GROUP BY n.origin",
    "p5_found": _RECORDS + "SELECT origin, row_key, reason FROM errors",
    "p5_error_rows": _RECORDS + "SELECT origin, row_key, string_agg(reason, ',' ORDER BY reason) AS reasons FROM errors GROUP BY origin, row_key",
    "p5_clean": _RECORDS
    + """SELECT origin, row_key, max(CASE WHEN "column" = 'event_date' THEN day END) AS event_date, max(CASE WHEN "column" = 'lat' THEN number END) AS lat,
 max(CASE WHEN "column" = 'lon' THEN number END) AS lon, CAST(max(CASE WHEN "column" = 'fatalities' THEN number END) AS BIGINT) AS fatalities
 FROM judged j WHERE NOT EXISTS (SELECT 1 FROM errors e WHERE e.origin = j.origin AND e.row_key = j.row_key) GROUP BY origin, row_key""",
}
SQL["p2_event_cells_by_leaf"] = SQL["p2_event_cells"]
