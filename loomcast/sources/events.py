"""Event sources and sinks: JSON lines, canonical Parquet, CSV with header, count matrices."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcast import schema
from loomcast.operators import panel
from loomcast.sources import files


#: The kinds of JSON values that a key may hold; any other is an error of that key.
_WHOLE, _NUMBER, _TEXT = r"^BIGINT$", r"^(BIGINT|DOUBLE|DECIMAL.*)$", r"^STRING$"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line``: numbers from 1 within each file, over splits of any size.

    A split's lines are numbered in their order; the lines of the splits before it in its file are added, one row a split.
    """
    text = spark.read.text(path).select("*", "_metadata.file_path", "_metadata.file_block_start")
    rows = text.select(F.col("value").alias("line"), F.col("file_path").alias("file"), F.col("file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__n"))
    parts = rows.groupBy("file", "__at").agg(F.count(F.lit(1)).alias("__rows"), F.min("__n").alias("__first"))
    before = Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first") + 1)
    return rows.join(parts.select("file", "__at", "__before"), ["file", "__at"]).select("file", (F.col("__n") + F.col("__before")).alias("line_no"), "line")


def read_events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Raw events, one JSON object a line: the canonical columns plus ``error``, ``file``, ``line_no`` (from 1) and the ``line`` itself.

    Blank lines are skipped, but numbered. ``t`` defaults to 1970-01-01 and ``value`` to 1 where the key is absent; a fractional
    value is truncated; numbers written as text are read for lat, lon and value alone. Null stands for an absent id, cell,
    mark or meta. Lines that aren't a JSON object have error ``json``; others the first rule they break, a value of
    another kind than its key asks included. Nothing is raised here.
    """
    lines = _numbered(spark, path).where(F.btrim("line") != "").withColumn("j", F.try_parse_json("line"))
    get = lambda key, kind: F.try_variant_get("j", f"$.{key}", kind)
    kind = lambda key: F.schema_of_variant(get(key, "variant"))  # null if absent, VOID if null
    held = lambda key: kind(key).isNotNull() & (kind(key) != "VOID")
    is_object = F.coalesce(F.schema_of_variant("j").startswith("OBJECT"), F.lit(False))
    number = lambda key: F.when(kind(key).rlike(_NUMBER), get(key, "double")).when(kind(key).rlike(_TEXT), F.btrim(get(key, "string")).try_cast("double"))
    whole_text = F.when(kind("value").rlike(_TEXT), F.btrim(get("value", "string")).try_cast("bigint")).otherwise(number("value").cast("bigint"))
    wrong = [F.when(held(key) & ~kind(key).rlike(asked), key) for key, asked in (("t", _TEXT), ("event_id", _TEXT), ("cell_id", _WHOLE), ("mark", _TEXT), ("meta", "^OBJECT"))]
    rows = lines.select(
        F.when(is_object, F.when(kind("t").isNotNull(), F.when(kind("t").rlike(_TEXT), get("t", "string")).try_cast("date")).otherwise(F.lit("1970-01-01").cast("date"))).alias("t"),
        number("lat").alias("lat"),
        number("lon").alias("lon"),
        F.when(kind("value").isNotNull(), whole_text).otherwise(F.lit(1).cast("bigint")).alias("value"),
        F.when(kind("event_id").rlike(_TEXT), get("event_id", "string")).alias("event_id"),
        F.when(kind("cell_id").rlike(_WHOLE), get("cell_id", "int")).alias("cell_id"),
        F.when(kind("mark").rlike(_TEXT), get("mark", "string")).alias("mark"),
        F.when(kind("meta").rlike("^OBJECT"), F.to_json(get("meta", "variant"))).alias("meta_json"),
        is_object.alias("is_object"),
        F.coalesce(*wrong, F.when(held("cell_id") & get("cell_id", "int").isNull(), "cell_id")).alias("kind_error"),
        "file",
        "line_no",
        "line",
    )
    checked = schema.with_errors(rows)
    return checked.withColumn("error", F.when(~F.col("is_object"), "json").otherwise(F.coalesce("error", "kind_error"))).drop("is_object", "kind_error")


def ingest_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events of a JSON-lines file; ValueError that names the first bad line, or if there are no events."""
    raw = read_events_jsonl(spark, path)
    bad = raw.where("error is not null").orderBy("file", "line_no").select("error", "line_no", "file", "line").first()
    if bad:
        raise ValueError(f"invalid {bad['error']} on line {bad['line_no']} of {bad['file']}: {bad['line'][:200]}")
    rows = raw.drop("error", "file", "line_no", "line")
    if rows.isEmpty():
        raise ValueError("there are no events")
    return schema.check_schema(schema.canonical(rows))


def write_events(events: DataFrame, path: str) -> None:
    schema.check_schema(events).write.mode("overwrite").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_event_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header that names event_date, lat, lon and fatalities (others are ignored), everything else an error."""
    df = spark.read.option("header", True).csv(path)
    if missing := [c for c in ("event_date", "lat", "lon", "fatalities") if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    n = F.col("f")
    df = df.select("event_date", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), F.col("fatalities").try_cast("double").alias("f"))
    bad = ~(F.coalesce(F.abs("lat") <= 90, F.lit(False)) & F.coalesce(F.abs("lon") <= 180, F.lit(False)) & F.coalesce(n >= 0, F.lit(False)) & F.coalesce(panel.near_whole(n), F.lit(False)))
    if count := df.where(bad).count():
        raise ValueError(f"{count} rows with invalid lat, lon or fatalities")
    return df.select("event_date", "lat", "lon", n.cast("bigint").alias("fatalities"))


@dataclass
class Loaded:
    """A panel ``cell, t, y`` and the mobility ``i, j, w`` between its cells, with where that came from."""

    panel: DataFrame
    mobility: DataFrame
    mobility_source: str


def load_event_panel(spark: SparkSession, path: str, value: str = "events") -> DataFrame:
    """``cell, t, y`` of an event CSV: locations in order of (lon, lat), days in order of occurrence, counts or fatalities."""
    if value not in ("events", "fatalities"):
        raise ValueError("value must be 'events' or 'fatalities'")
    return panel.location_panel(read_event_csv(spark, path), None if value == "events" else "fatalities")


def load_events(spark: SparkSession, path: str, value: str = "events", mobility_path: str | None = None) -> Loaded:
    """Panel and mobility (the identity unless a file is named) of an event CSV."""
    p = load_event_panel(spark, path, value)
    return _with_mobility(spark, p, mobility_path)


def load_counts(spark: SparkSession, path: str, mobility_path: str | None = None) -> Loaded:
    """Panel and mobility of a count matrix; a folder's ``mobility.npy`` is taken if no other file is named."""
    beside = f"{path.rstrip('/')}/mobility.npy"
    if mobility_path is None and not path.endswith((".csv", ".npy")) and files.exists(spark, beside):
        mobility_path = beside
    return _with_mobility(spark, read_count_matrix(spark, path), mobility_path)


def _with_mobility(spark: SparkSession, p: DataFrame, mobility_path: str | None) -> Loaded:
    cells = p.agg(F.max("cell")).first()[0]
    return Loaded(p, read_mobility(spark, mobility_path, 0 if cells is None else cells + 1), mobility_path or "identity")


def read_count_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``cell, t, y`` of a headerless CSV matrix, or of a folder with ``y_obs.csv``, or of a ``.npy`` file; row i is location i."""
    if path.endswith(".npy"):
        y = np.load(io.BytesIO(files.read_bytes(spark, path)))
        if y.ndim != 2:
            raise ValueError("the matrix must have two dimensions")
        i, t = np.indices(y.shape)
        return spark.createDataFrame([*zip(i.ravel().tolist(), t.ravel().tolist(), y.ravel().astype(int).tolist())], "cell int, t int, y bigint")
    file = path if path.endswith(".csv") else f"{path.rstrip('/')}/y_obs.csv"
    if not files.exists(spark, file):
        raise FileNotFoundError(file)
    lines = _numbered(spark, file).where(F.btrim("line") != "")
    rows = panel.with_ordinal(lines, ["line_no"], "cell").select("cell", "line")
    cells = rows.select("cell", F.size(F.split("line", ",")).alias("n"), F.posexplode(F.split("line", ",")).alias("t", "text")).withColumn("v", F.btrim("text").try_cast("double"))
    ok = F.coalesce(F.col("v") >= 0, F.lit(False)) & F.coalesce(panel.near_whole(F.col("v")), F.lit(False))
    state = cells.agg(F.count_if(~ok).alias("bad"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    if state["bad"] or state["lo"] is None or state["lo"] != state["hi"]:
        raise ValueError("the matrix must be rectangular and hold counts")
    return cells.select("cell", "t", F.rint("v").cast("bigint").alias("y"))


def read_mobility(spark: SparkSession, path: str | None, n: int) -> DataFrame:
    """``i, j, w`` of a square ``.npy`` matrix (zeros left out), or the identity where no path is given. A missing file raises."""
    if path is None:
        return spark.range(n).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1.0).alias("w"))
    m = np.asarray(np.load(io.BytesIO(files.read_bytes(spark, path))), float)
    if m.shape != (n, n) or not np.isfinite(m).all():
        raise ValueError(f"mobility must be a finite {n} x {n} matrix")
    i, j = np.nonzero(m)
    return spark.createDataFrame([*zip(i.tolist(), j.tolist(), m[i, j].tolist())], "i int, j int, w double")
