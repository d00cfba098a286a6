import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast import schema
from loomcast.operators import panel
from loomcast.sources import events, simulation


def _write(tmp_path, *lines):
    p = tmp_path / "raw.jsonl"
    p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(p)


A = {"event_id": "a", "t": "2020-01-02", "lat": 51.5, "lon": -0.1, "value": 2, "cell_id": 123, "mark": "type1", "meta": {"k": {"n": 1}, "a": 2}}


def test_ingest_round_trip(spark, tmp_path):
    path = _write(tmp_path, A, "", {"event_id": "b", "t": "2020-01-03", "lat": 52.0, "lon": 0.1, "cell_id": None, "mark": "type2", "meta": {"x": [1, 2]}})
    df = events.ingest_jsonl(spark, path)
    assert df.columns == ["t", "lat", "lon", "value", "event_id", "cell_id", "mark", "meta_json"]
    events.write_events(df, str(tmp_path / "out"))
    rows = events.read_events(spark, str(tmp_path / "out")).orderBy("event_id").collect()
    assert (rows[0]["t"], rows[0]["value"], rows[0]["cell_id"], json.loads(rows[0]["meta_json"])) == (dt.date(2020, 1, 2), 2, 123, A["meta"])
    assert (rows[1]["value"], rows[1]["cell_id"]) == (1, None)


@pytest.mark.parametrize("line,error", [("not json", "json"), ("[1]", "json"), ({**A, "lat": 91}, "lat"), ({**A, "lon": None}, "lon"), ({**A, "value": -1}, "value"), ({**A, "mark": ""}, "mark"), ({**A, "t": "soon"}, "t"), ({**A, "cell_id": -4}, "cell_id"), ({**A, "meta": 3}, "meta")])
def test_bad_lines_carry_their_reason(spark, tmp_path, line, error):
    path = _write(tmp_path, A, line)
    assert [r["error"] for r in events.read_events_jsonl(spark, path).where("error is not null").collect()] == [error]
    with pytest.raises(ValueError, match=error):
        events.ingest_jsonl(spark, path)


def test_missing_day_and_empty_file(spark, tmp_path):
    path = _write(tmp_path, {k: v for k, v in A.items() if k not in ("t", "cell_id", "event_id")})
    df = events.ingest_jsonl(spark, path)
    assert df.first()["t"] == dt.date(1970, 1, 1) and "cell_id" not in df.columns and "event_id" not in df.columns
    with pytest.raises(ValueError, match="no events"):
        events.ingest_jsonl(spark, _write(tmp_path, " "))


def test_schema_gate(spark):
    good = spark.createDataFrame([], schema.EVENTS)
    assert schema.check_schema(good) is good
    with pytest.raises(ValueError, match="column t "):
        schema.check_schema(good.withColumn("t", F.lit(1).cast("bigint")))
    with pytest.raises(ValueError, match="missing"):
        schema.check_schema(good.drop("value"))
    with pytest.raises(ValueError, match="not allowed"):
        schema.check_schema(good.withColumn("more", F.lit(1)))
    with pytest.raises(ValueError, match="order"):
        schema.check_schema(good.select("lat", "t", "lon", "value"))
    with pytest.raises(ValueError):
        schema.require_valid(good)


def test_event_csv_panel(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("event_date,lat,lon,fatalities,more\n2020-01-01,1,2,0,x\n2020-01-01,1,2,3,x\n2020-01-02,1,2,1,x\n2020-01-02,9,8,2,x\n")
    for value, want in (("events", [[2, 1], [0, 1]]), ("fatalities", [[3, 1], [0, 2]])):
        rows = events.load_event_panel(spark, str(p), value).orderBy("cell", "t").collect()
        assert [[r["y"] for r in rows if r["cell"] == c] for c in (0, 1)] == want
    with pytest.raises(ValueError):
        events.load_event_panel(spark, str(p), "deaths")
    p.write_text("event_date,lat,lon,fatalities\n2020-01-01,1,2,0.5\n")
    with pytest.raises(ValueError, match="1 rows"):
        events.read_event_csv(spark, str(p))
    p.write_text("event_date,lat,lon\n2020-01-01,1,2\n")
    with pytest.raises(ValueError, match="missing"):
        events.read_event_csv(spark, str(p))


def test_count_matrix(spark, tmp_path):
    (tmp_path / "y_obs.csv").write_text("0,1,0,2\n3,0,0,1\n")
    np.save(tmp_path / "y.npy", np.array([[0, 1, 0, 2], [3, 0, 0, 1]]))
    np.save(tmp_path / "mobility.npy", np.array([[1.0, 0.1], [0.2, 1.0]]))
    for path in (str(tmp_path), str(tmp_path / "y_obs.csv"), str(tmp_path / "y.npy")):
        rows = events.read_count_matrix(spark, path).orderBy("cell", "t").collect()
        assert [r["y"] for r in rows] == [0, 1, 0, 2, 3, 0, 0, 1]
    m = {(r["i"], r["j"]): r["w"] for r in events.read_mobility(spark, str(tmp_path / "mobility.npy"), 2).collect()}
    assert m == {(0, 0): 1.0, (0, 1): 0.1, (1, 0): 0.2, (1, 1): 1.0}
    assert events.read_mobility(spark, None, 3).count() == 3
    with pytest.raises(ValueError):
        events.read_mobility(spark, str(tmp_path / "mobility.npy"), 3)
    for text in ("1,2\n3\n", "1,x\n", "-1,2\n", "0.5,1\n"):
        (tmp_path / "y_obs.csv").write_text(text)
        with pytest.raises(ValueError):
            events.read_count_matrix(spark, str(tmp_path))


def test_simulation_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 1, None), (1, 2, 3, 4), (1, 2, 3, None), (None, 1, 1, 1)], "location bigint, time bigint, y_true bigint, y_obs bigint")
    world, params = {"xy": [[0.1, 1 / 3]]}, {"mu": [0.1 + 0.2]}
    simulation.save_simulation(rows, str(tmp_path / "s"), world, params)
    df, w, p = simulation.load_simulation(spark, str(tmp_path / "s"))
    assert (w, p) == (world, params)
    assert {tuple(r) for r in df.collect()} == {(0, 0, 1, 0), (0, 1, 0, 0), (0, 2, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0), (1, 2, 3, 4)}
    with pytest.raises(ValueError):
        simulation.load_simulation(spark, str(tmp_path / "none"))


def test_dense_panel_and_empty(spark):
    sparse = spark.createDataFrame([(0, dt.date(2020, 1, 1), 2), (1, dt.date(2020, 1, 3), 1), (9, dt.date(2020, 1, 2), 5)], "cell int, day date, y bigint")
    cells = spark.createDataFrame([(0,), (1,)], "cell int")
    assert {tuple(r) for r in panel.dense_panel(sparse, cells).collect()} == {(0, 0, 2), (0, 1, 0), (0, 2, 0), (1, 0, 0), (1, 1, 0), (1, 2, 1)}
    assert panel.dense_panel(sparse.where("y > 50"), cells).count() == 0


def test_ordinals(spark):
    df = spark.createDataFrame([(k * 37 % 101, "x") for k in range(101)], "k int, s string")
    assert {r["n"]: r["k"] for r in panel.with_ordinal(df, ["k"], "n").collect()} == {k: k for k in range(101)}
    assert panel.with_ordinal(df.where("k > 500"), ["k"], "n").count() == 0


def test_kinds_of_values_are_checked(spark, tmp_path):
    odd = [
        ({"lat": 1, "lon": 2, "meta": {"t": 5, "value": 3}}, None),
        ({**A, "meta": None, "mark": None, "cell_id": None, "event_id": None}, None),
        ({**A, "lat": " 51.5 ", "value": "7"}, None),
        ({**A, "cell_id": "abc"}, "cell_id"),
        ({**A, "cell_id": 1.7}, "cell_id"),
        ({**A, "mark": 7}, "mark"),
        ({**A, "event_id": 7}, "event_id"),
        ({**A, "t": None}, "t"),
        ({**A, "value": None}, "value"),
        ({**A, "meta": [1]}, "meta"),
    ]
    path = _write(tmp_path, *[x for x, _ in odd])
    rows = events.read_events_jsonl(spark, path).orderBy("line_no").collect()
    assert [(r["line_no"], r["error"]) for r in rows] == [(k, e) for k, (_, e) in enumerate(odd, 1)]
    assert rows[0]["t"] == dt.date(1970, 1, 1) and rows[0]["value"] == 1 and rows[1]["meta_json"] is None and rows[2]["value"] == 7


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [json.dumps({**A, "event_id": f"e{k}"}) if k % 7 else "" for k in range(1, 400)]
    lines[250] = "broken"
    path = _write(tmp_path, *lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = events.read_events_jsonl(spark, path).collect()
        assert len(rows) == sum(x != "" for x in lines)
        assert all(lines[r["line_no"] - 1] == r["line"] for r in rows)
        with pytest.raises(ValueError, match="on line 251"):
            events.ingest_jsonl(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_mobility_of_the_loaders(spark, tmp_path):
    (tmp_path / "y_obs.csv").write_text("0,1,0,2\n3,0,0,1\n")
    one = events.load_counts(spark, str(tmp_path))
    assert one.mobility_source == "identity" and {tuple(r) for r in one.mobility.collect()} == {(0, 0, 1.0), (1, 1, 1.0)}
    np.save(tmp_path / "mobility.npy", np.array([[1.0, 0.1], [0.2, 1.0]]))
    two = events.load_counts(spark, str(tmp_path))
    assert two.mobility_source.endswith("mobility.npy") and two.mobility.count() == 4
    with pytest.raises(FileNotFoundError):
        events.load_counts(spark, str(tmp_path), str(tmp_path / "none.npy"))
    p = tmp_path / "e.csv"
    p.write_text("event_date,lat,lon,fatalities\n2020-01-01,1,2,0\n2020-01-02,9,8,2\n")
    assert events.load_events(spark, str(p), "events", str(tmp_path / "mobility.npy")).mobility.count() == 4
    with pytest.raises(FileNotFoundError):
        events.load_counts(spark, str(tmp_path / "nowhere"))
