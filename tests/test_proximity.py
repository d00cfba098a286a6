import datetime as dt
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcast.operators import proximity as px


def _area(tri):
    return sum(abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in ((t[:2], t[2:4], t[4:]) for t in tri))


def test_ear_clipping_keeps_the_area():
    star = [(math.cos(k * math.pi / 7) * (2 if k % 2 else 5), math.sin(k * math.pi / 7) * (2 if k % 2 else 5)) for k in range(14)]
    x, y = map(np.array, zip(*star))
    want = abs(sum(star[k - 1][0] * star[k][1] - star[k][0] * star[k - 1][1] for k in range(14))) / 2
    for a, b in ((x, y), (x[::-1], y[::-1])):
        tri = px.ear_clip(a, b)
        assert len(tri) == 12 and math.isclose(_area(tri), want)


def test_ear_clipping_of_degenerate_polygons():
    assert len(px.ear_clip(np.array([0, 1, 2]), np.array([0, 1, 2]))) == 0
    assert len(px.ear_clip(np.array([0, 1, float("nan")]), np.array([0, 1, 0]))) == 0
    assert len(px.ear_clip(np.array([]), np.array([]))) == 0
    assert _area(px.ear_clip(np.array([0, 0, 1, 2, 2, 2, 0]), np.array([0, 0, 0, 0, 0, 2, 2]))) == 4


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 60), st.integers(0, 2**20))
def test_hierarchy_finds_every_triangle(n, seed):
    rng = np.random.default_rng(seed)
    tri, x, y = rng.uniform(0, 1, (n, 6)), rng.uniform(0, 1, 80), rng.uniform(0, 1, 80)
    got = {(int(p), int(t)) for ps, ts in px.Hierarchy(tri).stab(x, y) for p, t in zip(ps, ts)}
    want = {(p, t) for p in range(80) for t in range(n) if px.in_triangle(tri[t : t + 1], x[p : p + 1], y[p : p + 1])[0]}
    assert got == want


def test_cuts_give_a_point_one_leaf_and_boxes_all():
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0, 1, 500), rng.uniform(0, 1, 500)
    cuts = px.Cuts(x, y, 16)
    row, leaf = cuts.leaves_of_boxes(x, y, x, y)
    assert sorted(row.tolist()) == list(range(500)) and np.bincount(leaf, minlength=16).max() < 60
    home = dict(zip(row.tolist(), leaf.tolist()))
    box, leaves = cuts.leaves_of_boxes(np.array([0.2]), np.array([0.3]), np.array([0.6]), np.array([0.7]))
    inside = {home[k] for k in range(500) if 0.2 <= x[k] <= 0.6 and 0.3 <= y[k] <= 0.7}
    assert inside <= set(leaves.tolist())


def _squares(spark):
    rows = [(i + 3 * j, [i, i + 1.0, i + 1.0, float(i)], [float(j), float(j), j + 1.0, j + 1.0]) for i in range(3) for j in range(3)]
    return spark.createDataFrame([(r, [float(v) for v in a], b) for r, a, b in rows] + [(None, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]), (99, None, None), (98, [0.0], [0.0])], "region_id bigint, xs array<double>, ys array<double>")


def test_region_of_points_both_ways(spark, monkeypatch):
    pts = [(0.5, 0.5, "a"), (1.0, 0.5, "edge"), (1.0, 1.0, "corner"), (9.0, 0.0, "out"), (None, 1.0, "null"), (float("nan"), 1.0, "nan"), (float("inf"), 1.0, "inf"), (0.5, 0.5, "a")]
    df = spark.createDataFrame(pts, "x double, y double, region_id string")  # the output's name is taken
    want = sorted([(0.5, 0.5, 0)] * 2 + [(1.0, 0.5, 1), (1.0, 1.0, 4)])
    for limit in (10**6, 0):
        monkeypatch.setattr(px, "SENT_TRIANGLES", limit)
        monkeypatch.setattr(px, "LEAF_POINTS", 2)
        out = px.region_of_points(df, _squares(spark)).collect()
        assert len(out) == len(pts)
        assert sorted((r["x"], r["y"], r["region_id"]) for r in out if r["region_id"] is not None) == want
        assert px.region_of_points(df, _squares(spark).where("region_id < 0")).where("region_id is not null").count() == 0
        assert px.region_of_points(df.where("x > 100 and x < 101"), _squares(spark)).count() == 0


def _brute(rows, metres, days):
    ok = {}
    for i, lat, lon, t in rows:
        if i is not None and t is not None and lat is not None and lon is not None and not math.isnan(lat) and not math.isnan(lon) and abs(lat) <= 90 and abs(lon) <= 180:
            ok[i] = (lat, lon, t)
    out = set()
    for a in ok:
        for b in ok:
            if a < b and ok[a][:2] != ok[b][:2] and abs((ok[a][2] - ok[b][2]).days) <= days:
                if px.great_circle_m(*map(np.array, (*ok[a][:2], *ok[b][:2]))) <= metres:
                    out.add((a, b))
    return out


def test_close_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(px, "LEAF_POINTS", 40)
    rng = random.Random(3)
    day = dt.date(2025, 1, 1)
    rows = []
    for k in range(350):
        lat, lon = rng.choice([(47.0, 3.0), (89.9999, 10.0), (-30.0, 179.9999), (-30.0, -179.9999)])
        rows.append((f"e{k:04d}", lat + rng.uniform(-3e-4, 9e-5), max(-180.0, min(180.0, lon + rng.uniform(-3e-4, 3e-4))) if abs(lat) < 80 else rng.uniform(-180, 180), day + dt.timedelta(rng.randrange(60))))
    rows += [(f"h{k:03d}", 47.0, 3.0, day + dt.timedelta(k % 9)) for k in range(60)]  # one place with many events
    rows += rows[:40] + [(None, 47.0, 3.0, day), ("x1", None, 3.0, day), ("x2", float("nan"), 3.0, day), ("x3", 999.0, 3.0, day), ("x4", 47.0, 3.0, None)]
    df = spark.createDataFrame(rows, "event_id string, lat double, lon double, t date")
    got = [tuple(r) for r in px.close_pairs(df, 30.0, 2).collect()]
    want = _brute(rows, 30.0, 2)
    assert len(want) > 300 and set(got) == want and len(got) == len(want)
    assert px.close_pairs(df.where("lat > 1000"), 30.0, 2).count() == 0


def test_broken_polygons_are_reported(spark):
    shapes = [(1, [0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0]), (2, [0.0, 2.0, 0.0, 3.0], [0.0, 2.0, 2.0, 0.0]), (3, [0.0, float("nan"), 1.0], [0.0, 0.0, 1.0]), (4, [], []), (5, None, [1.0]), (None, [0.0], [0.0])]
    rows = spark.createDataFrame(shapes, "region_id bigint, xs array<double>, ys array<double>")
    assert {r["region_id"] for r in px.broken_regions(rows).collect()} == {2, 3, 5}


def test_site_links_equal_pairs(spark):
    rng = random.Random(4)
    day = dt.date(2024, 1, 1)
    rows = [(rng.choice([None, *(f"e{k}" for k in range(60))]), 50 + rng.randrange(4) * 2e-4, 2 + rng.randrange(4) * 2e-4, rng.choice([None, *(day + dt.timedelta(k) for k in range(5))])) for _ in range(150)]
    df = spark.createDataFrame(rows, "event_id string, lat double, lon double, t date")
    got = {(r["lat"], r["lon"], r["day"]): (r["events"], r["near_sites"], r["near_events"]) for r in px.site_links(df, 30.0, 2).collect()}
    sites = {}
    for i, la, lo, t in rows:
        if i is not None and t is not None:
            sites.setdefault((la, lo, t), set()).add(i)
    want = {}
    for (la, lo, t), own in sites.items():
        near = [o for (a, b, u), o in sites.items() if (a, b) != (la, lo) and abs((u - t).days) <= 2 and float(px.great_circle_m(np.array(la), np.array(lo), np.array(a), np.array(b))) <= 30]
        want[la, lo, t] = (len(own), len(near), sum(map(len, near)))
    assert got == want and px.site_links(df.where("lat > 80"), 30.0, 2).count() == 0
