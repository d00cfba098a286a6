import heapq
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomcast.functions import utm
from loomcast.operators import graph, poi, spatial
from loomcast.sources import bundle
from loomcast.sources.graph import read_graphml, read_pois


def test_projection_round_trip(spark):
    rng = random.Random(4)
    pts = spark.createDataFrame([(rng.uniform(0, 6), rng.uniform(-79, 84)) for _ in range(200)], "lon double, lat double")
    xy = utm.apply(pts, utm.forward("lon", "lat", 31), ["u_x", "u_y"])
    back = utm.apply(xy, utm.inverse("u_x", "u_y", 31), ["g_lon", "g_lat"])
    assert back.agg(F.max(F.abs(F.col("lon") - F.col("g_lon")) + F.abs(F.col("lat") - F.col("g_lat")))).first()[0] < 1e-9
    r = pts.first()
    x, y = spatial.project(r["lon"], r["lat"], 31)
    assert abs(xy.first()["u_x"] - x) < 1e-6 and abs(xy.first()["u_y"] - y) < 1e-6


def test_grid_centroids_map_to_their_cells(spark):
    g = spatial.grid_of_bounds(-0.2, 51.4, 0.2, 51.6, 5000.0)
    assert (g.nx, g.ny) == (6, 4)
    g2 = spatial.grid_of_bounds(-0.3, 51.2, 0.3, 51.8, 5000.0)
    assert (g2.nx, g2.ny) == (9, 13)
    cells = spatial.grid_cells(spark, g)
    assert spatial.point_to_cell(cells, g).where("cell <> cell_id").count() == 0
    assert spatial.nearest_cell(cells, g).where("cell <> cell_id").count() == 0
    back = spatial.recover_grid(cells, 5000.0, zone=g.zone)
    assert (back.nx, back.ny) == (6, 4) and abs(back.x0 - g.x0) < 1e-3
    with pytest.raises(ValueError):
        spatial.recover_grid(cells.where("cell_id = 0"), 5000.0)
    with pytest.raises(ValueError):
        spatial.recover_grid(cells.where("cell_id <> 3"), 5000.0)
    with pytest.raises(ValueError):
        spatial.grid_of_bounds(-0.2, 51.4, 0.2, 51.6, 0)
    odd = spark.createDataFrame([(10.0, 0.0), (None, 51.5), (float("nan"), 51.5), (0.0, 99.0)], "lon double, lat double")
    assert [r["cell"] for r in spatial.point_to_cell(odd, g).collect()] == [-1] * 4


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 5), st.integers(0, 3), st.floats(0, 1, exclude_max=True), st.floats(0, 1, exclude_max=True))
def test_left_and_lower_edges_belong(ix, iy, fx, fy):
    import duckdb

    g = spatial.GridShape(31, 1000.0, 2000.0, 6, 4, 50.0)
    x, y = g.x0 + (ix + fx) * 50.0, g.y0 + (iy + fy) * 50.0
    got = duckdb.sql(f"SELECT {spatial.cell_sql(g, utm.num(x), utm.num(y))}").fetchall()[0][0]
    inside = x < g.x0 + 300 and y < g.y0 + 200
    assert got == (int((y - g.y0) // 50) * 6 + int((x - g.x0) // 50) if inside else -1)


def test_zone_codes(spark):
    df = spark.createDataFrame([(-180.0, 10.0), (3.0, -1.0), (180.0, 0.0)], "lon double, lat double")
    assert [r[0] for r in df.select(spatial.utm_epsg(F.col("lon"), F.col("lat"))).collect()] == ["EPSG:32601", "EPSG:32731", "EPSG:32661"]
    assert utm.zone_of(180.0) == 60


def test_nearest_node(spark):
    rng = random.Random(8)
    nodes = [(k, rng.uniform(0, 1000), rng.uniform(0, 1000)) for k in range(60)] + [(100, 5.0, 5.0), (101, 5.0, 5.0)]
    pts = [(k, rng.uniform(-3000, 4000), rng.uniform(-50, 1100)) for k in range(40)] + [(99, 5.0, 5.0)]
    n, p = spark.createDataFrame(nodes, "node bigint, x double, y double"), spark.createDataFrame(pts, "cell int, x double, y double")
    got = {r["cell"]: r["node"] for r in graph.nearest_node(p, n, 60.0).collect()}
    assert got == {c: min(nodes, key=lambda m: ((m[1] - x) ** 2 + (m[2] - y) ** 2, m[0]))[0] for c, x, y in pts}  # noqa: B023
    assert graph.nearest_node(p, n.where("node < 0"), 60.0).count() == 0


def test_cutoff_paths_equal_dijkstra(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(25), rng.randrange(25), float(rng.randrange(0, 60))) for _ in range(90)] + [(0, 1, None)]
    near = {}
    for u, v, w in edges:
        if w is not None:
            near.setdefault(u, []).append((v, w))
    want = {}
    for s in range(25):
        best, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for v, w in near.get(u, ()):
                if d + w <= 80 and d + w < best.get(v, 1e9):
                    best[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        want |= {(s, v): d for v, d in best.items()}
    e = spark.createDataFrame(edges, "u int, v int, travel_time double")
    s = spark.createDataFrame([(k,) for k in range(25)], "node int")
    assert {(r["src"], r["node"]): r["d"] for r in graph.cutoff_paths(e, s, 80.0).collect()} == want
    with pytest.raises(ValueError):
        graph.cutoff_paths(spark.createDataFrame([(0, 1, -1.0)], "u int, v int, travel_time double"), s, 1.0)


def test_travel_time_imputation(spark):
    e = spark.createDataFrame([("a", "b", 100.0, None, "residential"), ("b", "a", 100.0, 60.0, None), ("a", "c", 100.0, None, None)], "u string, v string, length double, travel_time double, highway string")
    assert [round(r["travel_time"], 6) for r in graph.impute_travel_time(e).collect()] == [12.0, 60.0, 7.2]


def test_min_travel_times(spark):
    m = np.array([[0, 5, 9], [5, 0, 2], [9, 2, 0]], float)
    nb = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(3) for j in range(3)], "i int, j int, travel_time_s double")
    masks = spark.createDataFrame([(0, False, False), (1, True, False), (2, False, True)], "cell int, a boolean, b boolean")
    rows = poi.min_travel_times(nb, masks, ["a", "b"], 99.0).orderBy("cell").collect()
    assert [tuple(r)[1:] for r in rows] == [(5.0, 9.0), (0.0, 2.0), (2.0, 0.0)]
    none = poi.min_travel_times(nb.where("i = j"), masks, ["a"], 99.0).orderBy("cell").collect()
    assert [r[1] for r in none] == [99.0, 0.0, 99.0]


GRAPHML = """<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="x" attr.type="double"/><key id="d1" for="node" attr.name="y" attr.type="double"/>
<key id="d2" for="edge" attr.name="travel_time" attr.type="double"/><key id="d3" for="edge" attr.name="length" attr.type="double"/><graph edgedefault="directed">
<node id="0"><data key="d0">-0.100</data><data key="d1">51.5</data></node><node id="1"><data key="d0">-0.099</data><data key="d1">51.5</data></node><node id="2"><data key="d0">-0.098</data><data key="d1">51.5</data></node>
%s</graph></graphml>""" % "".join(f'<edge source="{u}" target="{v}"><data key="d2">60</data><data key="d3">100</data></edge>' for u, v in ((0, 1), (1, 0), (1, 2), (2, 1)))


def _files(tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    feature = lambda a: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-0.099, 51.5]}, "properties": {"amenity": a}}
    area = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[-0.1, 51.5], [-0.098, 51.5], [-0.099, 51.503]]]}, "properties": {}}
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("school"), feature("school"), feature("hospital"), area, {"type": "Feature", "geometry": None, "properties": {}}]}))


def test_graph_and_point_files(spark, tmp_path):
    _files(tmp_path)
    nodes, edges = read_graphml(spark, str(tmp_path / "g.graphml"))
    assert nodes.count() == 3 and edges.count() == 4
    got = graph.cutoff_paths(edges, nodes.select("node"), 61.0)
    assert got.count() == 7
    pois = read_pois(spark, str(tmp_path / "p.geojson"), ("amenity",))
    assert pois.count() == 4 and pois.where("amenity = 'school'").count() == 2
    assert abs(pois.where("amenity is null").first()["lat"] - 51.501) < 1e-9


def test_bundle_is_cached_and_reproducible(spark, tmp_path):
    _files(tmp_path)
    made = {}
    for name in ("a", "b"):
        c = bundle.SubstrateConfig(graphml_path=str(tmp_path / "g.graphml"), cell_size_m=50.0, max_travel_time_s=61.0, poi_path=str(tmp_path / "p.geojson"), poi_tags={"amenity": ["school", "hospital"]}, poi_travel_time_features=True, cache_dir=str(tmp_path / name))
        made[name] = bundle.build(spark, c)
    assert made["a"].meta["bundle_sha256"] == made["b"].meta["bundle_sha256"]
    s = made["a"]
    assert s.poi.columns == ["cell", "poi_count", "poi_min_travel_time_s", "poi_amenity=hospital_min_travel_time_s", "poi_amenity=school_min_travel_time_s", "amenity=hospital", "amenity=school"]
    assert s.poi.agg(F.sum("poi_count"), F.sum("`amenity=school`")).first()[:] == (4.0, 2.0)
    assert s.neighbours.where("i = j and travel_time_s = 0").count() == s.grid.count()
    again = bundle.build(spark, bundle.SubstrateConfig(graphml_path=str(tmp_path / "g.graphml"), cell_size_m=100.0, max_travel_time_s=61.0, cache_dir=str(tmp_path / "a")))
    assert again.shape.size == 100.0 and again.poi is None  # another configuration isn't served from the cache
    with pytest.raises(NotImplementedError):
        bundle.build(spark, bundle.SubstrateConfig(place="Anywhere"))
    with pytest.raises(TypeError):
        bundle.SubstrateConfig(unknown=1)


def test_tag_features():
    assert poi.tag_features({"b": True, "a": ["y", "x"], "c": False, "d": "z"}) == [("a", "x"), ("a", "y"), ("b", None)]
