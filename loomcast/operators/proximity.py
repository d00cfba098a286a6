"""Points near other points, and the region that holds a point (problem 2).

Polygons are cut into triangles by ear clipping. The plane is split by a tree of median cuts; every leaf gets the points
inside it and the triangles whose box touches it, so that a leaf is one bounded task. In a leaf a bounding-volume
hierarchy over the triangles yields candidates that an exact test decides; a point on an edge shared by regions is
assigned once. A distance search uses polygons that enclose the circle around each location, then the exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcast.operators.skew import salted_join
from loomcast.session import materialise

#: Locations in a leaf, about; a leaf is one task of known size, however dense the place.
LEAF_POINTS = 50_000
#: Locations sampled to place the cuts at least, and for each leaf (16 bytes a location).
SAMPLE_POINTS, SAMPLE_A_LEAF = 100_000, 8
#: Regions' triangles up to this count are sent to every task (72 bytes each, 18 MB at most).
SENT_TRIANGLES = 250_000
EARTH_RADIUS_M = 6371008.8


# --- polygons ----------------------------------------------------------------


def ear_clip(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Triangles (k, 6) of a simple polygon given by its corners in either direction, the last not repeating the first.

    Repeated and collinear corners are dropped. A polygon with no area, or with a coordinate that isn't finite, has no
    triangles. Quadratic in the number of corners.
    """
    pts = [(float(a), float(b)) for a, b in zip(x, y)]
    if any(not math.isfinite(v) for p in pts for v in p):
        return np.empty((0, 6))
    pts = [p for k, p in enumerate(pts) if p != pts[k - 1]] if len(pts) > 1 else []
    area = sum(pts[k - 1][0] * p[1] - p[0] * pts[k - 1][1] for k, p in enumerate(pts))
    if area < 0:
        pts.reverse()

    def turn(a: tuple, b: tuple, c: tuple) -> float:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    out, k, since = [], 0, 0
    while len(pts) > 2:
        k %= len(pts)
        a, b, c = pts[k - 1], pts[k], pts[(k + 1) % len(pts)]
        bend = turn(a, b, c)
        if bend == 0:
            pts.pop(k)
            since = 0
            continue
        ear = bend > 0 and not any(p not in (a, b, c) and turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in pts)
        if ear:
            out.append((*a, *b, *c))
            pts.pop(k)
            since = 0
        else:
            k, since = k + 1, since + 1
            if since > len(pts):  # not simple: nothing more can be cut off
                break
    return np.array(out, float).reshape(-1, 6)


_TRIANGLE = "ax double, ay double, bx double, by double, cx double, cy double"


def triangulate(regions: DataFrame) -> DataFrame:
    """``region_id long, xs array<double>, ys array<double>`` to one row a triangle; regions without area give none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [(i, ear_clip(x, y)) for i, x, y in zip(b["region_id"], b["xs"], b["ys"]) if x is not None and y is not None and len(x) == len(y)]
            ids = np.concatenate([np.full(len(t), i, "int64") for i, t in parts]) if parts else np.empty(0, "int64")
            tri = np.concatenate([t for _, t in parts]) if parts else np.empty((0, 6))
            yield pd.DataFrame({"region_id": ids, **{n: tri[:, k] for k, n in enumerate(("ax", "ay", "bx", "by", "cx", "cy"))}})

    return regions.where("region_id is not null").select("region_id", "xs", "ys").mapInPandas(cut, f"region_id long, {_TRIANGLE}")


def broken_regions(regions: DataFrame) -> DataFrame:
    """``region_id, area, covered``: polygons that triangles don't cover to a millionth, as their edges cross or a corner isn't finite.

    Both areas are in square units of the coordinates; ``area`` is null where a corner isn't finite or the arrays differ in length.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, x, y in zip(b["region_id"], b["xs"], b["ys"]):
                if x is None or y is None or len(x) != len(y) or not (np.isfinite(x).all() and np.isfinite(y).all()):
                    out.append((i, None, 0.0))
                    continue
                t = ear_clip(x, y)
                area = abs(float((np.roll(x, 1) * y - x * np.roll(y, 1)).sum())) / 2 if len(x) else 0.0
                covered = float(np.abs((t[:, 2] - t[:, 0]) * (t[:, 5] - t[:, 1]) - (t[:, 3] - t[:, 1]) * (t[:, 4] - t[:, 0])).sum()) / 2
                if abs(area - covered) > 1e-6 * max(area, covered):
                    out.append((i, area, covered))
            yield pd.DataFrame(out, columns=["region_id", "area", "covered"]).astype({"area": float})

    return regions.where("region_id is not null").select("region_id", "xs", "ys").mapInPandas(measure, "region_id long, area double, covered double")


# --- bounding-volume hierarchy -----------------------------------------------


class Hierarchy:
    """Boxes over triangles (n, 6), a complete binary tree in arrays: node k has children 2k+1 and 2k+2."""

    LEAF = 4

    def __init__(self, tri: np.ndarray) -> None:
        self.tri = tri
        n = len(tri)
        lo = np.column_stack([tri[:, 0::2].min(1), tri[:, 1::2].min(1)]) if n else np.empty((0, 2))
        hi = np.column_stack([tri[:, 0::2].max(1), tri[:, 1::2].max(1)]) if n else np.empty((0, 2))
        self.depth = max(0, math.ceil(math.log2(max(1, n / self.LEAF))))
        centre, order, bounds = (lo + hi) / 2, np.arange(n), np.array([0, n])
        for level in range(self.depth):  # split every run at its median, by turns in x and y
            key = centre[order, level % 2]
            run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            order = order[np.lexsort((key, run))]
            mid = (bounds[:-1] + bounds[1:] + 1) // 2
            bounds = np.sort(np.concatenate([bounds, mid]))
        self.order, self.bounds = order, bounds
        leaves = 1 << self.depth
        box = np.full((2 * leaves - 1, 4), np.inf)
        box[:, 2:] = -np.inf
        if n:
            run = np.repeat(np.arange(leaves), np.diff(bounds))
            leaf = box[leaves - 1 :]
            for k, f, v in ((0, np.minimum, lo[:, 0]), (1, np.minimum, lo[:, 1]), (2, np.maximum, hi[:, 0]), (3, np.maximum, hi[:, 1])):
                col = leaf[:, k].copy()
                f.at(col, run, v[order])
                leaf[:, k] = col
            for level in range(self.depth - 1, -1, -1):
                at, kids = np.arange((1 << level) - 1, (2 << level) - 1), np.arange((2 << level) - 1, (4 << level) - 1)
                pair = box[kids].reshape(-1, 2, 4)
                box[at, :2], box[at, 2:] = pair[:, :, :2].min(1), pair[:, :, 2:].max(1)
        self.box = box

    def stab(self, x: np.ndarray, y: np.ndarray, step: int = 65536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (point, triangle) where the closed triangle holds the point, in blocks of points."""
        first = (1 << self.depth) - 1
        for start in range(0, len(x), step):
            p = np.arange(start, min(len(x), start + step))
            node = np.zeros(len(p), np.int64)
            for level in range(self.depth + 1):
                b = self.box[node]
                px, py = x[p], y[p]
                ok = (px >= b[:, 0]) & (py >= b[:, 1]) & (px <= b[:, 2]) & (py <= b[:, 3])
                p, node = p[ok], node[ok]
                if level < self.depth:
                    p, node = np.repeat(p, 2), np.repeat(2 * node + 1, 2)
                    node[1::2] += 1
            leaf = node - first
            size = self.bounds[leaf + 1] - self.bounds[leaf]
            p, at = np.repeat(p, size), np.repeat(self.bounds[leaf], size)
            at += np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            t = self.order[at]
            inside = in_triangle(self.tri[t], x[p], y[p])
            yield p[inside], t[inside]


def in_triangle(tri: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each point lies in its triangle, edges and corners included, whichever way the corners run."""
    ax, ay, bx, by, cx, cy = tri.T
    u = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    v = (cx - bx) * (y - by) - (cy - by) * (x - bx)
    w = (ax - cx) * (y - cy) - (ay - cy) * (x - cx)
    return ((u >= 0) & (v >= 0) & (w >= 0)) | ((u <= 0) & (v <= 0) & (w <= 0))


# --- cuts of the plane ---------------------------------------------------------


class Cuts:
    """Median cuts of a sample of points into 2^depth leaves that cover the whole plane; a pure function of the sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray, leaves: int) -> None:
        self.depth = max(0, math.ceil(math.log2(max(1, leaves))))
        self.at = np.zeros((1 << self.depth) - 1)
        self.axis = np.zeros((1 << self.depth) - 1, np.int8)
        parts = [np.column_stack([x, y])]
        for node in range(len(self.at)):
            pts = parts[node]
            if len(pts):
                spread = pts.max(0) - pts.min(0)
                self.axis[node] = int(spread[1] > spread[0])
                self.at[node] = np.median(pts[:, self.axis[node]])
            low = pts[:, self.axis[node]] < self.at[node]
            parts += [pts[low], pts[~low]]
            parts[node] = None

    def leaves_of_boxes(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (box, leaf) of all leaves a closed box touches; for a point (x0 = x1, y0 = y1) exactly one."""
        box, node = np.arange(len(x0)), np.zeros(len(x0), np.int64)
        lo, hi = np.column_stack([x0, y0]), np.column_stack([x1, y1])
        for _ in range(self.depth):
            axis, at = self.axis[node], self.at[node]
            left, right = lo[box, axis] < at, hi[box, axis] >= at
            box, node = np.concatenate([box[left], box[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return box, node - len(self.at)


def _cuts(points: DataFrame, n: int, most: int) -> Cuts:
    """Cuts for ``n`` points of which at most ``most`` meet at once; without a sample where one leaf will do."""
    if most <= LEAF_POINTS:
        return Cuts(np.empty(0), np.empty(0), 1)
    leaves = math.ceil(most / LEAF_POINTS)
    size = max(SAMPLE_POINTS, SAMPLE_A_LEAF * leaves)
    sample = points if n <= size else points.sample(min(1.0, 0.9 * size / n), seed=7)
    rows = sample.select("x", "y").limit(size).toPandas().drop_duplicates()
    return Cuts(rows["x"].to_numpy(), rows["y"].to_numpy(), leaves)


# --- region of each point --------------------------------------------------------


def region_of_points(points: DataFrame, regions: DataFrame, x: str = "x", y: str = "y", *, out: str = "region_id", sent: int = SENT_TRIANGLES) -> DataFrame:
    """``points`` with a column ``out``: the region that holds the point (closed regions), or null.

    ``regions``: ``region_id, xs, ys``. A point on the shared edge of several regions gets the greatest id, which on
    a grid numbered row by row makes left and lower edges belong to a cell. Points whose coordinates are null, NaN or
    infinite get null. Columns of ``points`` are kept as they are; a column named like ``out`` is replaced.
    Without regions every point gets null.

    Regions of up to ``sent`` triangles (counted first) go to every task as one hierarchy, without any shuffle;
    beyond, points and triangles meet leaf by leaf.
    """
    points = points.drop(out)
    tri = materialise(triangulate(regions))
    if tri.count() <= sent:
        rows = tri.toPandas()
        ids, corners = rows["region_id"].to_numpy(), rows[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy()
        sent = points.sparkSession.sparkContext.broadcast((ids, corners))

        @F.pandas_udf(T.LongType())
        def holder(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            ids, corners = sent.value
            tree = Hierarchy(corners)
            for a, b in parts:
                yield _holder(tree, ids, a.to_numpy(float, na_value=np.nan), b.to_numpy(float, na_value=np.nan))

        return points.withColumn(out, holder(F.col(x).cast("double"), F.col(y).cast("double")))
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    places = materialise(points.where(finite(x) & finite(y)).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.lit(1).alias("one")).select("x", "y"))
    n = places.count()
    cuts = _cuts(places, n, n)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = b[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy()
            xs, ys = c[:, 0::2], c[:, 1::2]
            row, leaf = cuts.leaves_of_boxes(xs.min(1), ys.min(1), xs.max(1), ys.max(1))
            yield b.iloc[row].assign(leaf=leaf)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            px, py = b["x"].to_numpy(), b["y"].to_numpy()
            row, leaf = cuts.leaves_of_boxes(px, py, px, py)
            yield b.iloc[row].assign(leaf=leaf)

    def meet(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        tree = Hierarchy(t[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy())
        return p[["x", "y"]].assign(region=_holder(tree, t["region_id"].to_numpy(), p["x"].to_numpy(), p["y"].to_numpy()))

    left = places.mapInPandas(home, "x double, y double, leaf long").groupBy("leaf")
    right = tri.mapInPandas(spread, f"region_id long, {_TRIANGLE}, leaf long").groupBy("leaf")
    found = left.cogroup(right).applyInPandas(meet, "x double, y double, region long").where("region is not null")
    keyed = points.withColumns({"__x": F.col(x).cast("double"), "__y": F.col(y).cast("double")})
    found = found.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("region").alias(out))
    return salted_join(keyed, found, ["__x", "__y"], F.struct(*[F.col(f"`{c}`") for c in points.columns]), how="left").drop("__x", "__y")


def _holder(tree: Hierarchy, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> pd.Series:
    best = np.full(len(x), -1, np.int64)
    seen = np.zeros(len(x), bool)
    for p, t in tree.stab(x, y):
        fresh = p[~seen[p]]
        best[fresh] = np.iinfo(np.int64).min
        seen[p] = True
        np.maximum.at(best, p, ids[t])
    return pd.Series(best).astype("Int64").where(seen)


# --- locations within a distance -------------------------------------------------


def _enclosing(lat: np.ndarray, lon: np.ndarray, metres: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Degrees west, south, east, north of a box that holds the circle around each location, with room for rounding."""
    angle = metres / radius * (1 + 1e-7) + 1e-12
    north, south = lat + math.degrees(angle), lat - math.degrees(angle)
    polar = (north >= 90) | (south <= -90)
    with np.errstate(invalid="ignore"):
        half = np.where(polar, 180.0, np.degrees(np.arcsin(np.minimum(1.0, math.sin(min(angle, math.pi / 2)) / np.maximum(np.cos(np.radians(lat)), 1e-300)))) * (1 + 1e-9))
    return lon - half, np.maximum(south, -90), lon + half, np.minimum(north, 90)


#: The enclosing polygon has corners (0,0), (1,0), (1,1), (0,1) of its box; cut once, its triangles serve all boxes.
_UNIT = ear_clip(np.array([0.0, 1.0, 1.0, 0.0]), np.array([0.0, 0.0, 1.0, 1.0]))


def _box_triangles(w: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.empty((len(w), len(_UNIT), 6))
    for k in range(3):
        out[:, :, 2 * k] = np.where(_UNIT[:, 2 * k] > 0, e[:, None], w[:, None])
        out[:, :, 2 * k + 1] = np.where(_UNIT[:, 2 * k + 1] > 0, n[:, None], s[:, None])
    return out.reshape(-1, 6)


def great_circle_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, radius: float = EARTH_RADIUS_M) -> np.ndarray:
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.minimum(1.0, np.sqrt(a)))


#: Candidate pairs of a task that are held at once, or a single site's partners if these are more.
PAIRS_AT_ONCE = 20_000_000


def _densest(lon: np.ndarray, lat: np.ndarray, metres: float, radius: float) -> int:
    """Sites in the fullest nine tiles of a lattice as wide as the distance (in latitude): a bound on a site's partners away from the poles."""
    if not len(lat):
        return 0
    step = math.degrees(metres / radius) or 1.0
    row = np.floor(lat / step).astype(np.int64)
    column = np.floor(lon / (step / max(1e-3, math.cos(math.radians(min(89.9, float(np.abs(lat).max()))))))).astype(np.int64)
    _, n = np.unique(row * 4_000_000_007 + column, return_counts=True)
    return int(9 * n.max())


_PAIR = "lat_a double, lon_a double, day_a int, lat_b double, lon_b double, day_b int"


def near_sites(sites: DataFrame, metres: float, days: int, *, radius: float = EARTH_RADIUS_M, rows: DataFrame | None = None) -> DataFrame:
    """Pairs ``lat_a, lon_a, day_a, lat_b, lon_b, day_b`` at most ``metres`` (on a sphere) and ``days`` apart, (lat_a, lon_a) < (lat_b, lon_b).

    ``sites``: distinct finite ``lat`` (-90..90), ``lon`` (-180..180) and ``day`` int. Each pair occurs once; sites at one
    location are no pair. ``rows``: what the sites were reduced from, to count and sample without reducing it once more
    (leaves then come out smaller than need be, never larger). Circles that cross the date line or hold a pole are covered. Besides place, tasks are split by
    periods of days, so a location of any age brings a bounded number of sites to a task. Empty input gives no pairs.
    """
    period = max(20, 4 * (2 * days + 1))
    rows = sites if rows is None else rows
    most = rows.groupBy(F.floor(F.col("day") / F.lit(period)).alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    cuts = _cuts(rows.select(F.col("lon").alias("x"), F.col("lat").alias("y")), most["n"] or 0, most["most"] or 0)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lat, lon, day = b["lat"].to_numpy(), b["lon"].to_numpy(), b["day"].to_numpy(np.int64)
            w, s, e, n = _enclosing(lat, lon, metres, radius)
            row, leaf = cuts.leaves_of_boxes(lon, lat, lon, lat)
            home = np.empty(len(lat), np.int64)
            home[row] = leaf
            rows, leaves, shifts = [], [], []
            for turn in (0.0, 360.0, -360.0):  # the circle as seen from beyond the date line
                at = np.flatnonzero((w + turn <= 180) & (e + turn >= -180))
                box, leaf = cuts.leaves_of_boxes(w[at] + turn, s[at], e[at] + turn, n[at])
                rows.append(at[box]), leaves.append(leaf), shifts.append(np.full(len(box), turn))
            row, leaf, shift = np.concatenate(rows), np.concatenate(leaves), np.concatenate(shifts)
            own, first, last = day // period, (day - days) // period, (day + days) // period
            for k in range(int((last - first).max()) + 1 if len(day) else 0):
                at = np.flatnonzero(first[row] + k <= last[row])
                r, p = row[at], first[row[at]] + k
                yield pd.DataFrame({"leaf": leaf[at], "period": p, "lat": lat[r], "lon": lon[r], "day": day[r], "shift": shift[at], "home": (leaf[at] == home[r]) & (shift[at] == 0) & (p == own[r])})

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat([*parts])
        lat, lon, day, home, shift = (part[c].to_numpy() for c in ("lat", "lon", "day", "home", "shift"))
        w, s, e, n = _enclosing(lat, lon, metres, radius)
        tree = Hierarchy(_box_triangles(w + shift, s, e + shift, n))
        at = np.flatnonzero(home)
        # a block of homes at a time goes out, so that dense places never have all their pairs in memory
        for p, t in tree.stab(lon[at], lat[at], max(1, PAIRS_AT_ONCE // max(1, _densest(lon[at], lat[at], metres, radius)))):
            b, a = at[p], t // len(_UNIT)
            ok = ((lat[a] < lat[b]) | ((lat[a] == lat[b]) & (lon[a] < lon[b]))) & (np.abs(day[a] - day[b]) <= days)
            a, b = a[ok], b[ok]
            ok = great_circle_m(lat[a], lon[a], lat[b], lon[b], radius) <= metres
            # a point on the edge that two triangles of one polygon share belongs to it once
            a, b = np.divmod(np.unique(a[ok] * len(lat) + b[ok]), max(1, len(lat)))
            out = pd.DataFrame({"lat_a": lat[a], "lon_a": lon[a], "day_a": day[a], "lat_b": lat[b], "lon_b": lon[b], "day_b": day[b]})
            yield out.drop_duplicates() if shift.any() else out

    placed = sites.select("lat", "lon", "day").mapInPandas(spread, "leaf int, period int, lat double, lon double, day int, shift double, home boolean")
    return placed.groupBy("leaf", "period").applyInPandas(meet, _PAIR)


def close_pairs(events: DataFrame, metres: float, days: int, *, id_col: str = "event_id", lat: str = "lat", lon: str = "lon", day: str = "t", radius: float = EARTH_RADIUS_M) -> DataFrame:
    """Pairs ``{id}_a < {id}_b`` of different events at different coordinates, at most ``metres`` and ``days`` apart.

    Left out: rows without id or day, and positions that are null, NaN or out of range. Repeated rows count once; should
    rows of one id disagree, it is at each of its positions, and a pair still comes once. Events at identical
    coordinates are no pair. Distinct sites (place and day) are paired first, however many events they hold; only
    events at a paired site are then joined to the pairs, a hot site's spread by salt.
    """
    good = events.where(F.col(id_col).isNotNull() & F.col(day).isNotNull() & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    # + 0 makes -0.0 and 0.0 one
    good = good.select(F.col(id_col).alias("id"), (F.col(lat) + F.lit(0.0)).alias("lat"), (F.col(lon) + F.lit(0.0)).alias("lon"), F.unix_date(F.col(day).cast("date")).alias("day"))
    pairs = materialise(near_sites(good.groupBy("lat", "lon", "day").agg(F.lit(1).alias("one")).select("lat", "lon", "day"), metres, days, radius=radius, rows=good))
    site = ["lat", "lon", "day"]
    ends = [pairs.select(*[F.col(f"{c}_{e}").alias(c) for c in site]) for e in "ab"]
    held = materialise(salted_join(good, ends[0].unionByName(ends[1]).distinct(), site, F.col("id"), how="left_semi").distinct())
    left = held.withColumnsRenamed({"id": "a", **{c: f"{c}_a" for c in site}})
    right = held.withColumnsRenamed({"id": "b", **{c: f"{c}_b" for c in site}})
    first = salted_join(left, pairs, [f"{c}_a" for c in site], F.col("a")).select("a", "lat_b", "lon_b", "day_b")
    joined = salted_join(right, first, [f"{c}_b" for c in site], F.col("b")).where("a <> b")
    return joined.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b")).distinct()


def site_links(events: DataFrame, metres: float, days: int, *, id_col: str = "event_id", lat: str = "lat", lon: str = "lon", day: str = "t", radius: float = EARTH_RADIUS_M) -> DataFrame:
    """``lat, lon, day, events, near_sites, near_events``: classes of events at one place and day, with their links to other classes.

    The same closeness as ``close_pairs``, without expanding copies into pairs: a row a class (none left out), its number of
    different events, of other classes within reach, and of their events. An event that lies in several classes counts in each.
    """
    good = events.where(F.col(id_col).isNotNull() & F.col(day).isNotNull() & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    good = good.select(F.col(id_col).alias("id"), (F.col(lat) + F.lit(0.0)).alias("lat"), (F.col(lon) + F.lit(0.0)).alias("lon"), F.unix_date(F.col(day).cast("date")).alias("day"))
    site = ["lat", "lon", "day"]
    classes = materialise(good.distinct().groupBy(*site).agg(F.count(F.lit(1)).alias("events")))
    pairs = materialise(near_sites(classes.select(*site), metres, days, radius=radius, rows=good))
    end = lambda own, other: pairs.select(*[F.col(f"{c}_{own}").alias(c) for c in site], *[F.col(f"{c}_{other}").alias(f"{c}_o") for c in site])
    both = end("a", "b").unionByName(end("b", "a"))
    size = classes.select(*[F.col(c).alias(f"{c}_o") for c in site], F.col("events").alias("n"))
    links = both.join(size, [f"{c}_o" for c in site]).groupBy(*site).agg(F.count(F.lit(1)).alias("near_sites"), F.sum("n").alias("near_events"))
    out = classes.join(links, site, "left")
    return out.select("lat", "lon", F.date_from_unix_date("day").alias("day"), "events", F.coalesce("near_sites", F.lit(0)).alias("near_sites"), F.coalesce("near_events", F.lit(0)).alias("near_events"))


def valid_position(lat: str = "lat", lon: str = "lon") -> Column:
    """In range, not NaN, not both zero."""
    return F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & ~((F.col(lat) == 0) & (F.col(lon) == 0))
