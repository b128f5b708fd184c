"""Problem 6: points near other points, in regions and nearest to anchors, by quadtree cells and an R-tree in each.

A bounded sample of the distinct positions fixes a quadtree on the driver. Every position goes to its own cell and,
as a replica, to each other cell that its search box touches. Within a cell the positions are packed into an R-tree
(sort-tile-recursive), which the cell's own positions probe level by level; hits are checked by their great-circle
distance. A pair is reported only from the cell of its lesser position, so replicas yield no duplicates.

Cells are never smaller than one search radius, so a position is in nine at most; one that is still crowded splits its
probing points over several tasks - what these receive is then small against the pairs they find, as most points of
such a cell are near each other. Ids that share one position never enter the tree more than once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dhruva.session import materialise

EARTH = 6_371_000.0
#: Positions sampled for the quadtree, whatever the number of points.
SAMPLE = 20_000
#: Positions meant for one cell.
CELL = 4_000
FANOUT = 16
#: Hits of probes that are held at a time.
HITS = 4_000_000


def haversine(lat1, lon1, lat2, lon2):
    """Great-circle metres of numpy arrays in degrees."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def reach(lat: np.ndarray, metres: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half height and half width, in degrees, of a box that holds every point within ``metres``; at a pole all longitudes."""
    angle = metres / EARTH * (1 + 1e-6) + 1e-12
    dlat = np.degrees(angle) + np.zeros(len(lat))
    polar = np.abs(lat) + dlat >= 90
    ratio = np.sin(angle) / np.maximum(np.cos(np.radians(lat)), 1e-12)
    dlon = np.where(polar, 360.0, np.degrees(np.arcsin(np.minimum(ratio, 1.0))) * (1 + 1e-6) + 1e-9)
    return dlat, dlon


@dataclass
class Quadtree:
    """Nodes as arrays: split point, first of four children (-1 in a leaf), number of the leaf; per leaf probing shares and box."""

    split: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    shares: np.ndarray
    boxes: np.ndarray

    @classmethod
    def fit(cls, lat: np.ndarray, lon: np.ndarray, cell: float, least: float) -> Quadtree:
        """Splits boxes with more than ``cell`` sampled positions while their sides stay above ``least`` degrees."""
        split, child, leaf, shares, boxes = [], [], [], [], []
        todo = [(0, -90.0, 90.0, -180.0, 180.0, np.arange(len(lat)))]
        split.append((0.0, 0.0)), child.append(-1), leaf.append(-1)
        while todo:
            at, s, n, w, e, rows = todo.pop()
            my, mx = (s + n) / 2, (w + e) / 2
            split[at] = (my, mx)
            wide = least / max(np.cos(np.radians(min(89.9, max(abs(s), abs(n))))), 1e-3)
            if len(rows) <= cell or n - s < 2 * least or e - w < 2 * wide:
                leaf[at] = len(shares)
                boxes.append((s, n, w, e))
                shares.append(max(1, int(np.ceil(len(rows) / (4 * cell)))))
                continue
            child[at] = len(split)
            up, right = lat[rows] >= my, lon[rows] >= mx
            for q in range(4):
                box = (my, n) if q & 2 else (s, my)
                side = (mx, e) if q & 1 else (w, mx)
                split.append((0.0, 0.0)), child.append(-1), leaf.append(-1)
                todo.append((child[at] + q, *box, *side, rows[(up == bool(q & 2)) & (right == bool(q & 1))]))
        return cls(np.array(split), np.array(child), np.array(leaf), np.array(shares, np.int64), np.array(boxes))

    def home(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        node = np.zeros(len(lat), np.int64)
        while (down := self.child[node] >= 0).any():
            my, mx = self.split[node].T
            node = np.where(down, self.child[node] + 2 * (lat >= my) + (lon >= mx), node)
        return self.leaf[node]

    def touched(self, s, n, w, e) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a box touches."""
        rows, node = np.arange(len(s)), np.zeros(len(s), np.int64)
        out_r, out_l = [rows[:0]], [node[:0]]
        while len(rows):
            end = self.child[node] < 0
            out_r.append(rows[end]), out_l.append(self.leaf[node[end]])
            rows, node = rows[~end], node[~end]
            my, mx = self.split[node].T
            low, high, left, right = s[rows] < my, n[rows] >= my, w[rows] < mx, e[rows] >= mx
            parts = [(low & left, 0), (low & right, 1), (high & left, 2), (high & right, 3)]
            rows, node = np.concatenate([rows[m] for m, _ in parts]), np.concatenate([self.child[node[m]] + q for m, q in parts])
        return np.concatenate(out_r), np.concatenate(out_l)


class RTree:
    """Sort-tile-recursive packing; levels from the root down, each a box array and the first child of each node."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray) -> None:
        slices = max(1, int(np.ceil(np.sqrt(len(lat) / FANOUT))))
        strip = np.empty(len(lat), np.int64)
        strip[np.argsort(lon, kind="stable")] = np.arange(len(lat)) * slices // max(1, len(lat))
        self.order = np.lexsort((lat, strip))
        box = np.stack((lat, lat, lon, lon), 1)[self.order]
        self.levels = [box]
        while len(self.levels[0]) > FANOUT:
            low = self.levels[0]
            cuts = np.arange(0, len(low), FANOUT)
            self.levels.insert(0, np.stack((np.minimum.reduceat(low[:, 0], cuts), np.maximum.reduceat(low[:, 1], cuts), np.minimum.reduceat(low[:, 2], cuts), np.maximum.reduceat(low[:, 3], cuts)), 1))

    def probe(self, s, n, w, e) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all points in each query box."""
        q = np.repeat(np.arange(len(s)), len(self.levels[0]))
        node = np.tile(np.arange(len(self.levels[0])), len(s))
        for depth, box in enumerate(self.levels):
            b = box[node]
            hit = (b[:, 0] <= n[q]) & (b[:, 1] >= s[q]) & (b[:, 2] <= e[q]) & (b[:, 3] >= w[q])
            q, node = q[hit], node[hit]
            if depth + 1 < len(self.levels):
                size = len(self.levels[depth + 1])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q = np.repeat(q, FANOUT)
                q, node = q[node < size], node[node < size]
        return q, self.order[node]


def _pairs_in_cell(pdf: pd.DataFrame, metres: float) -> pd.DataFrame:
    lat, lon, x = pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), pdf["x"].to_numpy()
    tree, probes = RTree(lat, x), np.flatnonzero(pdf["home"].to_numpy())
    dlat, dlon = reach(lat, metres)
    out = []
    # Few enough at a time that their hits fit, even if all points of the cell are hits.
    step = int(np.clip(HITS // max(1, len(pdf)), 1, 2_000))
    for start in range(0, len(probes), step):
        p = probes[start : start + step]
        q, hit = tree.probe(lat[p] - dlat[p], lat[p] + dlat[p], x[p] - dlon[p], x[p] + dlon[p])
        a, b = p[q], hit
        lesser = (lat[a] < lat[b]) | (lat[a] == lat[b]) & (lon[a] < lon[b])
        a, b = a[lesser], b[lesser]
        d = haversine(lat[a], lon[a], lat[b], lon[b])
        a, b, d = a[d <= metres], b[d <= metres], d[d <= metres]
        out.append(pd.DataFrame({"lat_a": lat[a], "lon_a": lon[a], "lat_b": lat[b], "lon_b": lon[b], "metres": d}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0) for c in ("lat_a", "lon_a", "lat_b", "lon_b", "metres")})


def usable(lat: str, lon: str) -> F.Column:
    """A known position: both numbers there and in range, not both 0."""
    return F.expr(f"{lat} between -90 and 90 and {lon} between -180 and 180 and not ({lat} = 0 and {lon} = 0)")


def _fit(points: DataFrame, least: float) -> tuple[Quadtree, np.ndarray, np.ndarray]:
    """A quadtree for ``points(lat, lon)`` with cells of at least ``least`` degrees, and the bounded sample it was fitted on."""
    n = points.count()
    seen = points.select("lat", "lon").sample(fraction=min(1.0, SAMPLE / max(n, 1)), seed=7).limit(2 * SAMPLE).toPandas()
    lat, lon = seen["lat"].to_numpy(float), seen["lon"].to_numpy(float)
    return Quadtree.fit(lat, lon, max(1.0, CELL * len(seen) / max(n, 1)), least), lat, lon


def _touched(tree: Quadtree, s, n, w, e) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, shift) of leaves that boxes touch; a box a turn of the globe away stands for neighbours across the antimeridian."""
    found = []
    for shift in (0.0, -360.0, 360.0):
        near = np.flatnonzero((e + shift >= -180) & (w + shift <= 180))
        r, leaf = tree.touched(s[near], n[near], w[near] + shift, e[near] + shift)
        found.append((near[r], leaf, np.full(len(r), shift)))
    return tuple(np.concatenate(c) for c in zip(*found))


def _home(tree) -> F.Column:
    @F.pandas_udf(T.LongType())
    def home(lat: pd.Series, lon: pd.Series) -> pd.Series:
        return pd.Series(tree.value.home(lat.to_numpy(), lon.to_numpy()), dtype="int64")

    return home("lat", "lon")


def nearest(anchors: DataFrame, points: DataFrame, k: int = 5, whole_metres: bool = False) -> DataFrame:
    """The ``k`` nearest points of each anchor: ``points(id, lat, lon, ..)`` with ``anchor, alat, alon, metres, rank``, ties by id.

    ``whole_metres``: distances are compared in whole metres (half to even).

    The k-th distance of an anchor to a bounded sample of the points can only be too large, so its cells of the quadtree
    within that distance hold all it looks for; only points of these cells meet it. Unusable positions take no part;
    fewer than k points are all returned; repeated anchors count once.
    """
    spark = points.sparkSession
    known = points.where(usable("lat", "lon"))
    tree, lat, lon = _fit(known, 1e-4)
    shared = spark.sparkContext.broadcast((tree, lat, lon))
    only_tree = spark.sparkContext.broadcast(tree)
    asked = anchors.select("anchor", F.col("alat").cast("double").alias("alat"), F.col("alon").cast("double").alias("alon")).where(usable("alat", "alon")).distinct()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, lat, lon = shared.value
        for pdf in batches:
            for start in range(0, len(pdf), 128):
                part = pdf.iloc[start : start + 128]
                y, x = part["alat"].to_numpy(), part["alon"].to_numpy()
                if len(lat) >= k:
                    r = np.partition(haversine(y[:, None], x[:, None], lat[None, :], lon[None, :]), k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + (1.001 if whole_metres else 1e-3)
                else:
                    r = np.full(len(part), 2 * np.pi * EARTH)
                dlat, dlon = reach(y, r)
                row, leaf, _ = _touched(tree, y - dlat, y + dlat, x - dlon, x + dlon)
                yield part.iloc[row].assign(most=r[row], leaf=leaf).drop_duplicates()

    schema = T.StructType([*asked.schema, T.StructField("most", T.DoubleType()), T.StructField("leaf", T.LongType())])
    cells = materialise(asked.mapInPandas(ask, schema), "anchors")
    met = known.withColumn("leaf", _home(only_tree)).join(cells, "leaf").withColumn("metres", great_circle("alat", "alon", "lat", "lon")).where("metres <= most")
    w = Window.partitionBy("anchor", "alat", "alon").orderBy(F.bround("metres") if whole_metres else "metres", "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("leaf", "most")


def around(anchors: DataFrame, points: DataFrame, metres: float) -> DataFrame:
    """Pairs ``(anchor, id, metres)`` of anchors and points at most ``metres`` apart: ``anchors(anchor, alat, alon)``, ``points(id, lat, lon)``.

    Points meet only the anchors whose search box touches their cell of the quadtree, never each other. Rows with a null id
    or an unusable position take no part; of several positions the least distance counts.
    """
    spark = points.sparkSession
    rows = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where(F.col("id").isNotNull() & usable("lat", "lon"))
    rows = materialise(rows.distinct(), "points")
    tree, _, _ = _fit(rows, np.degrees(metres / EARTH))
    shared = spark.sparkContext.broadcast(tree)
    asked = anchors.select("anchor", F.col("alat").cast("double").alias("alat"), F.col("alon").cast("double").alias("alon")).where(F.col("anchor").isNotNull() & usable("alat", "alon")).distinct()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        for pdf in batches:
            y, x = pdf["alat"].to_numpy(), pdf["alon"].to_numpy()
            dlat, dlon = reach(y, metres)
            row, leaf, _ = _touched(tree, y - dlat, y + dlat, x - dlon, x + dlon)
            yield pdf.iloc[row].assign(leaf=leaf).drop_duplicates()

    cells = materialise(asked.mapInPandas(ask, T.StructType([*asked.schema, T.StructField("leaf", T.LongType())])), "anchors")
    met = rows.withColumn("leaf", _home(shared)).join(cells, "leaf").withColumn("metres", great_circle("alat", "alon", "lat", "lon")).where(F.col("metres") <= metres)
    return met.groupBy("anchor", "id").agg(F.min("metres").alias("metres"))


def great_circle(lat1: str, lon1: str, lat2: str, lon2: str) -> F.Column:
    """Great-circle metres as a Spark expression."""
    h = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return F.expr(f"2 * {EARTH}D * asin(sqrt(least(1.0D, {h})))")


def in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``(id, region_id)`` of ``points(id, lat, lon)`` in polygons ``regions(region_id, ring array<struct<lat, lon>>)``.

    Straight lines in degrees join the vertices, the last with the first; longitudes beyond 180 stand for the other side of
    the antimeridian. Of points on an edge those on a western or southern one are in. Rings with fewer than three
    vertices or a null in them hold nothing. Cells of the quadtree that a region covers whole need no test; in the
    others the point is held against the ring. Repeated rows count once.
    """
    spark = points.sparkSession
    known = points.select("id", "lat", "lon").where(F.col("id").isNotNull() & usable("lat", "lon")).distinct()
    tree, _, _ = _fit(known, 1e-4)
    shared = spark.sparkContext.broadcast(tree)
    rings = regions.select("region_id", "ring").where("region_id is not null and size(ring) >= 3 and not exists(ring, p -> p is null or p.lat is null or p.lon is null)").distinct()
    rings = rings.select("region_id", F.expr("transform(ring, p -> cast(p.lat as double))").alias("ys"), F.expr("transform(ring, p -> cast(p.lon as double))").alias("xs"))

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        for pdf in batches:
            for region, ys, xs in zip(pdf["region_id"], pdf["ys"], pdf["xs"]):
                y, x = np.asarray(ys, float), np.asarray(xs, float)
                _, leaf, shift = _touched(tree, y[:1] * 0 + y.min(), y[:1] * 0 + y.max(), x[:1] * 0 + x.min(), x[:1] * 0 + x.max())
                y2, x2 = np.roll(y, -1), np.roll(x, -1)
                out = []
                for cell, turn in zip(leaf, shift):
                    s, n, w, e = tree.boxes[cell]
                    # An edge may cross the cell if their boxes meet.
                    cut = (np.minimum(y, y2) <= n) & (np.maximum(y, y2) >= s) & (np.minimum(x, x2) + turn <= e) & (np.maximum(x, x2) + turn >= w)
                    if cut.any():
                        out.append((region, cell, False, ys, [v + turn for v in xs]))
                    elif _inside((s + n) / 2, (w + e) / 2 - turn, y, x, y2, x2):
                        out.append((region, cell, True, None, None))
                yield pd.DataFrame(out, columns=["region_id", "leaf", "whole", "ys", "xs"])

    kind = rings.schema["region_id"].dataType.simpleString()
    cells = materialise(rings.mapInPandas(cover, f"region_id {kind}, leaf long, whole boolean, ys array<double>, xs array<double>"), "regions")
    met = known.withColumn("leaf", _home(shared)).join(cells, "leaf")
    edges = "zip_with(sequence(1, size(ys)), sequence(1, size(ys)), (i, j) -> named_struct('a', ys[i - 1], 'b', ys[i % size(ys)], 'c', xs[i - 1], 'd', xs[i % size(ys)]))"
    crossed = f"aggregate({edges}, 0, (s, p) -> s + if((p.a > lat) != (p.b > lat) and lon < (p.d - p.c) * (lat - p.a) / (p.b - p.a) + p.c, 1, 0)) % 2 = 1"
    return met.where(f"whole or {crossed}").select("id", "region_id").distinct()


def _inside(lat, lon, y, x, y2, x2) -> bool:
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = ((y > lat) != (y2 > lat)) & (lon < (x2 - x) * (lat - y) / (y2 - y) + x)
    return bool(crossed.sum() % 2)


def pairs_within(points: DataFrame, metres: float, id_col: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Pairs ``(id_a, id_b, metres)`` of different ids at most ``metres`` apart, ``id_a`` the smaller; the least distance.

    Rows with a null id or an unusable position take no part; an id may have several positions; repeated rows count
    once; an empty table gives no pairs.
    """
    spark = points.sparkSession
    rows = points.select(F.col(id_col).alias("id"), (F.col(lat).cast("double") + 0.0).alias("lat"), (F.col(lon).cast("double") + 0.0).alias("lon"))
    rows = rows.where(F.col("id").isNotNull() & usable("lat", "lon")).distinct()
    places = rows.select("lat", "lon").distinct()
    tree, _, _ = _fit(places, np.degrees(metres / EARTH))
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        for pdf in batches:
            y, x = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
            dlat, dlon = reach(y, metres)
            home = tree.home(y, x)
            turn = (np.abs(y * 1e7).astype(np.int64) * 31 + np.abs(x * 1e7).astype(np.int64)) % tree.shares[home]
            r, leaf, shift = _touched(tree, y - dlat, y + dlat, x - dlon, x + dlon)
            # Replicas go to every share of a cell, the probing copy to one.
            times = tree.shares[leaf]
            share = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            r, leaf, shift = np.repeat(r, times), np.repeat(leaf, times), np.repeat(shift, times)
            own = (leaf == home[r]) & (shift == 0) & (share == turn[r])
            yield pd.DataFrame({"cell": leaf, "share": share, "home": own, "lat": y[r], "lon": x[r], "x": x[r] + shift})

    cells = places.mapInPandas(assign, "cell long, share long, home boolean, lat double, lon double, x double")
    near = cells.groupBy("cell", "share").applyInPandas(lambda pdf: _pairs_in_cell(pdf, metres), "lat_a double, lon_a double, lat_b double, lon_b double, metres double")
    a = rows.select(F.col("id").alias("i"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = rows.select(F.col("id").alias("j"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    apart = near.join(a, ["lat_a", "lon_a"]).join(b, ["lat_b", "lon_b"]).select("i", "j", "metres")
    crowded = rows.groupBy("lat", "lon").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("lat", "lon")
    there = rows.join(crowded, ["lat", "lon"], "left_semi")
    same = there.select("lat", "lon", F.col("id").alias("i")).join(there.select("lat", "lon", F.col("id").alias("j")), ["lat", "lon"]).where("i < j")
    pairs = apart.where("i != j").union(same.select("i", "j", F.lit(0.0)))
    return pairs.groupBy(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).agg(F.min("metres").alias("metres"))
