"""Points within a distance of other points, on the sphere.

A bounded sample of the left points fixes a quadtree over longitude and latitude, so that dense areas get small cells.
Each left point falls in exactly one leaf; each right point is copied to every leaf its search box touches, so the leaf
of the left point is the reference that reports a pair once. Within a leaf a bulk-loaded R-tree finds candidates and the
great-circle distance settles them. A leaf with more rows or possible pairs than a task should hold, as when a third of
all rows share one coordinate, is split by salts: its left rows into parts, its right rows into parts, and every part of
the one side meets every part of the other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.session import spread

EARTH_KM = 6371.0
#: Bound on the left points taken to the driver to place the quadtree's splits; every row is joined.
SAMPLE_ROWS = 20_000
#: Rows of a side and possible pairs that one group of a task should hold, and the most leaves of the tree.
ROWS_PER_GROUP, PAIRS_PER_GROUP, MOST_LEAVES = 50_000, 20_000_000, 4_096
_FANOUT = 16


def quadtree_leaves(lon: np.ndarray, lat: np.ndarray, share_per_leaf: float, most_leaves: int = MOST_LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """Leaf boxes (west, south, east, north) and the share of the sample in each; the boxes tile the whole map."""
    boxes, todo = [], [(-180.0, -90.0, 180.0, 90.0, np.arange(len(lon)), 0)]
    limit = max(1.0, share_per_leaf * len(lon))
    while todo:
        west, south, east, north, inside, depth = todo.pop()
        if len(inside) <= limit or depth >= 16 or len(boxes) + len(todo) + 4 > most_leaves:
            boxes.append((west, south, east, north, len(inside) / max(1, len(lon))))
            continue
        mid_lon, mid_lat = (west + east) / 2, (south + north) / 2
        right, upper = lon[inside] >= mid_lon, lat[inside] >= mid_lat
        for is_right in (False, True):
            for is_upper in (False, True):
                todo.append((mid_lon if is_right else west, mid_lat if is_upper else south, east if is_right else mid_lon, north if is_upper else mid_lat, inside[(right == is_right) & (upper == is_upper)], depth + 1))
    found = np.array(boxes)
    return found[:, :4], found[:, 4]


def search_boxes(lon: float, lat: float, radius_km: float) -> list[tuple[float, float, float, float]]:
    """Boxes that cover the circle around a point: one, or two where it crosses the 180th meridian."""
    reach = math.degrees(radius_km / EARTH_KM) * (1 + 1e-9) + 1e-9
    south, north = lat - reach, lat + reach
    if south <= -90 or north >= 90:
        return [(-180.0, max(south, -90.0), 180.0, min(north, 90.0))]
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(reach, 90.0))) / math.cos(math.radians(lat))))) * (1 + 1e-9) + 1e-9
    west, east = lon - wide, lon + wide
    if wide >= 180:
        return [(-180.0, south, 180.0, north)]
    if west < -180:
        return [(west + 360, south, 180.0, north), (-180.0, south, east, north)]
    if east > 180:
        return [(west, south, 180.0, north), (-180.0, south, east - 360, north)]
    return [(west, south, east, north)]


class BoxTree:
    """R-tree over boxes, bulk-loaded by sort-tile-recursive packing and probed with many points at once."""

    def __init__(self, boxes: np.ndarray) -> None:
        centre_x, centre_y = (boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2
        slices = max(1, math.ceil(math.sqrt(math.ceil(len(boxes) / _FANOUT))))
        by_x = np.argsort(centre_x, kind="stable")
        tile = np.empty(len(boxes), dtype=np.int64)
        tile[by_x] = np.arange(len(boxes)) // max(1, math.ceil(len(boxes) / slices))
        self.order = np.lexsort((centre_y, tile))
        self.levels = [boxes[self.order]]
        while len(self.levels[0]) > _FANOUT:
            below = self.levels[0]
            starts = np.arange(0, len(below), _FANOUT)
            self.levels.insert(0, np.column_stack([np.minimum.reduceat(below[:, 0], starts), np.minimum.reduceat(below[:, 1], starts), np.maximum.reduceat(below[:, 2], starts), np.maximum.reduceat(below[:, 3], starts)]))

    def probe(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the point and of the box for every box that holds a point."""
        point = np.repeat(np.arange(len(lon)), len(self.levels[0]))
        node = np.tile(np.arange(len(self.levels[0])), len(lon))
        for depth, boxes in enumerate(self.levels):
            b = boxes[node]
            hit = (lon[point] >= b[:, 0]) & (lon[point] <= b[:, 2]) & (lat[point] >= b[:, 1]) & (lat[point] <= b[:, 3])
            point, node = point[hit], node[hit]
            if depth + 1 < len(self.levels):
                child = (node[:, None] * _FANOUT + np.arange(_FANOUT)).ravel()
                point = np.repeat(point, _FANOUT)
                real = child < len(self.levels[depth + 1])
                point, node = point[real], child[real]
        return point, self.order[node]


def great_circle_km(lon_a: np.ndarray, lat_a: np.ndarray, lon_b: np.ndarray, lat_b: np.ndarray) -> np.ndarray:
    lon_a, lat_a, lon_b, lat_b = (np.radians(x) for x in (lon_a, lat_a, lon_b, lat_b))
    h = np.sin((lat_b - lat_a) / 2) ** 2 + np.cos(lat_a) * np.cos(lat_b) * np.sin((lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _leaf_of(boxes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Leaf of each point. Right and upper edges belong to the neighbour, save at the map's own edge."""
    tree = BoxTree(boxes)

    def leaf(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        point, box = tree.probe(lon, lat)
        b = boxes[box]
        own = ((lon[point] < b[:, 2]) | (b[:, 2] == 180.0)) & ((lat[point] < b[:, 3]) | (b[:, 3] == 90.0))
        out = np.full(len(lon), -1, dtype=np.int64)
        out[point[own]] = box[own]
        return out

    return leaf


def points_near(left: DataFrame, left_id: str, left_lat: str, left_lon: str, right: DataFrame, right_id: str, right_lat: str, right_lon: str, radius_km: float) -> DataFrame:
    """left_id, right_id, distance_km: every pair at most ``radius_km`` apart, once.

    Points with a null or NaN id or coordinate, a latitude outside -90..90 or a longitude outside -180..180 find nothing.
    Repeated rows of one id and coordinate count once; several points under one id each count, and a pair of ids comes out
    once with its least distance. The limit itself is near. Empty tables give no pairs; other columns are not looked at.
    Ids come out as bigint.
    """

    def usable(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
        points = df.select(F.col(key).cast("bigint").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
        return points.where(F.col("id").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))

    a, b = usable(left, left_id, left_lat, left_lon), usable(right, right_id, right_lat, right_lon)
    rows = a.count()
    fraction = min(1.0, SAMPLE_ROWS / max(1, rows))
    sampled = a.select("lon", "lat").sample(fraction, seed=11).limit(2 * SAMPLE_ROWS).toPandas().to_numpy(dtype=float).reshape(-1, 2)
    boxes, shares = quadtree_leaves(sampled[:, 0], sampled[:, 1], ROWS_PER_GROUP / max(rows, 1) if rows > 8 * ROWS_PER_GROUP else 1 / 64)
    leaf_of = _leaf_of(boxes)

    def leaves_touched(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the point and of the leaf for every leaf that the search box of a point touches, once."""
        owner, box = [], []
        for i, (x, y) in enumerate(zip(lon, lat)):
            for searched in search_boxes(x, y, radius_km):
                owner.append(i)
                box.append(searched)
        owner, box = np.array(owner, dtype=np.int64), np.array(box).reshape(-1, 4)
        point, leaf = [], []
        for start in range(0, len(box), 1024):
            b = box[start : start + 1024, :, None]
            at, cell = np.nonzero((boxes[:, 0] <= b[:, 2]) & (boxes[:, 2] >= b[:, 0]) & (boxes[:, 1] <= b[:, 3]) & (boxes[:, 3] >= b[:, 1]))
            point.append(owner[start + at])
            leaf.append(cell)
        both = np.unique(np.column_stack([np.concatenate(point or [owner]), np.concatenate(leaf or [owner])]), axis=0)
        return both[:, 0], both[:, 1]

    # How many rows of either side a leaf holds, by the samples, and into how many parts that splits them.
    right_rows = b.count()
    right_sample = b.select("lon", "lat").sample(min(1.0, SAMPLE_ROWS / max(1, right_rows)), seed=12).limit(2 * SAMPLE_ROWS).toPandas().to_numpy(dtype=float).reshape(-1, 2)
    right_shares = np.bincount(leaves_touched(right_sample[:, 0], right_sample[:, 1])[1], minlength=len(boxes)) / max(1, len(right_sample))
    left_held, right_held = shares * rows, right_shares * right_rows
    right_parts = np.maximum(1, np.ceil(right_held / ROWS_PER_GROUP)).astype(np.int64)
    parts = np.maximum(1, np.ceil(np.maximum(left_held / ROWS_PER_GROUP, left_held * right_held / right_parts / PAIRS_PER_GROUP))).astype(np.int64)

    def salted(batch: pd.DataFrame, cell: np.ndarray, own: np.ndarray, copies: np.ndarray, names: tuple[str, str]) -> pd.DataFrame:
        """The rows with their cell, their own salt under the first name, and a copy for each part of the other side."""
        salt = (pd.util.hash_array(batch["id"].to_numpy()) % own[cell].astype(np.uint64)).astype(np.int64)
        times = copies[cell]
        out = batch.assign(cell=cell, **{names[0]: salt}).loc[batch.index.repeat(times)]
        return out.assign(**{names[1]: np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)})[["id", "lat", "lon", "cell", "salt", "right_salt"]]

    def place_left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = leaf_of(batch["lon"].to_numpy(), batch["lat"].to_numpy())
            yield salted(batch.reset_index(drop=True), cell, parts, right_parts, ("salt", "right_salt"))

    def place_right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            point, cell = leaves_touched(batch["lon"].to_numpy(), batch["lat"].to_numpy())
            yield salted(batch.iloc[point].reset_index(drop=True), cell, right_parts, parts, ("right_salt", "salt"))

    def refine(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        here, there = here.drop_duplicates(["id", "lat", "lon"]), there.drop_duplicates(["id", "lat", "lon"])
        empty = pd.DataFrame({"left_id": pd.Series(dtype="int64"), "right_id": pd.Series(dtype="int64"), "distance_km": pd.Series(dtype="float64")})
        if here.empty or there.empty:
            return empty
        owners, found = [], []
        for i, (lat, lon) in enumerate(zip(there["lat"], there["lon"])):
            for box in search_boxes(lon, lat, radius_km):
                owners.append(i)
                found.append(box)
        owner, tree = np.array(owners), BoxTree(np.array(found))
        spots, spot_of = np.unique(here[["lon", "lat"]].to_numpy(), axis=0, return_inverse=True)
        pieces = []
        for start in range(0, len(spots), 4096):
            block = spots[start : start + 4096]
            point, box = tree.probe(block[:, 0], block[:, 1])
            site = owner[box]
            km = great_circle_km(block[point, 0], block[point, 1], there["lon"].to_numpy()[site], there["lat"].to_numpy()[site])
            near = km <= radius_km
            pieces.append(pd.DataFrame({"spot": point[near] + start, "right_id": there["id"].to_numpy()[site[near]], "distance_km": km[near]}))
        members = pd.DataFrame({"spot": spot_of.ravel(), "left_id": here["id"].to_numpy()})
        pairs = members.merge(pd.concat(pieces), on="spot")[["left_id", "right_id", "distance_km"]]
        return pairs.sort_values("distance_km", kind="stable").drop_duplicates(["left_id", "right_id"])

    keys, placed = ("cell", "salt", "right_salt"), "id bigint, lat double, lon double, cell bigint, salt bigint, right_salt bigint"
    placed_a, placed_b = spread(a.mapInPandas(place_left, placed), *keys), spread(b.mapInPandas(place_right, placed), *keys)
    pairs = placed_a.groupBy(*keys).cogroup(placed_b.groupBy(*keys)).applyInPandas(refine, "left_id bigint, right_id bigint, distance_km double")
    # Points in several leaves can share an id.
    return pairs.groupBy("left_id", "right_id").agg(F.min("distance_km").alias("distance_km"))
