"""Reports grouped into unique events by place and time, and how far each event can be trusted."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType

from seismark.operators.components import connected_components
from seismark.operators.pairing import pairs_within
from seismark.session import cut_lineage, spread, written

EARTH_KM = 6371.0
#: How often a cell of the grid is cut by eight each way, and the cells that a band of latitude can have at most.
SQUARE_LEVELS, CELLS_OF_ROW = 4, 10_000_000


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def temporal_clusters(df: DataFrame, group: list[str], day: str, gap_days: int, name: str = "time_cluster") -> DataFrame:
    """``df`` plus the number of the run of days within each group; a gap of more than ``gap_days`` starts a new run.

    The runs are found on the distinct days of a group, so a group with many reports of one day is no longer than others.
    """
    days = df.select(*group, day).where(F.col(day).isNotNull()).distinct()
    order = Window.partitionBy(*group).orderBy(day)
    starts = F.when(F.datediff(day, F.lag(day).over(order)) > gap_days, 1).otherwise(0)
    numbered = days.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")
    keys = [df[c].eqNullSafe(numbered[c]) for c in (*group, day)]
    return df.join(numbered, keys).select(df["*"], numbered[name])


def _least_km(a: str, b: str) -> Column:
    """A lower bound of the distance between points of two boxes <name>_south, _north, _west and _east."""
    lat_gap = F.greatest(F.col(f"{a}_south") - F.col(f"{b}_north"), F.col(f"{b}_south") - F.col(f"{a}_north"), F.lit(0.0))
    straight = F.greatest(F.col(f"{a}_west") - F.col(f"{b}_east"), F.col(f"{b}_west") - F.col(f"{a}_east"), F.lit(0.0))
    around = F.greatest(360 - (F.greatest(f"{a}_east", f"{b}_east") - F.least(f"{a}_west", f"{b}_west")), F.lit(0.0))
    narrow = [F.cos(F.radians(F.greatest(F.abs(F.col(f"{x}_south")), F.abs(F.col(f"{x}_north"))))) for x in (a, b)]
    half = F.pow(F.sin(F.radians(lat_gap) / 2), 2) + narrow[0] * narrow[1] * F.pow(F.sin(F.radians(F.least(straight, around)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(half, F.lit(0.0)))))


def _boxes(points: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys``, all marked with ``name``, with the box around their points and one of the points."""
    edges = [F.min("lat").alias(f"{name}_south"), F.max("lat").alias(f"{name}_north"), F.min("lon").alias(f"{name}_west"), F.max("lon").alias(f"{name}_east")]
    return points.groupBy(*keys).agg(*edges, F.min(F.struct("lat", "lon")).alias(f"{name}_point")).withColumnsRenamed({k: f"{name}_{k}" for k in keys})


def linked_cells(placed: DataFrame, neighbours: DataFrame, radius_km: float) -> DataFrame:
    """a_cell, b_cell: the neighbours of which some two points are at most ``radius_km`` apart.

    ``placed`` holds lat, lon, cell and the position u, v of each point in units of cells. Cells are cut into ever smaller
    squares; of two squares, one point of each or the boxes around them mostly tell, and a pair of cells is dropped
    once it is linked. The points themselves meet only in the few squares whose distance is the radius almost exactly.
    """
    square = lambda k: F.floor(F.col("u") * 8.0**k) * F.lit(2**31) + F.floor(F.col("v") * 8.0**k)
    tagged = placed.select("lat", "lon", *[square(k).alias(f"square{k}") for k in range(SQUARE_LEVELS + 1)], "cell")
    open_pairs = neighbours.select("a_cell", "b_cell", F.lit(None).cast("bigint").alias("a_square"), F.lit(None).cast("bigint").alias("b_square"))
    linked = neighbours.select("a_cell", "b_cell").limit(0)
    for k in range(1, SQUARE_LEVELS + 1):
        inside = tagged.select("lat", "lon", "cell", (F.col(f"square{k - 1}") if k > 1 else F.lit(None).cast("bigint")).alias("of"), F.col(f"square{k}").alias("square"))
        a, b = (_boxes(inside, ["cell", "of", "square"], name) for name in ("next_a", "next_b"))
        met = open_pairs.join(a, (F.col("a_cell") == F.col("next_a_cell")) & F.col("a_square").eqNullSafe(F.col("next_a_of")))
        met = met.join(b, (F.col("b_cell") == F.col("next_b_cell")) & F.col("b_square").eqNullSafe(F.col("next_b_of")))
        near = haversine_km(F.col("next_a_point.lat"), F.col("next_a_point.lon"), F.col("next_b_point.lat"), F.col("next_b_point.lon")) <= radius_km
        single = [(F.col(f"{x}_south") == F.col(f"{x}_north")) & (F.col(f"{x}_west") == F.col(f"{x}_east")) for x in ("next_a", "next_b")]
        maybe = near | ((_least_km("next_a", "next_b") <= radius_km * (1 + 1e-9)) & ~(single[0] & single[1]))
        met = cut_lineage(met.where(maybe).select("a_cell", "b_cell", F.col("next_a_square").alias("a_square"), F.col("next_b_square").alias("b_square"), near.alias("near")))
        hits = met.where("near").select("a_cell", "b_cell").distinct()
        linked = linked.unionByName(hits)
        open_pairs = met.where("NOT near").drop("near").join(hits, ["a_cell", "b_cell"], "left_anti")
        if open_pairs.isEmpty():
            return linked
    points = tagged.select("cell", F.col(f"square{SQUARE_LEVELS}").alias("square"), "lat", "lon")
    a, b = (points.withColumnsRenamed({"cell": f"{x}_cell", "square": f"{x}_square", "lat": f"{x}_lat", "lon": f"{x}_lon"}) for x in ("a", "b"))
    last = open_pairs.join(a, ["a_cell", "a_square"]).join(b, ["b_cell", "b_square"])
    return linked.unionByName(last.where(haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= radius_km).select("a_cell", "b_cell").distinct())


def spatial_clusters(df: DataFrame, lat: str, lon: str, radius_km: float) -> DataFrame:
    """lat, lon, loc_cluster for every distinct coordinate: density clustering in which every point is a core point.

    Clusters are then the connected components of "at most ``radius_km`` apart". Points of one grid cell, whose diagonal
    is within the radius, belong together; between neighbouring cells, one pair within the radius links the cells.
    Coordinates outside the globe are left out; longitudes meet at the 180th meridian. Cells are split, never their pairs
    of points listed, so a cell may hold any share of the points.
    """
    side = math.degrees(radius_km / EARTH_KM) / math.sqrt(2.0) * (1 - 1e-9)
    reach = math.degrees(radius_km / EARTH_KM) * (1 + 1e-9)
    points = df.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).distinct()

    def columns_of(row: Column) -> Column:
        """Columns of a band of latitude; they are as wide as the radius allows at its edge nearest the equator."""
        south, north = row * side - 90, (row + 1) * side - 90
        edge = F.when(south * north <= 0, F.lit(0.0)).otherwise(F.least(F.abs(south), F.abs(north)))
        return F.greatest(F.lit(1), F.ceil(360 * F.cos(F.radians(edge)) / side)).cast("bigint")

    placed = points.withColumn("u", (F.col("lat") + 90) / side).withColumn("row", F.floor("u")).withColumn("columns", columns_of(F.col("row")))
    placed = placed.withColumn("v", F.least((F.col("lon") + 180) / 360 * F.col("columns"), F.col("columns") - 1e-9)).withColumn("cell", F.col("row") * CELLS_OF_ROW + F.floor("v"))
    placed = cut_lineage(placed.select("lat", "lon", "u", "v", "cell"))

    # Each cell looks into the cells of its own and the next rows whose longitudes its points can reach.
    cells = _boxes(placed, ["cell"], "a")
    looking = cells.withColumn("near_row", F.explode(F.sequence(F.floor(F.col("a_cell") / CELLS_OF_ROW), F.floor((F.col("a_north") + reach + 90) / side))))
    far = F.greatest(F.abs("a_south"), F.abs("a_north"))
    wide = F.degrees(F.asin(F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.cos(F.radians(far))))
    wide = F.when(far + reach >= 89.9, F.lit(180.0)).otherwise(F.coalesce(F.when(F.isnan(wide), F.lit(180.0)).otherwise(wide), F.lit(180.0)))
    looking = looking.withColumn("columns", columns_of(F.col("near_row"))).withColumn("wide", wide)
    first, last = (F.floor((F.col(edge) + sign * F.col("wide") + 180) / 360 * F.col("columns")) for edge, sign in (("a_west", -1), ("a_east", 1)))
    span = F.when(last - first >= F.col("columns"), F.sequence(F.lit(0).cast("bigint"), F.col("columns") - 1)).otherwise(F.sequence(first, last))
    looking = looking.withColumn("near_column", F.explode(span)).withColumn("b_cell", F.col("near_row") * CELLS_OF_ROW + F.pmod("near_column", "columns")).where("a_cell <> b_cell")
    neighbours = looking.join(_boxes(placed, ["cell"], "b"), "b_cell").where(_least_km("a", "b") <= radius_km * (1 + 1e-9)).select("a_cell", "b_cell").distinct()
    linked = linked_cells(placed, cut_lineage(neighbours), radius_km)
    components = connected_components(linked, "a_cell", "b_cell").withColumnRenamed("node", "cell")
    labelled = placed.join(components, "cell", "left").select("lat", "lon", F.coalesce("component", "cell").alias("component"))
    least = labelled.groupBy("component").agg(F.min(F.struct("lat", "lon")).alias("loc_cluster"))
    return labelled.join(least, "component").select("lat", "lon", F.concat_ws(",", F.col("loc_cluster.lat").cast("string"), F.col("loc_cluster.lon").cast("string")).alias("loc_cluster"))


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best match of the shorter text within the longer, 0 to 100; 0 if either is missing."""

    def score(x: str | None, y: str | None) -> float:
        if not x or not y:
            return 0.0
        if x == y:
            return 100.0
        short, long = sorted((x, y), key=lambda s: (len(s), s))
        matcher = SequenceMatcher(None, short, long, autojunk=False)
        best = 0.0
        for i, j, _ in matcher.get_matching_blocks():
            start = max(0, j - i)
            best = max(best, SequenceMatcher(None, short, long[start : start + len(short)], autojunk=False).ratio())
        return float(round(100 * best))

    return pd.Series([score(x, y) for x, y in zip(a, b)])


def place_consistency(df: DataFrame, group: str, place: str) -> DataFrame:
    """group, loc_consistency: mean similarity over the pairs of a group's reports, 100 for a single report.

    Pairs are formed of distinct texts with their counts, so equal texts never meet pairwise, and in blocks.
    """
    texts = df.groupBy(F.col(group).alias("group"), F.col(place).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    size = texts.groupBy("group").agg(F.sum("n").alias("size"))
    same = texts.select("group", (F.col("n") * (F.col("n") - 1) / 2 * F.when(F.coalesce(F.col("text"), F.lit("")) != "", 100.0).otherwise(0.0)).alias("part"))
    named = texts.where(F.coalesce(F.col("text"), F.lit("")) != "")
    pairs = cut_lineage(pairs_within(named, "group", "text", ("n",)))
    # Texts of which one holds the other match in full; only the others are compared letter by letter, each pair once.
    held = F.contains("a", "b") | F.contains("b", "a")
    ratios = spread(pairs.where(~held).select("a", "b").distinct(), "a", "b").withColumn("ratio", partial_ratio("a", "b"))
    met = pairs.where(held).withColumn("ratio", F.lit(100.0)).unionByName(pairs.where(~held).join(ratios, ["a", "b"]), allowMissingColumns=False)
    crossed = met.select("group", (F.col("n_a") * F.col("n_b") * F.col("ratio")).alias("part"))
    total = same.unionByName(crossed).groupBy("group").agg(F.sum("part").alias("total"))
    mean = F.when(F.col("size") > 1, F.coalesce("total", F.lit(0.0)) / (F.col("size") * (F.col("size") - 1) / 2)).otherwise(100.0)
    return size.join(total, "group", "left").select(F.col("group").alias(group), mean.alias("loc_consistency"))


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def confidence(reports: Column, impact_std: Column, lat_std: Column, lon_std: Column, span_days: Column, consistency: Column) -> Column:
    """Weighted agreement of an event's reports, at most 1, to three decimals; null if any part is unknown."""

    def room(value: Column, scale: float) -> Column:
        return F.when(value.isNotNull(), F.greatest(1 - value / scale, F.lit(0.0)))

    score = F.least(reports / 10, F.lit(1.0)) * 0.4 + room(impact_std, 2) * 0.2 + room(lat_std, 0.1) * 0.1 + room(lon_std, 0.1) * 0.1 + room(span_days, 5) * 0.1 + consistency / 100 * 0.1
    return F.bround(F.when(score.isNotNull(), F.least(score, F.lit(1.0))), 3)


def unique_events(labels: DataFrame, spatial_radius_km: float = 100.0, temporal_radius_days: int = 3, scored: bool = True) -> DataFrame:
    """One row per unique event of labels with a date ``day``, latitude and longitude; with ``scored``, its confidence.

    Reports without any of the three are left out; those without an event form one group per place, numbered -1.
    """
    base = labels.where(F.col("day").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    clusters = spatial_clusters(base, "latitude", "longitude", spatial_radius_km)
    placed = base.join(clusters, (base["latitude"] == clusters["lat"]) & (base["longitude"] == clusters["lon"])).drop("lat", "lon")
    timed = temporal_clusters(placed.where(F.col("event").isNotNull()), ["event", "loc_cluster"], "day", temporal_radius_days)
    timed = timed.unionByName(placed.where(F.col("event").isNull()).withColumn("time_cluster", F.lit(-1).cast("bigint")))
    keyed = timed.withColumn("event_id", F.concat_ws("_", F.coalesce("event", F.lit("None")), "loc_cluster", "time_cluster"))
    if scored:
        keyed = written(keyed)
    impact = null_if_nan(F.col("impact").cast("double"))
    grouped = keyed.groupBy("event_id").agg(
        F.first("event").alias("event"), F.min("day").alias("dt"), F.max("impact").alias("impact"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
        F.mode("city", True).alias("city"), F.mode("state", True).alias("state"), F.mode("country", True).alias("country"), F.count(F.lit(1)).alias("n_reports"),
        F.stddev_pop(impact).alias("impact_std"), F.stddev_pop("latitude").alias("lat_std"), F.stddev_pop("longitude").alias("lon_std"), F.datediff(F.max("day"), F.min("day")).alias("span_days"),
    )
    if not scored:
        return grouped
    placed_events = grouped.join(place_consistency(keyed, "event_id", "loc"), "event_id")
    impact_std = F.when(F.col("n_reports") > 1, F.col("impact_std")).otherwise(0.0)
    return placed_events.withColumn("confidence", confidence(F.col("n_reports"), impact_std, F.col("lat_std"), F.col("lon_std"), F.col("span_days"), F.col("loc_consistency"))).drop("impact_std", "lat_std", "lon_std", "span_days", "loc_consistency")
