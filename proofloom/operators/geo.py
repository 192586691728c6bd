"""Spatial read models with built-in arithmetic; coordinates are centi-degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

# Kinds of location, the most precise first.
PRECISIONS = ["surveyed", "approximate_1km", "approximate_10km", "regional", "admin_area", "claimed_only", "place_name_only", "non_located"]


def ranked(rows: DataFrame, orders: dict[str, list[Column]], key: str) -> DataFrame:
    """rows with their place in each of several total orders, ties by the key.

    Places come from a range shuffle, not from one task: rows are dealt into ranges of the order,
    ranked in each, and the sizes of the ranges before are added.
    """
    for name, by in orders.items():
        dealt = rows.repartitionByRange(*by, key).withColumn("__part", F.spark_partition_id())
        # written, as both readers must see the same ranges
        local = cut(dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*by, key))), "ranges")
        sizes = local.groupBy("__part").agg(F.count("*").alias("__n"))
        first = sizes.withColumn("__first", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).select("__part", "__first")  # one small row a range
        rows = local.join(first, "__part").withColumn(name, (F.col("__rank") + F.col("__first")).cast("int")).drop("__part", "__rank", "__first")
    return rows


def preferred(assertions: DataFrame) -> DataFrame:
    """One location an entity: the preferred, then the most precise, then the first that is not superseded; n tells how many compete."""
    precision = F.array_position(F.array(*(F.lit(p) for p in PRECISIONS)), F.col("loc_precision"))
    live = assertions.where("not superseded")
    best = live.withColumn("k", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("preferred"), precision, "assertion_id"))).where("k = 1").drop("k")
    return best.join(live.groupBy("entity_id").agg(F.count("*").alias("n")), "entity_id")


def render_mode(located: Column) -> Column:
    """How an entity may be shown; a point only where it is precise and its place is proven."""
    p = F.col("loc_precision")
    return (
        F.when(p.isin("place_name_only", "non_located"), "none").when(p.isin("surveyed", "approximate_1km") & located, "point").when(p == "regional", "region_polygon").when(p == "admin_area", "admin_polygon").otherwise("uncertainty_circle")
    )


def radius() -> Column:
    p = F.col("loc_precision")
    return F.when(p == "surveyed", F.col("radius_m")).when(p == "approximate_1km", 1000).when(p == "approximate_10km", 10000).otherwise(25000)


def grid_clusters(features: DataFrame, low: int = 2, high: int = 9) -> DataFrame:
    """Per zoom and degree cell: features, how many are precise, and up to 25 sample ids, the smallest."""
    cell = F.col("cell_c")
    z = features.withColumn("zoom", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("cell_c", F.greatest(F.lit(1), F.expr("36000 div cast(power(2, zoom + 3) as int)")))
    z = z.withColumn("cell_x", F.floor((F.col("lon_c") + 18000) / cell).cast("long")).withColumn("cell_y", F.floor((F.col("lat_c") + 9000) / cell).cast("long"))
    keys = ["zoom", "cell_x", "cell_y"]
    counts = z.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("mode") == "point").alias("points"))
    # the first 25 ids by a limited rank, which is taken in part before the shuffle
    first = z.select(*keys, "entity_id").withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("entity_id"))).where("k <= 25")
    sample = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("entity_id")).cast("array<string>"), ",").alias("sample"))
    return counts.join(sample, keys)


def viewport(features: DataFrame, west: int, south: int, east: int, north: int) -> DataFrame:
    """Features in a box; west > east crosses the antimeridian."""
    lon = F.col("lon_c").between(west, east) if west <= east else (F.col("lon_c") >= west) | (F.col("lon_c") <= east)
    return features.where(lon & F.col("lat_c").between(south, north))


def mercator(lon_c: Column, lat_c: Column) -> tuple[Column, Column]:
    """Web-Mercator metres."""
    r = 6378137.0
    return F.radians(lon_c / 100) * r, F.log(F.tan(F.lit(3.141592653589793 / 4) + F.radians(lat_c / 100) / 2)) * r


def tiles(features: DataFrame, zoom: int) -> DataFrame:
    """features with the slippy tile they fall in."""
    n = float(2**zoom)
    lat = F.radians(F.col("lat_c") / 100)
    x = F.floor((F.col("lon_c") / 100 + 180) / 360 * n).cast("int")
    y = F.floor((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / F.lit(3.141592653589793)) / 2 * n).cast("int")
    return features.withColumns({"x": x, "y": y})


EARTH = 6371000.0


def rings(features: DataFrame, segments: int) -> DataFrame:
    """entity_id, i, x, y: the closed ring of each feature's uncertainty circle on the ground, in degrees."""
    lat, lon, step = F.col("lat_c") / 100, F.col("lon_c") / 100, F.degrees(F.coalesce("radius_m", F.lit(25000)) / EARTH)
    turned = features.withColumns({"lat": lat, "lon": lon, "step": step}).select("entity_id", "lat", "lon", "step", F.explode(F.sequence(F.lit(0), F.lit(segments))).alias("i"))
    angle = F.lit(2 * 3.141592653589793) * F.col("i") / segments
    return turned.select("entity_id", "i", (F.col("lon") + F.col("step") / F.greatest(F.cos(F.radians("lat")), F.lit(0.01)) * F.cos(angle)).alias("x"), (F.col("lat") + F.col("step") * F.sin(angle)).alias("y"))


def _crossings(ring: Column, y: Column) -> Column:
    """x of the places where a ring (an array of x, y structs, closed) crosses the level y, sorted."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hit = F.filter(edges, lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    return F.array_sort(F.transform(hit, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))


def label_point(ring: Column) -> tuple[Column, Column]:
    """A point inside a ring: the middle of the first chord at half height (for simple rings)."""
    ys = F.transform(ring, lambda p: p["y"])
    y = (F.array_min(ys) + F.array_max(ys)) / 2
    cuts = _crossings(ring, y)
    return (F.element_at(cuts, 1) + F.element_at(cuts, 2)) / 2, y


def points_in_rings(points: DataFrame, areas: DataFrame, cell: int) -> DataFrame:
    """points joined to the areas (ring: a closed array of x, y structs) that hold them.

    An area is keyed by every grid cell its box covers, a point by its own, so the join is an equi-join;
    then the crossings of a ray to the right are counted.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    keyed = areas.withColumn("cx", F.explode(F.sequence(at(F.array_min(xs)), at(F.array_max(xs))))).withColumn("cy", F.explode(F.sequence(at(F.array_min(ys)), at(F.array_max(ys)))))
    met = points.withColumns({"cx": at(F.col("lon_c")), "cy": at(F.col("lat_c"))}).join(keyed, ["cx", "cy"])
    right = F.size(F.filter(_crossings(F.col("ring"), F.col("lat_c").cast("double")), lambda x: x > F.col("lon_c")))
    return met.where(right % 2 == 1).drop("cx", "cy", "ring")


def in_boxes(features: DataFrame, boxes: DataFrame, cell: int) -> DataFrame:
    """features joined to the boxes (west, east, south, north) that hold them, by grid cells and a residual test."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    keyed = boxes.withColumn("cx", F.explode(F.sequence(at("west"), at("east")))).withColumn("cy", F.explode(F.sequence(at("south"), at("north"))))
    met = features.withColumns({"cx": at("lon_c"), "cy": at("lat_c")}).join(keyed, ["cx", "cy"])
    return met.where(F.col("lon_c").between(F.col("west"), F.col("east")) & F.col("lat_c").between(F.col("south"), F.col("north"))).drop("cx", "cy")


def ground_distance(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Great-circle metres between places in centi-degrees."""
    rad = lambda c: F.radians(c / 100)
    half = lambda a, b: F.pow(F.sin((rad(a) - rad(b)) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), half(lat_a, lat_b) + F.cos(rad(lat_a)) * F.cos(rad(lat_b)) * half(lon_a, lon_b))))


def place_classes(points: DataFrame, key: str = "entity_id") -> DataFrame:
    """id, class, lon_c, lat_c: the least id at the very same place, so that a place with many is one point of a join."""
    at = points.groupBy("lon_c", "lat_c").agg(F.min(key).alias("class"))
    return points.select(F.col(key).alias("id"), "lon_c", "lat_c").join(at, ["lon_c", "lat_c"]).select("id", "class", "lon_c", "lat_c")


def near_pairs(points: DataFrame, metres: int) -> DataFrame:
    """Pairs (a, b), a < b, of points (id, lon_c, lat_c) at most so far apart on the ground; all there are.

    The globe is cut into bands of latitude as high as the distance, and each band into as many equal cells as
    are at least as wide as a point of it or of the bands beside it can reach. A point stands in its own cell and looks
    into those of its own band and the bands beside that its reach touches, around the dateline and, where a
    band is one cell, around the pole. Crowded cells are split by AQE, as the join needs nothing of a cell together.
    """
    step = math.degrees(metres / EARTH) * 100 * (1 + 1e-9)
    bands = max(1, math.floor(18000 / step))
    height = 18000 / bands
    band = F.least(F.lit(bands - 1), F.floor((F.col("lat_c") + 9000) / height).cast("int"))

    def reach(lat: Column) -> Column:
        """Greatest difference of longitude, in centi-degrees, to a place within the distance of one at this latitude."""
        c, s = F.cos(F.radians(lat / 100)), F.lit(math.sin(metres / EARTH * (1 + 1e-9)))
        return F.when((c <= s) | F.lit(metres >= EARTH * math.pi / 2), 18000.0).otherwise(F.degrees(F.asin(s / c)) * 100)

    def cells(b: Column) -> Column:
        """Cells of a band: as wide as the reach at its end nearer to a pole, one band further on."""
        far = F.least(F.lit(9000.0), F.greatest(F.abs((b - 1) * height - 9000), F.abs((b + 2) * height - 9000)))
        return F.greatest(F.lit(1), F.floor(36000 / F.greatest(reach(far), F.lit(height))).cast("int"))

    here = points.select("id", "lon_c", "lat_c").withColumn("band", band).withColumn("n", cells(F.col("band")))
    cell = lambda lon: F.floor((lon + 18000) / 36000 * F.col("n")).cast("int")
    stands = here.select(F.col("id").alias("b"), F.col("lon_c").alias("lon_b"), F.col("lat_c").alias("lat_b"), "band", F.pmod(cell(F.col("lon_c")), F.col("n")).alias("cell"))
    looks = here.withColumn("own", F.col("band")).withColumn("band", F.explode(F.filter(F.array(*(F.col("own") + k for k in (-1, 0, 1))), lambda b: (b >= 0) & (b < bands)))).withColumn("n", cells(F.col("band")))
    wide = reach(F.col("lat_c"))
    low, high = cell(F.col("lon_c") - wide), cell(F.col("lon_c") + wide)
    looks = looks.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(low, F.least(high, low + F.col("n") - 1)), lambda c: F.pmod(c, F.col("n"))))))
    met = looks.select(F.col("id").alias("a"), "lon_c", "lat_c", "band", "cell").join(stands, ["band", "cell"]).where("a < b")
    return met.where(ground_distance(F.col("lon_c"), F.col("lat_c"), F.col("lon_b"), F.col("lat_b")) <= metres).select("a", "b")
