"""Zone shapes as vertex tables: segments, areas, boxes, distance to a seed area.

A vertex table has ``zone_id, ring, seq, x, y`` in planar units. Rings close
themselves: the last vertex joins the first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepchange.config import StudyConfig

SQUARE_FEET_PER_SQUARE_MILE = 27_878_400
# Levels of tiles that are broadcast. Level k has at most 4**k tiles
TILE_LEVELS = 6
# Levels of the seed tile tree at most
MAX_LEVELS = 15


def zone_segments(vertices: DataFrame) -> DataFrame:
    """Edges of every ring: one row per vertex, with the vertex that follows it."""
    ring = W.partitionBy("zone_id", "ring").orderBy("seq")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def following(name: str) -> Column:
        return F.coalesce(F.lead(name).over(ring), F.first(name).over(whole))

    return vertices.select(
        "zone_id",
        "ring",
        "seq",
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        following("x").alias("x2"),
        following("y").alias("y2"),
    )


def zone_area(vertices: DataFrame) -> DataFrame:
    """Area of every zone. Holes run the other way round, so they subtract."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return (
        zone_segments(vertices)
        .groupBy("zone_id")
        .agg((F.abs(F.sum(cross)) / 2).alias("area"))
        .withColumn("area_sq_mi", F.round(F.col("area") / SQUARE_FEET_PER_SQUARE_MILE, 3))
    )


def identical_shapes(vertices: DataFrame) -> DataFrame:
    """Shapes that more than one zone has, by a fingerprint of the vertices."""
    vertex = F.xxhash64("ring", "seq", "x", "y")
    shapes = vertices.groupBy("zone_id").agg(F.sum(vertex.cast("decimal(38,0)")).alias("shape"))
    return (
        shapes.groupBy("shape")
        .agg(F.count("*").alias("zones"), F.min("zone_id").alias("first_zone"))
        .where(F.col("zones") > 1)
    )


def zone_boxes(vertices: DataFrame) -> DataFrame:
    """Bounding box of every zone."""
    return vertices.groupBy("zone_id").agg(
        F.min("x").alias("zx1"),
        F.min("y").alias("zy1"),
        F.max("x").alias("zx2"),
        F.max("y").alias("zy2"),
    )


def group_box(vertices: DataFrame, zones: DataFrame, pad_x: float, pad_y: float) -> DataFrame:
    """Padded bounding box of a set of zones: one row."""
    inside = vertices.join(zones.select("zone_id").distinct().hint("merge"), "zone_id", "left_semi")
    return inside.agg(
        (F.min("x") - pad_x).alias("min_x"),
        (F.min("y") - pad_y).alias("min_y"),
        (F.max("x") + pad_x).alias("max_x"),
        (F.max("y") + pad_y).alias("max_y"),
    )


# Distances between two segments (a and b) -----------------------------------


def _point_to_segment(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    along = F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy)
    t = F.greatest(F.least(F.coalesce(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def _side(x1, y1, x2, y2, px, py) -> Column:
    return F.signum((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1))


def segment_distance(a: tuple, b: tuple) -> Column:
    """Distance of two segments, each (x1, y1, x2, y2); 0 if they cross.

    Segments that only touch have an end on the other one, so the point
    distances cover them.
    """
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    crossing = (_side(*a, bx1, by1) * _side(*a, bx2, by2) < 0) & (
        _side(*b, ax1, ay1) * _side(*b, ax2, ay2) < 0
    )
    nearest = F.least(
        _point_to_segment(ax1, ay1, *b),
        _point_to_segment(ax2, ay2, *b),
        _point_to_segment(bx1, by1, *a),
        _point_to_segment(bx2, by2, *a),
    )
    return F.when(crossing, 0.0).otherwise(nearest)


def _extent(vertices: DataFrame) -> tuple[float, float, float, int]:
    """Corner and side of the square that holds every vertex, and their number (one row)."""
    row = vertices.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).first()
    if row[0] is None:
        return 0.0, 0.0, 1.0, 0
    side = max(row[2] - row[0], row[3] - row[1])
    return row[0], row[1], (side or 1.0) * (1 + 1e-9), row[4]


def _tile(value: Column, low: float, side: float, level: int) -> Column:
    return F.floor((value - low) / (side / 2**level)).cast("int")


# The vertices farthest west, east, south and north: their box is tight, and each is on the shape
ENDS = ("w", "e", "s", "n")
PLACES = tuple(f"{end}{axis}" for end in ENDS for axis in "xy")


def _extremes(points: DataFrame, keys: tuple[str, ...], prefix: str) -> DataFrame:
    """Of each key the points at the ends, as columns ``<prefix>wx`` to ``<prefix>ny``."""
    across, up = F.struct("x", "y"), F.struct("y", (-F.col("x")).alias("x"))
    ends = points.groupBy(*keys).agg(
        F.min(across).alias("w"), F.max(across).alias("e"), F.min(up).alias("s"), F.max(up).alias("n")
    )
    sign = {"w": 1, "e": 1, "s": -1, "n": -1}
    places = [
        (F.col(f"{end}.{axis}") * (sign[end] if axis == "x" else 1)).alias(f"{prefix}{end}{axis}")
        for end in ENDS
        for axis in "xy"
    ]
    return ends.select(*keys, *places)


def _ends(prefix: str) -> list[tuple[Column, Column]]:
    return [(F.col(f"{prefix}{end}x"), F.col(f"{prefix}{end}y")) for end in ENDS]


def _box(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(prefix + place) for place in ("wx", "sy", "ex", "ny"))


def _bounds(ends: list[tuple], box: tuple) -> tuple[Column, Column]:
    """Bounds of the distance of a zone to edges with these ends in this box.

    It isn't less than the distance of the boxes, nor more than that of any two ends.
    """
    ax1, ay1, ax2, ay2 = _box("z")
    bx1, by1, bx2, by2 = box
    zero = F.lit(0.0)
    low = F.hypot(F.greatest(bx1 - ax2, ax1 - bx2, zero), F.greatest(by1 - ay2, ay1 - by2, zero))
    high = F.least(*[F.hypot(zx - x, zy - y) for zx, zy in _ends("z") for x, y in ends])
    return low, high


def _seed_edges(seed_vertices: DataFrame, extent: tuple, level: int) -> DataFrame:
    """Seed edges, each in the one leaf tile of its midpoint."""
    x0, y0, side, _ = extent
    return zone_segments(seed_vertices).select(
        F.col("x1").alias("sx1"),
        F.col("y1").alias("sy1"),
        F.col("x2").alias("sx2"),
        F.col("y2").alias("sy2"),
        _tile((F.col("x1") + F.col("x2")) / 2, x0, side, level).alias("tx"),
        _tile((F.col("y1") + F.col("y2")) / 2, y0, side, level).alias("ty"),
    )


def _tile_tree(points: DataFrame, steps: int) -> DataFrame:
    """Seed tiles some steps above the leaves with the ends of their edges."""
    above = points.select(
        F.shiftright("tx", steps).alias("tx"), F.shiftright("ty", steps).alias("ty"), "x", "y"
    )
    return _extremes(above, ("tx", "ty"), "t")


def _prune(candidates: DataFrame, bounds: tuple[Column, Column]) -> DataFrame:
    """Keep candidates that may hold a zone's nearest seed edge."""
    low, high = bounds
    return (
        candidates.withColumn("low", low)
        .withColumn("best", F.min(high).over(W.partitionBy("zone_id")))
        # The two are rounded apart
        .where(F.col("low") <= F.col("best") * (1 + 1e-9))
        .drop("low", "best")
    )


def boundary_distance(vertices: DataFrame, seeds: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Least distance from each zone's edges to any seed edge, exactly.

    Seed edges sit in a tree of tiles, as deep as leaves take to hold a few edges.
    Every zone walks down the tree and, at each level, drops tiles whose nearest
    point is farther than some edge's end in another tile, so no zone is paired
    with every seed. Levels of up to 4**TILE_LEVELS tiles are broadcast; whatever
    grows with the zones or seeds is shuffled. Zones in ``known`` are left out.
    """
    seed_vertices = vertices.join(seeds.select("zone_id"), "zone_id", "left_semi")
    extent = _extent(seed_vertices)
    depth = max(1, min(MAX_LEVELS, math.ceil(math.log(max(extent[3], 4) / 4, 4))))
    edges = _seed_edges(seed_vertices, extent, depth)
    ends = F.array(F.struct(F.col("sx1").alias("x"), F.col("sy1").alias("y")), F.struct(F.col("sx2").alias("x"), F.col("sy2").alias("y")))
    leaves = _extremes(edges.select("tx", "ty", F.explode(ends).alias("p")).select("tx", "ty", "p.*"), ("tx", "ty"), "t")
    corners = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in _ends("t")])
    points = leaves.select("tx", "ty", F.explode(corners).alias("p")).select("tx", "ty", "p.*")

    searched = vertices if known is None else vertices.join(known.select("zone_id").hint("merge"), "zone_id", "left_anti")
    places = [f"z{place}" for place in PLACES]
    frontier = _extremes(searched, ("zone_id",), "z").withColumns({"tx": F.lit(0), "ty": F.lit(0)})
    halves = F.array(F.lit(0), F.lit(1))
    for level in range(1, depth + 1):
        children = (
            frontier.select("zone_id", *places, "tx", "ty", F.explode(halves).alias("right"))
            .select("*", F.explode(halves).alias("upper"))
            .select(
                "zone_id",
                *places,
                (F.col("tx") * 2 + F.col("right")).alias("tx"),
                (F.col("ty") * 2 + F.col("upper")).alias("ty"),
            )
        )
        occupied = _tile_tree(points, depth - level)
        occupied = F.broadcast(occupied) if level <= TILE_LEVELS else occupied.hint("merge")
        frontier = _prune(children.join(occupied, ["tx", "ty"]), _bounds(_ends("t"), _box("t")))
        frontier = frontier.select("zone_id", *places, "tx", "ty")
    edge = tuple(F.col(name) for name in ("sx1", "sy1", "sx2", "sy2"))
    box = (F.least("sx1", "sx2"), F.least("sy1", "sy2"), F.greatest("sx1", "sx2"), F.greatest("sy1", "sy2"))
    nearby = _prune(frontier.join(edges.hint("merge"), ["tx", "ty"]), _bounds([edge[:2], edge[2:]], box)).select(
        "zone_id", "sx1", "sy1", "sx2", "sy2"
    )
    distance = segment_distance(tuple(F.col(name) for name in ("x1", "y1", "x2", "y2")), edge)
    return (
        nearby.join(zone_segments(searched).hint("merge"), "zone_id")
        .groupBy("zone_id")
        .agg(F.min(distance).alias("distance"))
    )


def points_inside(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs of a point and a zone whose shape holds it, by counting ray crossings.

    ``points`` has ``point_id, px, py``. Zones are found by the tiles their box
    covers, at most 4**TILE_LEVELS of them.
    """
    x0, y0, side, _ = _extent(vertices)
    level = TILE_LEVELS

    def tile(column: str, low: float) -> Column:
        return _tile(F.col(column), low, side, level)

    covered = (
        zone_boxes(vertices)
        .select(
            "*",
            F.explode(F.sequence(tile("zx1", x0), tile("zx2", x0))).alias("tx"),
        )
        .select("*", F.explode(F.sequence(tile("zy1", y0), tile("zy2", y0))).alias("ty"))
    )
    located = points.select(
        "point_id", "px", "py", tile("px", x0).alias("tx"), tile("py", y0).alias("ty")
    )
    candidates = (
        located.join(covered.hint("merge"), ["tx", "ty"])
        .where(F.col("px").between(F.col("zx1"), F.col("zx2")))
        .where(F.col("py").between(F.col("zy1"), F.col("zy2")))
        .where(F.col("point_id") != F.col("zone_id"))
        .select("point_id", "px", "py", "zone_id")
    )
    spans = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    at = F.col("x1") + F.try_divide(
        (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1")
    )
    return (
        candidates.join(zone_segments(vertices).hint("merge"), "zone_id")
        .groupBy("point_id", "zone_id")
        .agg(F.count_if(spans & (F.col("px") < at)).alias("crossings"))
        .where(F.col("crossings") % 2 == 1)
        .select("point_id", "zone_id")
    )


def seed_distance(vertices: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distance of every zone to the seed zones: 0 if they touch, cross or nest.

    The distance to the seeds' union is the least distance to any of them.
    """
    first = vertices.groupBy("zone_id").agg(F.min_by(F.struct("x", "y"), F.struct("ring", "seq")).alias("p"))
    points = first.select(
        F.col("zone_id").alias("point_id"), F.col("p.x").alias("px"), F.col("p.y").alias("py")
    )
    seed_ids = seeds.select("zone_id")
    seed_shapes = vertices.join(seed_ids, "zone_id", "left_semi")
    seed_points = points.join(seed_ids.withColumnRenamed("zone_id", "point_id"), "point_id", "left_semi")
    nested = (
        points_inside(points, seed_shapes)
        .select(F.col("point_id").alias("zone_id"))
        .unionByName(points_inside(seed_points, vertices).select("zone_id"))
        .unionByName(seed_ids)
        .distinct()
    )
    return (
        boundary_distance(vertices, seeds, nested)
        .unionByName(nested.select("zone_id", F.lit(0.0).alias("distance")))
        .groupBy("zone_id")
        .agg(F.round(F.min("distance"), 0).alias("distance_to_seed_ft"))
    )


def zone_labels(
    lookup: DataFrame, vertices: DataFrame, seeds: DataFrame, cfg: StudyConfig
) -> DataFrame:
    """Every zone of the lookup with its distance to the seed area and its groups.

    Zones without a shape keep null groups.
    """
    flagged = lookup.join(
        seeds.select("zone_id", F.lit(True).alias("in_cbd")).hint("merge"), "zone_id", "left"
    ).withColumn("in_cbd", F.coalesce("in_cbd", F.lit(False)))
    distance = F.col("distance_to_seed_ft")
    coarse = (
        F.when(distance.isNull(), None)
        .when(F.col("in_cbd"), "cbd")
        .when(distance <= cfg.ring_distance_ft, "ring")
        .otherwise("control")
    )
    fine = (
        F.when(F.col("zone_group") != "ring", None)
        .when(distance == 0, "ring_adjacent")
        .when(distance > 0, "ring_across")
    )
    near = F.when(distance <= cfg.near_distance_ft, "control_near").otherwise("control_far")
    return (
        flagged.join(seed_distance(vertices, seeds).hint("merge"), "zone_id", "left")
        .withColumn("zone_group", coarse)
        .withColumn(
            "zone_group_fine",
            F.when(F.col("zone_group") == "control", near)
            .when(F.col("zone_group") == "ring", fine)
            .otherwise(F.col("zone_group")),
        )
    )
