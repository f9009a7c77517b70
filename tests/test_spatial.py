"""Shapes: segments, areas, exact distances against brute force."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stepchange.config import StudyConfig
from stepchange.operators import spatial


def table(spark, shapes):
    rows = [
        (zone, ring, seq, float(x), float(y))
        for zone, rings in shapes.items()
        for ring, points in enumerate(rings)
        for seq, (x, y) in enumerate(points)
    ]
    return spark.createDataFrame(rows, "zone_id long, ring int, seq int, x double, y double")


def square(x, y, side=10):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "zone_id long")


def distances(spark, shapes, *ids):
    found = spatial.seed_distance(table(spark, shapes), seeds(spark, *ids)).collect()
    return {r.zone_id: r.distance_to_seed_ft for r in found}


L_SHAPE = [(0, 0), (30, 0), (30, 10), (10, 10), (10, 30), (0, 30)]


def test_area_of_an_l_shape_and_of_a_square_with_a_hole(spark):
    hole = list(reversed(square(2, 2, 4)))
    data = table(spark, {1: [L_SHAPE], 2: [square(0, 0), hole]})
    assert {r.zone_id: r.area for r in spatial.zone_area(data).collect()} == {1: 500.0, 2: 84.0}


def test_segments_close_every_ring(spark):
    data = spatial.zone_segments(table(spark, {1: [L_SHAPE]}))
    last = data.orderBy(F.col("seq").desc()).first()
    assert (last.x2, last.y2) == (0.0, 0.0) and data.count() == 6


def test_distance_into_the_corner_of_an_l_shape(spark):
    found = distances(spark, {1: [L_SHAPE], 2: [square(14, 17, 3)], 3: [square(33, 4, 1)]}, 1)
    assert found == {1: 0.0, 2: 4.0, 3: 3.0}


def test_crossing_touching_and_nested_shapes_are_at_zero(spark):
    shapes = {
        1: [square(0, 0, 100)],
        2: [[(-10, 50), (110, 50), (110, 51), (-10, 51)]],  # crosses the seed
        3: [square(100, 20)],  # touches an edge
        4: [square(40, 20, 5)],  # inside the seed
        5: [square(-500, -500, 5000)],  # holds the seed
        6: [square(103, 104, 10)],  # nearest at a corner: 3-4-5
    }
    assert distances(spark, shapes, 1) == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 5.0}


def test_a_zone_in_the_hole_of_a_seed_is_not_inside_it(spark):
    shapes = {1: [square(0, 0, 100), list(reversed(square(20, 20, 60)))], 2: [square(45, 45, 10)]}
    assert distances(spark, shapes, 1) == {1: 0.0, 2: 25.0}


def brute(a, b):
    def point(p, s, e):
        dx, dy = e[0] - s[0], e[1] - s[1]
        t = max(0, min(1, ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - s[0] - t * dx, p[1] - s[1] - t * dy)

    edges = [list(zip(r, r[1:] + r[:1])) for r in (a, b)]
    return min(
        min(point(p, s2, e2) for p in (s1, e1)) if True else 0
        for s1, e1 in edges[0]
        for s2, e2 in edges[1]
    )


@pytest.mark.parametrize("spread", [50_000, 3_000])
def test_distances_match_brute_force_on_scattered_triangles(spark, spread):
    draw = random.Random(spread)
    shapes = {}
    for zone in range(80):
        # One cell of a grid each, so shapes never overlap
        x, y = (zone % 9) * spread // 9, (zone // 9) * spread // 9
        reach = spread // 12
        corner = [(x + draw.randrange(reach), y + draw.randrange(reach)) for _ in range(3)]
        if abs((corner[1][0] - corner[0][0]) * (corner[2][1] - corner[0][1]) - (corner[2][0] - corner[0][0]) * (corner[1][1] - corner[0][1])) < 10:
            corner = [(x, y), (x + 20, y), (x, y + 20)]
        shapes[zone] = [corner]
    chosen = (3, 40, 41, 77)
    found = distances(spark, shapes, *chosen)
    for zone, rings in shapes.items():
        both = [min(brute(rings[0], shapes[s][0]), brute(shapes[s][0], rings[0])) for s in chosen]
        expected = 0.0 if zone in chosen else min(both)
        assert abs(found[zone] - expected) <= 0.5


def test_all_seeds_in_one_place_and_far_zones(spark):
    shapes = {i: [square(i * 11, 0)] for i in range(20)} | {99: [square(1_000_000, 500_000)]}
    found = distances(spark, shapes, *range(10))
    assert found[99] == round(math.hypot(1_000_000 - 109, 500_000 - 10))
    assert found[10] == 1.0 and found[19] == 100.0


def test_labels_of_zones_with_and_without_a_shape(spark):
    cfg = replace(StudyConfig(), ring_distance_ft=20, near_distance_ft=40)
    shapes = {1: [square(0, 0)], 2: [square(10, 0)], 3: [square(25, 0)], 4: [square(45, 0)], 5: [square(90, 0)]}
    lookup = spark.createDataFrame([(i, f"z{i}") for i in range(1, 7)], "zone_id long, name string")
    found = spatial.zone_labels(lookup, table(spark, shapes), seeds(spark, 1), cfg).collect()
    assert {r.zone_id: (r.in_cbd, r.zone_group, r.zone_group_fine) for r in found} == {
        1: (True, "cbd", "cbd"),
        2: (False, "ring", "ring_adjacent"),
        3: (False, "ring", "ring_across"),
        4: (False, "control", "control_near"),
        5: (False, "control", "control_far"),
        6: (False, None, None),
    }


def test_identical_shapes_and_box(spark):
    data = table(spark, {1: [square(0, 0)], 2: [square(0, 0)], 3: [square(5, 5)]})
    assert [(r.zones, r.first_zone) for r in spatial.identical_shapes(data).collect()] == [(2, 1)]
    box = spatial.group_box(data, seeds(spark, 1, 3), 2, 1).first()
    assert tuple(box) == (-2.0, -1.0, 17.0, 16.0)


def test_no_cross_join_is_planned(spark):
    data = table(spark, {i: [square(i * 20, 0)] for i in range(5)})
    result = spatial.seed_distance(data, seeds(spark, 1))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def broadcast_rows(frame):
    """The plan that ran, and the rows of its broadcasts, largest first."""
    frame.collect()
    plan, rows = frame._jdf.queryExecution().executedPlan(), []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "BroadcastExchangeExec":
            rows.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.length()):
            walk(children.apply(i))

    walk(plan)
    return sorted(rows, reverse=True)


def test_vertices_are_not_broadcast_and_dense_seeds_take_a_deeper_tree(spark):
    """Explosions hide the size of a vertex table, so a broadcast of it could take the driver's memory."""
    key = F.col("id")
    corner = F.array(*[F.struct(F.lit(0).alias("ring"), F.lit(i).alias("seq"), (key % 200 * 30 + dx).cast("double").alias("x"), (F.floor(key / 200) * 30 + dy).cast("double").alias("y")) for i, (dx, dy) in enumerate(square(0, 0))])
    data = spark.range(6000).select(key.alias("zone_id"), F.explode(corner).alias("v")).select("zone_id", "v.*")
    chosen = spark.range(6000).where("id % 200 < 60").select(key.alias("zone_id"))
    found = spatial.seed_distance(data, chosen)
    assert max(broadcast_rows(found), default=0) <= 4**spatial.TILE_LEVELS
    expected = F.when(key % 200 < 60, 0).otherwise((key % 200 - 59) * 30 - 10).cast("double")
    wrong = found.join(spark.range(6000).select(key.alias("zone_id"), expected.alias("d")), "zone_id").where("d <> distance_to_seed_ft")
    assert found.count() == 6000 and wrong.count() == 0


def test_far_zones_keep_few_candidate_edges(spark):
    """A tile's ends bound the distance closely: a far zone isn't paired with a rim of seeds."""
    shapes = {i: [square(i % 40 * 20, i // 40 * 20)] for i in range(1600)} | {9000 + i: [square(9000, 37 * i)] for i in range(20)}
    data = table(spark, shapes)
    seeds = spark.range(1600).withColumnRenamed("id", "zone_id")
    found = spatial.boundary_distance(data, seeds, seeds)
    rows = {r.zone_id: r.distance for r in found.collect()}
    assert set(rows) == {9000 + i for i in range(20)}
    for i in range(20):
        y = 37 * i
        apart = min(max(20 * j - y - 10, y - 20 * j - 10, 0) for j in range(40))
        assert math.isclose(rows[9000 + i], math.hypot(9000 - 790, apart))
