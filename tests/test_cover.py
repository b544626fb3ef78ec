"""Polygons on the grid by cells, and closed rings, against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import geom, rings

SHAPE = "polygon int, vertices array<struct<x:double,y:double>>"


def grid(spark, width, height):
    n = spark.range(width * height)
    return n.select(F.col("id").alias("idx"), (F.col("id") % width).cast("int").alias("px"), F.floor(F.col("id") / width).cast("int").alias("py"))


def inside(x, y, v):
    odd = False
    for (ax, ay), (bx, by) in zip(v, [v[-1], *v[:-1]]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def shapes(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        size, at = r.choice((0.4, 3, 30, 200)), (r.uniform(-20, 160), r.uniform(-20, 60))
        corner = (lambda: (r.uniform(0, size), r.uniform(0, size))) if k % 3 else lambda: (r.randint(0, int(size)) + 0.5, r.randint(0, int(size)) + 0.5)
        out.append([(at[0] + x, at[1] + y) if k % 3 else (int(at[0]) + x, int(at[1]) + y) for x, y in (corner() for _ in range(r.randint(3, 9)))])
    return out


def frame(spark, polygons):
    return spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in enumerate(polygons)], SHAPE)


@pytest.mark.parametrize("box", [None, (0, 0, 139, 39)])
def test_random_polygons(spark, box):
    """Sides along pixel centres, self-crossing and tiny ones, and parts beyond the grid."""
    made = shapes(1, 60)
    found = geom.rasterise(grid(spark, 140, 40), frame(spark, made).union(frame(spark, made[:1])), box)
    got = collections.Counter((r["polygon"], r["px"], r["py"]) for r in found.collect())
    assert got == collections.Counter((k, x, y) for k, v in enumerate(made) for x in range(140) for y in range(40) if inside(x + 0.5, y + 0.5, v))
    assert found.columns == ["idx", "px", "py", "polygon"]


def test_no_polygons(spark):
    p = grid(spark, 5, 5)
    none = spark.createDataFrame([(1, None), (2, []), (3, [{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 9.0}])], SHAPE)
    assert geom.rasterise(p, none).collect() == []


def test_many_polygons_meet_pixels_by_cells(spark):
    """42,000 polygons: no nested loop, and rows as one by one."""
    n = 42_000
    k = F.col("id")
    x, y = (k * 7) % 290, (k * 13) % 195
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    many = spark.range(n).select(k.cast("int").alias("polygon"), F.array(corner(0.2, 0.2), corner(3.7, 1.1), corner(2.2, 4.9), corner(0.9, 2.6)).alias("vertices"))
    found = geom.rasterise(grid(spark, 300, 200), many)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = found.groupBy("polygon").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("px") * 1000 + F.col("py")).alias("s"))
    v = [(0.2, 0.2), (3.7, 1.1), (2.2, 4.9), (0.9, 2.6)]
    cells = [(a, b) for a in range(6) for b in range(6) if inside(a + 0.5, b + 0.5, v)]
    want = (n, n * len(cells), sum(((i * 7) % 290 + a) * 1000 + (i * 13) % 195 + b for i in range(n) for a, b in cells))
    assert got.agg(F.count(F.lit(1)), F.sum("n"), F.sum("s")).first() == want


def test_a_long_side_is_dealt_out(spark):
    rows = geom.stepped(spark.range(3), F.col("id") * 10_000 - 5, F.col("id") * 10_000 + F.lit(9000) * F.col("id"), "at")
    assert rows.groupBy("id").agg(F.count(F.lit(1)), F.min("at"), F.max("at")).orderBy("id").collect() == [(0, 6, -5, 0), (1, 9006, 9995, 19_000), (2, 18_006, 19_995, 38_000)]


def traced(cells):
    """Rings of a set of cells as lists of corners, each with the cell that its first side belongs to."""
    sides = {}
    for x, y in cells:
        for outer, a, b in (((x, y - 1), (x, y), (x + 1, y)), ((x + 1, y), (x + 1, y), (x + 1, y + 1)), ((x, y + 1), (x + 1, y + 1), (x, y + 1)), ((x - 1, y), (x, y + 1), (x, y))):
            if outer not in cells:
                sides[a, (b[0] - a[0], b[1] - a[1])] = (x, y)
    out = []
    while sides:
        (at, way), cell = min(sides.items())
        start, ring, first = (at, way), [], cell
        while True:
            sides.pop((at, way))
            at = (at[0] + way[0], at[1] + way[1])
            right, left = (-way[1], way[0]), (way[1], -way[0])
            turn = next(w for w in (right, way, left) if (at, w) in sides or (at, w) == start)
            if turn != way:
                ring.append(at)
            way = turn
            if (at, way) == start:
                break
        out.append((ring, first))
    return out


def components(cells):
    left, out = set(cells), {}
    while left:
        todo = [left.pop()]
        name = todo[0]
        while todo:
            x, y = todo.pop()
            out[x, y] = name
            for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if near in left:
                    left.remove(near)
                    todo.append(near)
    return out


def test_rings_as_traced(spark):
    """Random sets, nested holes, cells that touch at corners, a null label and repeated pixels."""
    r = random.Random(2)
    sets = {"random": {(r.randrange(14), r.randrange(12)) for _ in range(95)}, "one": {(-3, 7)}, None: {(0, 0), (1, 1), (2, 0)}}
    square = {(x, y) for x in range(11) for y in range(11)}
    sets["nested"] = square - {(x, y) for x in range(1, 10) for y in range(1, 10)} | {(x, y) for x in range(2, 9) for y in range(2, 9)} - {(4, 4), (5, 5), (6, 4), (7, 4)}
    sets["comb"] = {(x, y) for x in range(40) for y in range(9) if y == 0 or x % 2 == 0}
    sets["sieve"] = {(x, y) for x in range(15) for y in range(7)} - {(2, 2), (4, 2), (6, 2), (8, 2), (10, 2), (13, 2), (2, 4), (7, 4), (8, 4), (8, 5)}
    rows = [(k, x, y) for k, v in sets.items() for x, y in v]
    cells = spark.createDataFrame([*rows, rows[0], ("random", None, 3)], "label string, px int, py int").repartition(3)
    found = rings.outlines(cells).collect()
    corners, holes, polygon = collections.defaultdict(dict), {}, {}
    for row in found:
        corners[row["label"], row["ring"]][row["place"]] = (row["x"], row["y"])
        holes[row["ring"]], polygon[row["ring"]] = row["hole"], row["polygon"]
    got, want = collections.Counter(), collections.Counter()
    for (label, _), at in corners.items():
        assert sorted(at) == list(range(len(at)))
        got[label, smallest([at[k] for k in range(len(at))])] += 1
    of = {}
    for label, v in sets.items():
        part = components(v)
        for ring, cell in traced(v):
            want[label, smallest(ring)] += 1
            of[label, smallest(ring)] = label, part[cell]
    assert got == want
    outer = {}
    for (label, ring), at in corners.items():
        if not holes[ring]:
            outer[ring] = of[label, smallest([at[k] for k in range(len(at))])]
            assert polygon[ring] == ring
    assert len(set(outer.values())) == len(outer) and sum(holes.values()) >= 6
    for (label, ring), at in corners.items():
        if holes[ring]:
            assert outer[polygon[ring]] == of[label, smallest([at[k] for k in range(len(at))])]
    area = {r["label"]: r["n"] for r in rings.areas(rings.outlines(cells)).groupBy("label").agg(F.sum("area").alias("n")).collect()}
    assert area == {k: len(v) for k, v in sets.items()}


def smallest(ring):
    return min(tuple(ring[k:] + ring[:k]) for k in range(len(ring)))


def test_no_rings(spark):
    assert rings.outlines(spark.createDataFrame([], "label string, px int, py int")).collect() == []
