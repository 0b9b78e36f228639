import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import overlay, projection

SCHEMA = "key string, rings array<array<struct<x:double,y:double>>>"


def table(spark, rows):
    return spark.createDataFrame([(k, None if rings is None else [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in rows], SCHEMA)


def inside(rings, x, y):
    odd = False
    for r in rings or []:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd


def polygons_of(wkt):
    """Rings of a multi-polygon's text."""
    text = wkt.removeprefix("MULTIPOLYGON ").strip()
    if text == "EMPTY":
        return []
    return [[tuple(map(float, p.split())) for p in r.strip("()").split(", ")][:-1] for part in text[1:-1].split("), (") for r in part.split("), (")]


@pytest.mark.parametrize("per_band", [256, 8])
def test_random_polygons_equal_a_raster(spark, per_band):
    rng = random.Random(7)
    rows = []
    for key in range(25):
        for _ in range(rng.randrange(1, 6)):
            n = rng.randrange(3, 9)
            rows.append((str(key), [[(rng.randrange(40) / 2, rng.randrange(40) / 2) for _ in range(n)] for _ in range(rng.randrange(1, 3))]))
    df = table(spark, rows)
    area = {r.key: r.surface for r in overlay.surfaces(df, grid=1e-3, edges_per_band=per_band).collect()}
    texts = {r.key: r for r in overlay.unions(df, grid=1e-3, edges_per_band=per_band).collect()}
    for key in map(str, range(25)):
        parts = [rings for k, rings in rows if k == key]
        rings = polygons_of(texts[key].wkt)
        points = [(rng.random() * 20, rng.random() * 20) for _ in range(1500)]
        hits = [any(inside(p, *q) for p in parts) for q in points]
        # The outline encloses the same points, by parity of all its rings, and the area agrees with the share of hits.
        assert sum(a != inside(rings, *q) for a, q in zip(hits, points)) <= 2
        assert abs(area[key] - 400 * sum(hits) / 1500) < 400 * 4 * math.sqrt(0.25 / 1500)
        signed = sum(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1])) / 2 for r in rings)
        assert signed == pytest.approx(area[key], abs=0.05)


def test_cuts_and_orders_give_one_digest(spark):
    rng = random.Random(2)
    shapes = [[[(rng.randrange(60), rng.randrange(60)) for _ in range(7)]] for _ in range(6)]
    turned = [[r[k:] + r[:k] for r in rings for k in [rng.randrange(7)]] for rings in shapes]
    rows = [("a", s) for s in shapes] + [("b", [r[::-1] for r in s]) for s in reversed(turned)] + [("c", s) for s in shapes + shapes]
    few = {r.key: r.empreinte for r in overlay.unions(table(spark, rows), grid=1e-3).collect()}
    many = {r.key: r.empreinte for r in overlay.unions(table(spark, rows), grid=1e-3, edges_per_band=5).collect()}
    assert len(set(few.values())) == 1 and few == many


def test_known_shapes(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    rows = [
        ("knot", [[(0, 0), (2, 2), (2, 0), (0, 2)]]), ("hole", [square, [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]]), ("corner", [square]), ("corner", [[(2, 2), (3, 2), (3, 3), (2, 3)]]),
        ("side", [square]), ("side", [[(2, 0), (4, 0), (4, 2), (2, 2)]]), ("twice", [square + square]), ("line", [[(0, 0), (1, 1)]]), ("point", [[(1, 1)]]), ("none", None), ("empty", []), ("empty ring", [[]]),
        ("closed", [square + square[:1]]), ("island", [square, [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]]), ("island", [[(0.8, 0.8), (1.2, 0.8), (1.2, 1.2), (0.8, 1.2)]]),
    ]
    got = {r.key: r for r in overlay.unions(table(spark, rows)).join(overlay.surfaces(table(spark, rows)), "key").collect()}
    found = {k: (round(r.surface, 6), r.nb_parties, r.nb_trous) for k, r in got.items()}
    assert found == {
        "knot": (2.0, 2, 0), "hole": (3.0, 1, 1), "corner": (5.0, 2, 0), "side": (8.0, 1, 0), "twice": (0.0, 0, 0), "line": (0.0, 0, 0), "point": (0.0, 0, 0), "none": (0.0, 0, 0), "empty": (0.0, 0, 0),
        "empty ring": (0.0, 0, 0), "closed": (4.0, 1, 0), "island": (3.16, 2, 1),
    }
    assert got["side"].wkt == "MULTIPOLYGON (((0.0000 0.0000, 4.0000 0.0000, 4.0000 2.0000, 0.0000 2.0000, 0.0000 0.0000)))"
    assert got["none"].wkt == "MULTIPOLYGON EMPTY" and got["knot"].wkt.count("1.0000 1.0000") == 3
    assert overlay.unions(table(spark, [])).collect() == []


def test_one_large_key_is_cut_into_bands(spark):
    strips = [("k", [[(0, 2 * j), (100, 2 * j), (100, 2 * j + 1), (0, 2 * j + 1)]]) for j in range(500)] + [("k", [[(50, 0), (51, 0), (51, 999), (50, 999)]])]
    df = table(spark, strips)
    bands = overlay.trapezoids(df, edges_per_band=64)
    assert overlay.surfaces(df, edges_per_band=64).first().surface == pytest.approx(500 * 100 + 499)
    got = overlay.unions(df, edges_per_band=64).first()
    assert (got.nb_parties, got.nb_trous) == (1, 0) and bands.count() >= 999


def on(spark, p, lon, lat):
    x, y = p.forward(F.lit(lon), F.lit(lat))
    back = p.inverse(F.lit(0.0) + x, F.lit(0.0) + y)
    r = spark.range(1).select(x.alias("x"), y.alias("y"), back[0].alias("lon"), back[1].alias("lat")).first()
    assert abs(r.lon - lon) < 1e-9 and abs(r.lat - lat) < 1e-9
    return r.x, r.y


def test_published_control_points(spark):
    # The worked examples that the register of projections publishes: a national grid, and a state plane in feet.
    airy = projection.TransverseMercator(projection.Ellipsoid(6377563.396, 299.3249646), 49.0, -2.0, 0.9996012717, 400000.0, -100000.0)
    assert on(spark, airy, 0.5, 50.5) == (pytest.approx(577274.99, abs=0.01), pytest.approx(69740.50, abs=0.01))
    foot = 12 / 39.37
    state = projection.LambertConic(projection.Ellipsoid(6378206.4, 294.978698214), 27 + 50 / 60, -99.0, (28 + 23 / 60, 30 + 17 / 60), 2_000_000 * foot, 0.0)
    x, y = on(spark, state, -96.0, 28.5)
    assert x / foot == pytest.approx(2963503.91, abs=0.01) and y / foot == pytest.approx(254759.80, abs=0.01)


def test_origins_scale_and_arc(spark):
    assert on(spark, projection.PROJECTIONS[2154], 3.0, 46.5) == (pytest.approx(700000, abs=1e-6), pytest.approx(6600000, abs=1e-6))
    assert on(spark, projection.PROJECTIONS[2975], 57.0, 0.0) == (pytest.approx(500000, abs=1e-6), pytest.approx(10_000_000, abs=1e-6))
    # On the meridian the northing is the scaled arc, here by numerical integration.
    e2, a, n = projection.GRS80.e**2, projection.GRS80.a, 200_000
    step = math.radians(45) / n
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * step) ** 2) ** 1.5 * step for k in range(n))
    assert on(spark, projection.utm(38, False), 45.0, 45.0)[1] == pytest.approx(0.9996 * arc, abs=1e-4)
    # Conformal: a small step has the same length along both axes.
    for code in (2154, 2975, 4471, 5490):
        p = projection.PROJECTIONS[code]
        lon, lat = (p.lon0 + 1.5, 45.0) if code == 2154 else (p.lon0 + 1.5, -15.0 if p.y0 else 15.0)
        (x0, y0), (x1, y1), (x2, y2) = on(spark, p, lon, lat), on(spark, p, lon + 1e-5, lat), on(spark, p, lon, lat + 1e-5)
        s = math.sin(math.radians(lat))
        east, north = math.cos(math.radians(lat)) / math.sqrt(1 - e2 * s * s), (1 - e2) / (1 - e2 * s * s) ** 1.5
        assert math.hypot(x1 - x0, y1 - y0) / east == pytest.approx(math.hypot(x2 - x0, y2 - y0) / north, rel=1e-6)


def test_unknown_codes_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 45.0, 4326), (1.0, 45.0, 999), (None, 45.0, 2154), (1.0, 45.0, None)], "lon double, lat double, srid int")
    got = [r.p for r in df.select(projection.project(F.col("lon"), F.col("lat"), F.col("srid")).alias("p")).collect()]
    assert tuple(got[0]) == (1.0, 45.0) and got[1] is None and got[2].x is None and got[3] is None


def test_many_keys_share_a_call(spark):
    """Groups are cut out of the batches that they arrive in, whatever their borders, and no task gets a call per group."""
    calls = spark.sparkContext.accumulator(0)

    def work(found, starts):
        calls.add(1)
        ends = [*starts[1:].tolist(), found.num_rows]
        return pa.table([found.column("key").take(pa.array(starts)), pa.array([e - s for s, e in zip(starts.tolist(), ends)], pa.int64())], names=["key", "n"])

    rows = spark.range(30000).select(F.when(F.col("id") < 9000, 0).otherwise(F.col("id") % 5000 + 1).cast("string").alias("key"), "id")
    got = {r.key: r.n for r in overlay._in_groups(rows, ["key"], ["id"], work, "key string, n long").collect()}
    want = {r.key: r["count"] for r in rows.groupBy("key").count().collect()}
    assert got == want and calls.value < 100


def test_sides_that_grow_are_not_broadcast(spark):
    df = table(spark, [(str(k), [[(k, 0), (k + 2, 0), (k + 2, 2), (k, 2)]]) for k in range(40)])
    for found in (overlay.surfaces(df), overlay.unions(df)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
