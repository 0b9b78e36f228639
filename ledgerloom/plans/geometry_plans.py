"""Queries on repaired and united geometries, local projections and their files, with their oracles.

The shapes are made from the driver's tables such that their areas, parts and
outlines have a closed form, which the oracles state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import overlay, projection
from ledgerloom.plans.oracles import SQL_VIEWS
from ledgerloom.plans.report_plans import simple
from ledgerloom.sources.domain import Domain


def ring(*corners: tuple[str, str], names: tuple[str, str] = ("x", "y")) -> str:
    """SQL of a ring with corners given as SQL expressions."""
    return "array(" + ", ".join(f"named_struct('{names[0]}', CAST({x} AS DOUBLE), '{names[1]}', CAST({y} AS DOUBLE))" for x, y in corners) + ")"


def box(x: str, y: str, w: str, h: str, names: tuple[str, str] = ("x", "y")) -> str:
    return ring((x, y), (f"{x} + {w}", y), (f"{x} + {w}", f"{y} + {h}"), (x, f"{y} + {h}"), names=names)


# Rectangles of whole units, and for every fifth order a bow-tie over one unit: it encloses the west and east quarter of it.
SQL_VIEWS["v_formes"] = """SELECT o_custkey AS client, o_orderkey % 5 = 0 AS noeud, CAST(o_orderkey % 13 AS INTEGER) AS x, CAST(o_orderkey // 13 % 11 AS INTEGER) AS y,
    CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 4 + 1 END AS INTEGER) AS w, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 3 + 1 END AS INTEGER) AS h FROM orders"""


def _shapes(d: Domain) -> DataFrame:
    rows = d.raw("orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.expr("o_orderkey % 13").alias("x"), F.expr("o_orderkey div 13 % 11").alias("y"), F.expr("o_orderkey % 4 + 1").alias("w"), F.expr("o_orderkey % 3 + 1").alias("h"))
    knot = ring(("x", "y"), ("x + 1", "y + 1"), ("x + 1", "y"), ("x", "y + 1"))
    return rows.select("key", F.expr(f"array(CASE WHEN o_orderkey % 5 = 0 THEN {knot} ELSE {box('x', 'y', 'w', 'h')} END)").alias("rings"))


simple("g03_surface_des_unions", """SELECT CAST(client AS VARCHAR) AS key, round(count(DISTINCT (cx, cy, q)) * 0.25::DOUBLE, 6) AS surface FROM (
    SELECT client, cx, unnest(range(y, y + h)) AS cy, q FROM (SELECT client, y, h, unnest(range(x, x + w)) AS cx, q FROM (
        SELECT *, unnest(CASE WHEN noeud THEN ['O', 'E'] ELSE ['N', 'E', 'S', 'O'] END) AS q FROM v_formes))) GROUP BY client""",
       lambda d: overlay.surfaces(_shapes(d)).withColumn("surface", F.round("surface", 6)))

# Frames of four overlapping bars around a hole, up to three side by side.
SQL_VIEWS["v_cadres"] = "SELECT c_custkey AS client, CAST(j AS INTEGER) AS j FROM (SELECT c_custkey, unnest(range(0, c_custkey % 4)) AS j FROM customer)"


def _frames(d: Domain) -> DataFrame:
    at = "10 * j"
    bars = ", ".join(f"array({box(x, y, w, h)})" for x, y, w, h in ((at, "0", "4", "1"), (at, "3", "4", "1"), (at, "0", "1", "4"), (f"{at} + 3", "0", "1", "4")))
    rows = d.raw("customer").select(F.col("c_custkey").alias("key"), F.expr("explode_outer(CASE WHEN c_custkey % 4 > 0 THEN sequence(0, CAST(c_custkey % 4 AS INT) - 1) END)").alias("j"))
    return rows.select("key", F.explode(F.expr(f"CASE WHEN j IS NULL THEN array(CAST(NULL AS array<array<struct<x:double,y:double>>>)) ELSE array({bars}) END")).alias("rings"))


def _point(x: str, y: str) -> str:
    return f"({x}) || '.0 {y}.0'"


_OUTER = " || ', ' || ".join(_point(*p) for p in (("10 * j", "0"), ("10 * j + 4", "0"), ("10 * j + 4", "4"), ("10 * j", "4"), ("10 * j", "0")))
_INNER = " || ', ' || ".join(_point(*p) for p in (("10 * j + 1", "1"), ("10 * j + 1", "3"), ("10 * j + 3", "3"), ("10 * j + 3", "1"), ("10 * j + 1", "1")))
simple("g03_unions", f"""SELECT CAST(c_custkey AS VARCHAR) AS key, coalesce(wkt, 'MULTIPOLYGON EMPTY') AS wkt, CAST(c_custkey % 4 AS INTEGER) AS nb_parties, CAST(c_custkey % 4 AS INTEGER) AS nb_trous FROM customer LEFT JOIN (
    SELECT client, 'MULTIPOLYGON (' || string_agg('((' || {_OUTER} || '), (' || {_INNER} || '))', ', ' ORDER BY j) || ')' AS wkt FROM v_cadres GROUP BY client) ON client = c_custkey""",
       lambda d: overlay.unions(_frames(d), digits=1).drop("empreinte"))

# One polygon each: a rectangle, one with a hole, a bow-tie, a ring that runs twice around, none.
_ONE = {0: ("w * h", "true"), 1: ("w * h - 1", "true"), 2: ("w * h / 2", "false"), 3: ("0", "false"), 4: ("0", "NULL")}
_SIDES = "c_custkey % 9 + 3 AS w, c_custkey % 7 + 3 AS h"


def _repaired(d: Domain) -> DataFrame:
    corners = (("0", "0"), ("w", "0"), ("w", "h"), ("0", "h"))
    shapes = (
        f"array({ring(*corners)})", f"array({ring(*corners)}, {box('1', '1', '1', '1')})", f"array({ring(corners[0], corners[2], corners[1], corners[3])})", f"array({ring(*corners, *corners)})",
    )
    rows = d.raw("customer").selectExpr("c_custkey AS key", *_SIDES.split(", ")).withColumn("rings", F.expr("CASE key % 5 " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(shapes)) + " END"))
    return rows.join(overlay.surfaces(rows).withColumn("key", F.col("key").cast("long")).hint("merge"), "key").select(
        "key", F.round("surface", 6).alias("surface"), overlay.was_valid(F.col("rings"), F.col("surface")).alias("valide"))


simple("g03_reparation", f"""SELECT c_custkey AS key, round(CAST(CASE c_custkey % 5 {' '.join(f'WHEN {k} THEN {a}' for k, (a, _) in _ONE.items())} END AS DOUBLE), 6) AS surface,
    CASE c_custkey % 5 {' '.join(f'WHEN {k} THEN {v}' for k, (_, v) in _ONE.items())} END AS valide FROM (SELECT c_custkey, {_SIDES} FROM customer)""", _repaired)

# Points of each territory, in degrees, and their code.
SRIDS = [2154, 2975, 5490, 4471, 3857]
_WEST = "element_at(array(-1.0D, 55.2D, -61.9D, 44.9D, -54.0D), CAST(c_custkey % 5 AS INT) + 1) + c_custkey % 101 / 100.0D"
_SOUTH = "element_at(array(43.0D, -21.4D, 15.8D, -13.0D, 2.5D), CAST(c_custkey % 5 AS INT) + 1) + c_custkey % 89 / 100.0D"
SQL_VIEWS["v_points"] = f"""SELECT c_custkey AS id, ({SRIDS})[c_custkey % 5 + 1] AS srid, [-1.0::DOUBLE, 55.2, -61.9, 44.9, -54.0][c_custkey % 5 + 1] + c_custkey % 101 / 100.0::DOUBLE AS lon,
    [43.0::DOUBLE, -21.4, 15.8, -13.0, 2.5][c_custkey % 5 + 1] + c_custkey % 89 / 100.0::DOUBLE AS lat FROM customer"""


def _points(d: Domain) -> DataFrame:
    srid = F.element_at(F.array(*map(F.lit, SRIDS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return d.raw("customer").select(F.col("c_custkey").alias("id"), srid.alias("srid"), F.expr(_WEST).alias("lon"), F.expr(_SOUTH).alias("lat"))


def plane_sql(lon: str, lat: str, srid: str = "srid") -> tuple[str, str]:
    """DuckDB SQL of a point's x and y, in the textbooks' form of the conic and of the transverse series."""
    xs, ys = [], []
    phi = f"radians({lat})"
    for code in SRIDS:
        p = projection.PROJECTIONS[code]
        if isinstance(p, projection.LambertConic):
            e = p.ellipsoid.e
            t = f"(tan(pi() / 4 - {phi} / 2) / pow((1 - {e!r} * sin({phi})) / (1 + {e!r} * sin({phi})), {e / 2!r}))"
            rho, theta = f"({p.constant!r} * pow({t}, {p.exponent!r}))", f"({p.exponent!r} * radians({lon} - {p.lon0!r}))"
            x, y = f"{p.x0!r} + {rho} * sin({theta})", f"{p.y0!r} + {p.radius0!r} - {rho} * cos({theta})"
        elif isinstance(p, projection.TransverseMercator):
            e, away = p.ellipsoid.e, f"radians({lon} - {p.lon0!r})"
            t = f"sinh(asinh(tan({phi})) - {e!r} * atanh({e!r} * sin({phi})))"
            xi, eta = f"atan2({t}, cos({away}))", f"atanh(sin({away}) / sqrt(1 + {t} * {t}))"
            terms = list(enumerate(p.to_plane(), 1))
            x = f"{p.x0!r} + {p.radius!r} * ({eta} + " + " + ".join(f"{a!r} * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, a in terms) + ")"
            y = f"{p.y0 - p.northing0!r} + {p.radius!r} * ({xi} + " + " + ".join(f"{a!r} * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, a in terms) + ")"
        else:
            x, y = f"{p.radius!r} * radians({lon})", f"{p.radius!r} * ln(tan(pi() / 4 + {phi} / 2))"
        xs.append(f"WHEN {code} THEN {x}")
        ys.append(f"WHEN {code} THEN {y}")
    return f"CASE {srid} {' '.join(xs)} END", f"CASE {srid} {' '.join(ys)} END"


def _projected(d: Domain) -> DataFrame:
    rows = _points(d).withColumn("p", projection.project(F.col("lon"), F.col("lat"), F.col("srid")))
    rows = rows.withColumn("q", projection.unproject(F.col("p.x"), F.col("p.y"), F.col("srid")))
    # A millimetre is at most 1e-8 degrees of latitude, and more of longitude.
    back = (F.abs(F.col("q.lon") - F.col("lon")) < 1e-9) & (F.abs(F.col("q.lat") - F.col("lat")) < 1e-9)
    return rows.select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), back.alias("retour"))


_X, _Y = plane_sql("lon", "lat")
simple("g04_projections", f"SELECT id, round({_X}, 3) AS x, round({_Y}, 3) AS y, true AS retour FROM v_points", _projected)


def _local_area(d: Domain) -> DataFrame:
    """Two parcels per point, one of them twice; united in the plane of the territory."""
    names = ("lon", "lat")
    parcels = F.expr(f"array(array({box('lon', 'lat', '0.01D', '0.01D', names)}), array({box('lon + 0.05D', 'lat', '0.01D', '0.02D', names)}), array({box('lon', 'lat', '0.01D', '0.01D', names)}))")
    rows = _points(d).select(F.col("id").alias("key"), "srid", F.explode(parcels).alias("r"))
    return overlay.surfaces(rows.select("key", projection.project_rings(F.col("r"), F.col("srid")).alias("rings")), grid=1e-6).select(
        F.col("key").cast("long").alias("id"), F.round(F.col("surface") / 10000, 2).alias("surface_ha"))


def _crossed() -> str:
    corners = [("lon", "lat"), ("lon + w", "lat"), ("lon + w", "lat + h"), ("lon", "lat + h")]
    points = [plane_sql(*c) for c in corners]
    columns = ", ".join(f"{x} AS x{k}, {y} AS y{k}" for k, (x, y) in enumerate(points))
    area = " + ".join(f"(x{k} - x0) * (y{(k + 1) % 4} - y0) - (x{(k + 1) % 4} - x0) * (y{k} - y0)" for k in range(4))
    return f"""SELECT id, round(sum(abs({area}) / 2) / 10000, 2) AS surface_ha FROM (SELECT id, {columns} FROM (
        SELECT id, srid, lon + dx AS lon, lat, 0.01::DOUBLE AS w, h FROM v_points, (VALUES (0.0::DOUBLE, 0.01::DOUBLE), (0.05, 0.02)) t(dx, h))) GROUP BY id"""


simple("g04_surface_locale", _crossed(), _local_area)


def united_hash(polygons: DataFrame) -> DataFrame:
    """Digest of each key's united geometry (G4): equal for every cut and order of the same surface."""
    return overlay.unions(polygons).select("key", "empreinte")


def _cuts(d: Domain) -> DataFrame:
    """The same rectangle whole, in halves that overlap, and with points along its sides."""
    def one(text: str) -> Column:
        return F.expr(f"array({text})")

    rows = d.raw("customer").selectExpr("c_custkey", "c_custkey % 50 AS x", *_SIDES.split(", "))
    whole = rows.select(F.concat(F.lit("e"), "c_custkey").alias("key"), one(f"array({box('x', '0', 'w', 'h')})").alias("s"))
    halves = rows.select(F.concat(F.lit("m"), "c_custkey").alias("key"), one(f"array({box('x', '0', 'w / 2', 'h')}), array({box('x + w / 3', '0', 'w - w / 3', 'h')})").alias("s"))
    dotted = rows.select(F.concat(F.lit("p"), "c_custkey").alias("key"), one("array(" + ring(("x + w", "h"), ("x", "h"), ("x", "h / 2"), ("x", "0"), ("x + w / 4", "0"), ("x + w", "0")) + ")").alias("s"))
    every = whole.unionByName(halves).unionByName(dotted).select("key", F.explode("s").alias("rings"))
    hashes = united_hash(every).withColumn("id", F.substring("key", 2, 20).cast("long"))
    return hashes.groupBy("id").agg(F.count("*").alias("nb"), F.countDistinct("empreinte").alias("empreintes"))


simple("g04_empreintes", "SELECT c_custkey AS id, CAST(3 AS BIGINT) AS nb, CAST(1 AS BIGINT) AS empreintes FROM customer", _cuts)
