"""Planar geometry as column expressions over arrays of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0


def mercator_to_lonlat(points: Column) -> Column:
    """Web Mercator metres to degrees, in closed form."""
    def turn(p: Column) -> Column:
        lat = F.atan(F.exp(p["y"] / EARTH_RADIUS)) * 2 - math.pi / 2
        return F.struct((p["x"] / EARTH_RADIUS * (180 / math.pi)).alias("lon"), (lat * (180 / math.pi)).alias("lat"))

    return F.transform(points, turn)


def ring_area(points: Column) -> Column:
    """Area of a ring by the shoelace formula, closed if it is not."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    crossed = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(points) >= 3, F.abs(F.aggregate(crossed, F.lit(0.0), lambda total, x: total + x)) / 2).otherwise(F.lit(0.0))


def surface_ha(rings: Column) -> Column:
    """Hectares of a list of rings in metres, to four decimals."""
    return F.round(F.aggregate(F.transform(rings, ring_area), F.lit(0.0), lambda total, x: total + x) / 10000, 4)


def geometry_hash(rings: Column) -> Column:
    """Digest of the sorted rings, so that their order doesn't matter."""
    return F.md5(F.concat_ws(";", F.array_sort(F.transform(rings, lambda ring: F.to_json(ring)))))


def kind_of(geometry_type: Column, footprint: Column) -> Column:
    """Layer of a geometry, by its type."""
    kind = F.when(geometry_type.contains("Polygon"), "surf").when(geometry_type.contains("Line"), "lin").when(geometry_type.contains("Point"), "pct")
    return F.when(footprint, "emprise").otherwise(kind)


def feature(rows: DataFrame) -> DataFrame:
    """GeoJSON-like features: type, geometry and public properties."""
    public = F.map_filter("properties", lambda k, v: ~k.startswith("_"))
    return rows.select("id", F.struct(F.lit("Feature").alias("type"), F.struct("geometry_type", "points").alias("geometry"), public.alias("properties")).alias("feature"))


def projets_par_departement(projet: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """Distinct projects that have a geometry in any layer, by department."""
    keys = layers[0].select("projet_id")
    for layer in layers[1:]:
        keys = keys.union(layer.select("projet_id"))
    return projet.join(keys, projet["id"] == keys["projet_id"], "left_semi").groupBy("departement").agg(F.countDistinct("id").alias("nb_projets"))


def resume_ug(layers: DataFrame) -> DataFrame:
    """Distinct units with the layers they appear in and their first label."""
    return layers.groupBy("ug_id").agg(F.min_by("libelle", "ordre").alias("libelle"), F.array_join(F.array_sort(F.collect_set("couche")), ",").alias("couches"), F.count("*").alias("nb"))


def apparier(geometries: DataFrame, units: DataFrame) -> DataFrame:
    """Pair the n-th geometry of a project with its n-th unit (both in order)."""
    from pyspark.sql import Window

    g = geometries.withColumn("n", F.row_number().over(Window.partitionBy("projet_id").orderBy("geom_id")))
    u = units.withColumn("n", F.row_number().over(Window.partitionBy("projet_id").orderBy("ug_id")))
    return g.join(u, ["projet_id", "n"]).select("projet_id", "n", "geom_id", "ug_id")


def wkt_to_multi(wkt: Column) -> Column:
    """Well-known text as its multi form in two dimensions; null where it is no geometry.

    ``POINT Z (1 2 3)`` becomes ``MULTIPOINT ((1 2))``; what is multi already
    keeps its parts.
    """
    number = r"-?[0-9][0-9.eE+-]*"
    shape = r"(?is)^\s*((?:MULTI)?(?:POINT|LINESTRING|POLYGON))\s*(?:ZM?|M)?\s*(EMPTY|\(.*\))\s*$"
    kind, body = F.upper(F.regexp_extract(wkt, shape, 1)), F.regexp_extract(wkt, shape, 2)
    flat = F.regexp_replace(F.regexp_replace(body, rf"({number}\s+{number})(?:\s+{number})+", "$1"), r"\s+", " ")
    parts = F.when(F.upper(body) == "EMPTY", "EMPTY").when(kind.startswith("MULTI"), flat).otherwise(F.concat(F.lit("("), flat, F.lit(")")))
    return F.when(kind != "", F.concat(F.when(kind.startswith("MULTI"), kind).otherwise(F.concat(F.lit("MULTI"), kind)), F.lit(" "), parts))


def resume_attributs(features: DataFrame) -> DataFrame:
    """Per layer: number of features, and the attributes of the first one without those that are null or not a number."""
    rows = features.groupBy("couche").agg(F.count("*").alias("nb"), F.min_by("attributs", "ordre").alias("premier"))
    return rows.withColumn("premier", F.map_filter("premier", lambda k, v: v.isNotNull() & ~F.lower(v).isin("nan", "")))
