"""Checks before an export of geometries, attributes of the export, and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import department_srid, fit, join_targets

# Widths of the export's text fields, and the closed list of targets.
WIDTHS = {"nom": 50, "cible": 100, "description": 254, "decision": 254, "refei": 254, "categorie": 7}
TARGETS = [
    "Population",
    "Faune et flore",
    "Habitats naturels",
    "Sites et paysages",
    "Biens matériels",
    "Continuités écologiques",
    "Equilibres biologiques",
    "Facteurs climatiques",
    "Patrimoine culturel et archéologique",
    "Sol",
    "Eau",
    "Air",
    "Bruit",
    "Espaces naturels, agricoles, forestiers, maritimes ou de loisirs",
    "Cible a preciser",
]
BLANK = "-"


def attributs(projet: DataFrame, mode: str = "complet") -> DataFrame:
    """Export attributes of each project; texts are cut to the format's widths, blanks become a dash.

    Mode ``geometrie_seule`` keeps the name alone.
    """
    cut = {k: fit(F.col(k), WIDTHS[k])["texte"] for k in ("nom", "description", "decision", "refei", "categorie")}
    cut["cible"] = join_targets(F.coalesce("cibles", F.array().cast("array<string>")))
    if mode == "geometrie_seule":
        cut = {k: v if k == "nom" else F.lit(BLANK) for k, v in cut.items()}
    return projet.select("id", F.lit("1").alias("numero"), *[v.alias(k) for k, v in cut.items()])


def controler(projet: DataFrame, categories: list[str], mode: str = "complet", strategie: str = "eclate") -> DataFrame:
    """Broken rules of each project: (id, code, level, number of findings).

    ``projet`` holds its geometries as an array of (type_geom, invalide,
    reparee).  Each rule is a count; all are taken in one pass.
    """
    full = mode != "geometrie_seule"
    geoms = F.coalesce("geoms", F.array().cast("array<struct<type_geom:string,invalide:boolean,reparee:boolean>>"))

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(c), F.lit("")) == ""

    def how_many(test) -> Column:
        return F.size(F.filter(geoms, lambda g: F.coalesce(test(g), F.lit(False))))

    def once(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("int")

    kind = lambda g: F.lower(F.coalesce(g["type_geom"], F.lit("")))
    polygons = how_many(lambda g: kind(g).isin("polygon", "multipolygon"))
    targets = F.coalesce("cibles", F.array().cast("array<string>"))
    category = F.trim(F.coalesce("categorie", F.lit("")))
    rules: list[tuple[str, str, bool, Column]] = [
        ("E01", "bloquant", True, once(polygons == 0)), ("E02", "bloquant", True, how_many(lambda g: ~kind(g).isin("polygon", "multipolygon", ""))),
        ("E03", "bloquant", True, how_many(lambda g: g["invalide"])), ("E04", "bloquant", True, once(department_srid(F.col("departement")).isNull())),
        ("E05", "bloquant", full, once(blank("nom"))), ("E06", "bloquant", full, once(category == "")), ("E07", "bloquant", full, once((category != "") & ~category.isin(*categories))),
        ("E08", "bloquant", full, once(F.size(targets) == 0)), ("E09", "bloquant", full, once(F.exists(targets, lambda c: ~c.isin(*TARGETS)))),
        ("W01", "avertissement", full, once(F.length(F.trim("nom")) > WIDTHS["nom"])), ("W02", "avertissement", full, once(F.length(F.trim("description")) > WIDTHS["description"])),
        ("W03", "avertissement", full, once(blank("decision") | blank("refei"))), ("W04", "avertissement", True, how_many(lambda g: g["reparee"])),
        ("W06", "avertissement", full, once((category != "") & (F.length(category) < 6))),
        ("W07", "avertissement", True, once(F.col("hash_verse") == F.col("hash_courant"))), ("W08", "avertissement", True, once(F.col("hash_verse") != F.col("hash_courant"))),
        ("W09", "avertissement", strategie == "eclate", once(F.col("nb_parties") > 1)),
    ]
    counted = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("niveau"), k.alias("nb")) for c, n, applies, k in rules if applies])
    return projet.select("id", F.explode(F.filter(counted, lambda r: r["nb"] > 0)).alias("r")).select("id", "r.*")


def decider(projet: DataFrame, found: DataFrame, confirmed: bool = False) -> DataFrame:
    """Errors block; an unchanged geometry must be confirmed; else the export goes on."""
    sums = found.groupBy("id").agg(F.count_if(F.col("niveau") == "bloquant").alias("nb_erreurs"), F.count_if(F.col("niveau") == "avertissement").alias("nb_avertissements"), F.max(F.col("code") == "W07").alias("inchange"))
    joined = projet.select("id").join(sums, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("nb_erreurs", "nb_avertissements")})
    again = F.coalesce("inchange", F.lit(False)) & ~F.lit(confirmed)
    return joined.withColumn("decision", F.when(F.col("nb_erreurs") > 0, "bloque").when(again, "a_confirmer").otherwise("exporter")).drop("inchange")


def parties(polygones: DataFrame, strategie: str) -> DataFrame:
    """Rows of the export: one per polygon, numbered from one, or one multipart row."""
    if strategie == "explode":
        return polygones.select("id", F.posexplode("polygones").alias("k", "polygone")).select("id", (F.col("k") + 1).alias("numero"), F.array("polygone").alias("polygones"))
    return polygones.filter(F.size("polygones") > 0).select("id", F.lit(1).alias("numero"), "polygones")
