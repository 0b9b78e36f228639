"""Contractors: where they work, typeahead, match-or-create, guarded removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import normalize_siret
from ledgerloom.operators.budget import total


def par_projet(occurrence: DataFrame, projet_prestataire: DataFrame, prestataire: DataFrame) -> DataFrame:
    """Contractors of each project, from its occurrences or its list, with counts and sums."""
    on = F.col("statut") != "supprime"
    worked = occurrence.filter("prestataire_id is not null").groupBy("projet_id", "prestataire_id").agg(
        F.count_if(on).alias("nb_occurrences"), F.count_if(F.col("statut") == "realise").alias("nb_realisees"),
        *[total(m, on).alias(n) for m, n in (("montant_ht", "total_prevu_ht"), ("montant_engage", "total_engage_ht"), ("montant_realise", "total_realise_ht"))],
        F.min(F.when(on, F.col("annee"))).alias("annee_min"), F.max(F.when(on, F.col("annee"))).alias("annee_max"), F.lit(True).alias("a_travaille"),
    )
    listed = projet_prestataire.withColumn("liste", F.lit(True))
    both = worked.join(listed, ["projet_id", "prestataire_id"], "full")
    source = F.when(F.col("a_travaille") & F.col("liste"), "les_deux").when(F.col("a_travaille"), "occurrence").otherwise("projet")
    firms = prestataire.select(F.col("id").alias("prestataire_id"), F.col("nom").alias("prestataire_nom"), "siret_norm", "actif")
    zeros = ["nb_occurrences", "nb_realisees", "total_prevu_ht", "total_engage_ht", "total_realise_ht"]
    return both.join(firms, "prestataire_id").withColumn("source", source).withColumns({z: F.coalesce(z, F.lit(0)) for z in zeros}).drop("a_travaille", "liste")


def rechercher(prestataire: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Typeahead on name, raw and normalised number; names that start with the text first."""
    digits = "".join(c for c in q if c.isdigit())
    hit = F.ilike("nom", F.lit(f"%{q}%")) | F.ilike(F.coalesce("siret", F.lit("")), F.lit(f"%{q}%"))
    if digits:
        hit = hit | F.coalesce("siret_norm", F.lit("")).contains(digits)
    leads = F.when(F.lower("nom").startswith(q.lower()), 0).otherwise(1)
    return prestataire.filter(hit).orderBy(leads, "nom", "id").limit(limit)


def rattacher(prestataire: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known contractors with blanks filled from incoming rows of the same number, and new ones added.

    ``incoming`` (nom, siret) is reduced to one row per number first.
    """
    new = incoming.withColumn("siret_norm", normalize_siret(F.col("siret"))).filter("siret_norm is not null")
    new = new.groupBy("siret_norm").agg(F.min_by("nom", "ordre").alias("n_nom"), F.min_by("siret", "ordre").alias("n_siret"))
    joined = prestataire.join(new, "siret_norm", "left")
    kept = joined.select("id", F.coalesce(F.nullif("n_nom", F.lit("")), "nom").alias("nom"), F.coalesce(F.nullif("n_siret", F.lit("")), "siret").alias("siret"), "siret_norm", F.lit(False).alias("cree"))
    created = new.join(prestataire.select("siret_norm"), "siret_norm", "left_anti").select(
        F.lit(None).cast(prestataire.schema["id"].dataType).alias("id"), F.col("n_nom").alias("nom"), F.col("n_siret").alias("siret"), "siret_norm", F.lit(True).alias("cree"))
    return kept.unionByName(created)


def lier(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Project links with the missing ones added."""
    keys = ["projet_id", "prestataire_id"]
    return links.unionByName(wanted.select(keys).distinct().join(links, keys, "left_anti"), allowMissingColumns=True)


def detacher(links: DataFrame, unwanted: DataFrame, occurrence: DataFrame) -> DataFrame:
    """Links without the unwanted ones, unless an active occurrence still uses them."""
    keys = ["projet_id", "prestataire_id"]
    used = occurrence.filter("statut <> 'supprime' and prestataire_id is not null").select(keys)
    return links.join(unwanted.join(used, keys, "left_anti"), keys, "left_anti")
