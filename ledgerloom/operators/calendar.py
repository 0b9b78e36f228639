"""Recurring rules expanded into dated occurrences, and lists of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import deadline, display_code, effective_end_year, first_theme


def paliers_annees(anchor: Column, tiers: Column, horizon: Column) -> Column:
    """Years of a tiered cadence: the anchor, then each tier from the last year on; none beyond the horizon.

    Without tiers there are no years, even with an anchor.
    """
    def step(tier: Column) -> Column:
        return F.greatest(F.bround(tier["intervalle_ans"].cast("double")).cast("int"), F.lit(1))

    steps = F.flatten(F.transform(tiers, lambda p: F.array_repeat(step(p), p["nombre_occurrences"])))
    years = F.aggregate(steps, F.array(anchor), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    return F.when(F.size(tiers) > 0, F.filter(years, lambda y: y <= horizon))


def annees(rule: DataFrame, horizon: int) -> Column:
    """Years in which a rule falls due, by its type; an empty array if it cannot be placed."""
    anchor, end = F.col("ancrage_annee"), F.lit(horizon)
    step = F.greatest(F.bround(F.coalesce("intervalle_ans", F.lit(1.0))).cast("int"), F.lit(1))
    campaign_end = F.least(anchor + F.greatest(F.coalesce("duree_ans", F.lit(1)), F.lit(1)) - 1, end)
    years = (
        F.when(F.col("type").isin("ponctuel", "dependant_evenement"), F.when(anchor <= end, F.array(anchor)))
        .when(F.col("type") == "periodique", F.when(anchor <= end, F.sequence(anchor, end, step)))
        .when(F.col("type") == "campagnes", F.when(anchor <= campaign_end, F.sequence(anchor, campaign_end)))
        .when(F.col("type") == "paliers", paliers_annees(anchor, F.col("paliers"), end))
    )
    return F.when(anchor.isNotNull(), F.coalesce(years, F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))


def horizon_suggere(rule: DataFrame, as_of: dt.date) -> DataFrame:
    """Last year to plan for: today, the last anchor, or the first anchor plus the longest duration."""
    return rule.agg(
        F.greatest(F.lit(as_of.year), F.max("ancrage_annee"), F.min("ancrage_annee") + F.max("duree_ans") - 1).alias("annee_fin"),
    )


def generer_occurrences(rule: DataFrame, horizon: int, year_now: int) -> DataFrame:
    """One row per rule and year, with its first state and title."""
    placed = rule.withColumn("annee", F.explode(annees(rule, horizon)))
    times = F.when((F.col("type") == "campagnes") & (F.col("occurrences_par_an") > 0), F.concat(F.lit(" (×"), F.col("occurrences_par_an").cast("string"), F.lit("/an)"))).otherwise("")
    guessed = F.array_contains("champs_a_confirmer", "ancrage_annee")
    state = F.when(guessed | (F.col("annee") < year_now), "a_confirmer").otherwise("planifie")
    return placed.select(
        F.col("id").alias("echeance_id"), "projet_id", "annee", display_code(F.upper(F.replace("code_operation", F.lit(" "), F.lit("")))).alias("code"),
        F.concat("libelle", times).alias("titre"), state.alias("statut"),
    )


def non_placables(rule: DataFrame, horizon: int) -> DataFrame:
    return rule.filter(F.size(annees(rule, horizon)) == 0)


def a_revoir() -> Column:
    """Rows with low confidence, open questions or warnings."""
    return (F.coalesce("confiance", F.lit(0.0)) < 0.7) | (F.size("champs_a_confirmer") > 0)


def calendrier(occurrence: DataFrame, rule: DataFrame, fiche: DataFrame, prestataire: DataFrame) -> DataFrame:
    """Occurrences with their rule, action sheet and contractor; the theme by precedence."""
    rules = rule.select(F.col("id").alias("echeance_id"), F.col("cle").alias("echeance_cle"), F.col("libelle").alias("echeance_libelle"), "action_cle", F.col("type").alias("recurrence"))
    sheets = fiche.select(F.col("cle").alias("action_cle"), F.col("titre").alias("action_titre"), F.col("lib_thema").alias("theme_action"))
    firms = prestataire.select(F.col("id").alias("prestataire_id"), F.col("nom").alias("prestataire_nom"))
    joined = occurrence.join(rules, "echeance_id", "left").join(sheets, "action_cle", "left").join(firms, "prestataire_id", "left")
    return joined.withColumn("theme", first_theme(F.col("lib_thema"), F.col("theme_action")))


def filtrer_calendrier(rows: DataFrame, annee: int | None = None, ug_id: str | None = None, inclure_supprimees: bool = False) -> DataFrame:
    if not inclure_supprimees:
        rows = rows.filter("statut <> 'supprime'")
    if annee is not None:
        rows = rows.filter(F.col("annee") == annee)
    if ug_id is not None:
        rows = rows.filter(F.array_contains("ug_ids", ug_id))
    return rows


def prochaine_occurrence(occurrence: DataFrame, as_of: dt.date) -> DataFrame:
    """Each project's next open deadline; ties by code, then id."""
    due = occurrence.filter(~F.col("statut").isin("realise", "supprime")).select(
        "projet_id", "id", "code", "titre", deadline(F.col("annee"), F.col("mois_debut"), F.col("mois_fin")).alias("deadline"),
        F.coalesce("mois_fin", "mois_debut", F.lit(12)).alias("mois_fin_eff"), effective_end_year(F.col("annee"), F.col("mois_debut"), F.col("mois_fin")).alias("annee_fin"),
    ).filter(F.col("deadline") >= F.lit(as_of))
    order = Window.partitionBy("projet_id").orderBy("deadline", "code", "id")
    return due.withColumn("_rang", F.row_number().over(order)).filter("_rang = 1").drop("_rang")


def resume_projets(projet: DataFrame, occurrence: DataFrame, as_of: dt.date) -> DataFrame:
    """Project list with counts and the next deadline, as one plan."""
    counts = occurrence.groupBy("projet_id").agg(
        F.count_if(F.col("statut") != "supprime").alias("nb_occurrences"), F.count_if(F.col("statut") == "realise").alias("nb_realisees"),
    )
    following = prochaine_occurrence(occurrence, as_of).select(
        "projet_id", F.col("code").alias("prochaine_code"), F.col("titre").alias("prochaine_titre"), F.col("deadline").alias("prochaine_deadline"),
        F.datediff("deadline", F.lit(as_of)).alias("prochaine_jours_restants"), F.col("mois_fin_eff").alias("prochaine_mois_fin"), F.col("annee_fin").alias("prochaine_annee_fin"),
    )
    joined = projet.withColumnRenamed("id", "projet_id").join(counts, "projet_id", "left").join(following, "projet_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("nb_occurrences", "nb_realisees")}).withColumn("dette_m2", F.lit(0))
