"""Annual reports: lines with reasons, controls, reconciliation, snapshots."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.signals import OPEN_STATES


def derniers_motifs(mouvement: DataFrame) -> DataFrame:
    """Latest reason of each occurrence and field."""
    order = Window.partitionBy("occurrence_id", "champ").orderBy(F.desc("modifie_le"), F.desc("id"))
    return mouvement.filter("motif is not null").withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("occurrence_id", "champ", "motif")


def lignes(occurrence: DataFrame, mouvement: DataFrame, annee: int) -> DataFrame:
    """Lines of a year with the map of latest reasons and the gap to the initial amount."""
    reasons = derniers_motifs(mouvement).groupBy("occurrence_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("champ", "motif")))).alias("motifs"))
    rows = occurrence.filter((F.col("annee") == annee) & (F.col("statut") != "supprime")).join(reasons, F.col("id") == F.col("occurrence_id"), "left").drop("occurrence_id")
    return rows.withColumns({
        "ecart_initial": F.when(F.col("montant_initial").isNotNull(), F.coalesce("montant_ht", F.lit(0)) - F.col("montant_initial")),
        "ajoutee_apres_baseline": F.col("montant_initial").isNull(),
    })


def controles(rows: DataFrame, projets: DataFrame, baseline: DataFrame, annee: int, as_of: dt.date) -> DataFrame:
    """Points to settle before validation: (project, code, level, count, ids in question)."""
    open_ = F.col("statut").isin(*OPEN_STATES) if annee < as_of.year else F.lit(False)
    silent = (F.abs("ecart_initial") >= 1) & (F.coalesce(F.size("motifs"), F.lit(0)) <= 0)
    rules: list[tuple[str, str, Column]] = [
        ("statuts_non_soldes", "bloquant", open_), ("ecarts_sans_motif", "avertissement", F.coalesce(silent, F.lit(False))),
        ("lignes_sans_montant", "avertissement", F.col("montant_ht").isNull()), ("champs_a_confirmer", "avertissement", F.size("champs_a_confirmer") > 0),
    ]
    # One pass over the lines: each says which rules it breaks.
    broken = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(niveau).alias("niveau"))) for code, niveau, cond in rules]))
    found = rows.select("projet_id", "id", F.explode(broken).alias("r")).groupBy("projet_id", "r.code", "r.niveau").agg(
        F.count("*").alias("nb"), F.array_sort(F.collect_list("id")).alias("occurrences"))
    absent = projets.select(F.col("id").alias("projet_id")).join(baseline.select("projet_id"), "projet_id", "left_anti").select(
        "projet_id", F.lit("baseline_absente").alias("code"), F.lit("bloquant").alias("niveau"), F.lit(0).cast("bigint").alias("nb"), F.array().cast("array<bigint>").alias("occurrences"))
    return found.unionByName(absent)


def dernier_rapport_valide(rapport: DataFrame) -> DataFrame:
    order = Window.partitionBy("projet_id", "annee").orderBy(F.desc("version"))
    return rapport.filter("statut = 'valide'").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def raccordement(rapport: DataFrame, delta: DataFrame, annee: int) -> DataFrame:
    """Totals that last year's validated report archived, against today's sums of that year."""
    before = dernier_rapport_valide(rapport).filter(F.col("annee") == annee - 1).select(
        "projet_id", F.col("id").alias("bilan_precedent_id"), F.col("version").alias("bilan_precedent_version"), "archive_prevu")
    now = delta.filter(F.col("annee") == annee - 1).select("projet_id", "prevu")
    gap = F.round(F.coalesce("prevu", F.lit(0)) - F.coalesce("archive_prevu", F.lit(0)), 2)
    return before.join(now, "projet_id", "left").withColumn("ecart_prevu", gap).withColumn("corrections_posterieures", F.abs("ecart_prevu") >= 1).drop("prevu")


def journal(mouvement: DataFrame, occurrence: DataFrame, annee: int) -> DataFrame:
    """Events recorded during a calendar year, with the occurrence they touch."""
    within = (F.col("modifie_le") >= F.lit(dt.datetime(annee, 1, 1)).cast("timestamp_ntz")) & (F.col("modifie_le") < F.lit(dt.datetime(annee + 1, 1, 1)).cast("timestamp_ntz"))
    where = occurrence.select(F.col("id").alias("occurrence_id"), F.col("code").alias("occurrence_code"), F.col("titre").alias("occurrence_titre"), F.col("annee").alias("occurrence_annee"))
    return mouvement.filter(within).join(where, "occurrence_id")


def derniere_baseline(baseline: DataFrame) -> DataFrame:
    """Latest freeze of each project."""
    last = F.max_by(F.struct("id", "figee_le", "libelle", "total_ht"), F.struct("figee_le", "id"))
    return baseline.groupBy("projet_id").agg(last.alias("b")).select("projet_id", "b.*")


def bilan(projets: DataFrame, delta: DataFrame, ecarts: DataFrame, lines: DataFrame, checks: DataFrame, baseline: DataFrame, annee: int) -> DataFrame:
    """One snapshot per project: every part is reduced to a row per project, then joined."""
    def nested(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy("projet_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    now = delta.filter(F.col("annee") == annee).select("projet_id", F.struct("initial", "prevu", "engage", "realise").alias("synthese"))
    gaps = ecarts.filter(F.col("annee_ref") == annee).select("projet_id", F.struct("annule", "glisse_sortant", "ajoute", "revision_prix").alias("ecarts"))
    parts = [
        now, gaps, nested(delta, "pluriannuel", "annee", "initial", "prevu", "engage", "realise"), nested(lines, "lignes", "code", "titre", "id", "montant_ht", "ecart_initial"),
        nested(checks, "controles", "niveau", "code", "nb"), derniere_baseline(baseline).select("projet_id", F.struct("id", "figee_le", "libelle").alias("baseline")),
    ]
    joined = reduce(lambda a, b: a.join(b, "projet_id", "left"), parts, projets.select(F.col("id").alias("projet_id")))
    return joined.withColumn("annee", F.lit(annee))


def valider(rapport: DataFrame, checks: DataFrame, force: bool, now: dt.datetime) -> DataFrame:
    """Validate drafts: refused while a blocking point stands, unless forced (then the points stay recorded)."""
    blocking = checks.filter("niveau = 'bloquant'").groupBy("projet_id").agg(F.count("*").alias("nb_bloquants"))
    joined = rapport.join(blocking, "projet_id", "left").withColumn("nb_bloquants", F.coalesce("nb_bloquants", F.lit(0)))
    ready = (F.col("statut") == "brouillon") & ((F.col("nb_bloquants") == 0) | F.lit(force))
    return joined.withColumns({
        "valide_le": F.when(ready, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("valide_le")),
        "decision": F.when(ready, "valide").when(F.col("statut") == "brouillon", "refuse").otherwise("inchange"),
        "statut": F.when(ready, "valide").otherwise(F.col("statut")),
    })
