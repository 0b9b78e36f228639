"""Request threads: previews, state machine, queue and activity feed."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import age_in_days, preview

FEED = ["projet_id", "survenu_le", "type", "acteur", "libelle", "demande_id"]


def dernier_message(message: DataFrame) -> DataFrame:
    """Count, last body, actor and time of each thread, in one aggregate."""
    last = F.max_by(F.struct("corps", "acteur", "cree_le"), F.struct("cree_le", "id"))
    return message.groupBy("demande_id").agg(F.count("*").alias("nb_messages"), last.alias("dernier")).select(
        "demande_id", "nb_messages", F.col("dernier.corps").alias("dernier_corps"), F.col("dernier.acteur").alias("dernier_acteur"), F.col("dernier.cree_le").alias("dernier_message_le"),
    )


def lister_demandes(demande: DataFrame, message: DataFrame, occurrence: DataFrame) -> DataFrame:
    """Threads with a preview of the last message; closed ones at the end."""
    where = occurrence.select(F.col("id").alias("occurrence_id"), F.col("code").alias("occurrence_code"), F.col("annee").alias("occurrence_annee"))
    joined = demande.join(dernier_message(message), demande["id"] == F.col("demande_id"), "left").drop("demande_id").join(where, "occurrence_id", "left")
    return joined.withColumn("nb_messages", F.coalesce("nb_messages", F.lit(0))).orderBy(F.asc(F.col("statut") == "close"), F.desc("maj_le"), "id")


def file_de_relance(demande: DataFrame, projet: DataFrame, organisation: DataFrame, as_of: dt.date, statut: str | None = None, limite: int = 200) -> DataFrame:
    """All threads of the portfolio, open and oldest ones first."""
    wanted = F.lit(True) if statut in (None, "toutes") else F.col("statut") == statut
    owner = projet.select(F.col("id").alias("projet_id"), F.col("nom").alias("projet_nom"), "organisation_id")
    org = organisation.select(F.col("id").alias("organisation_id"), F.col("nom").alias("organisation_nom"))
    now = F.lit(as_of).cast("timestamp_ntz")
    joined = demande.filter(wanted).join(owner, "projet_id").join(org, "organisation_id").withColumn("jours_sans_reponse", age_in_days(F.col("maj_le"), now))
    return joined.orderBy(F.desc(F.col("statut") == "ouverte"), "maj_le", "id").limit(max(1, min(limite, 1000)))


def etat_par_messages(demande: DataFrame, message: DataFrame) -> DataFrame:
    """State of each thread after all of its messages: the other side's makes it answered."""
    last = message.groupBy("demande_id").agg(F.max_by("acteur", F.struct("cree_le", "id")).alias("dernier"))
    joined = demande.join(last, demande["id"] == last["demande_id"], "left").drop("demande_id")
    state = F.when(F.col("statut") == "close", "close").when(F.col("dernier").isNull(), F.col("statut")).when(F.col("dernier") == F.col("auteur"), "ouverte").otherwise("repondue")
    return joined.withColumn("statut", state).drop("dernier")


def clore(demande: DataFrame, ids: list[int], statut: str, now: dt.datetime) -> DataFrame:
    """Close or reopen threads; reopening clears the date."""
    hit = F.col("id").isin(ids)
    return demande.withColumn("clos_le", F.when(hit, F.lit(now if statut == "close" else None).cast("timestamp_ntz")).otherwise(F.col("clos_le"))).withColumn(
        "statut", F.when(hit, F.lit(statut)).otherwise(F.col("statut")),
    )


def _fact(rows: DataFrame, when: str, kind: str, actor: Column, text: Column, thread: Column) -> DataFrame:
    return rows.select("projet_id", F.col(when).alias("survenu_le"), F.lit(kind).alias("type"), actor.alias("acteur"), text.alias("libelle"), thread.alias("demande_id"))


def activite(demande: DataFrame, message: DataFrame, rapport: DataFrame, baseline: DataFrame) -> DataFrame:
    """Feed of all facts of a project, derived from what is stored."""
    none = F.lit(None).cast("bigint")
    spoken = message.join(demande.select(F.col("id").alias("demande_id"), "projet_id"), "demande_id")
    opened = F.when(F.col("auteur") == "dreal", "Demande du service instructeur").otherwise("Signalement du bureau d'études")
    said = F.when(F.col("acteur") == "dreal", "Message du service instructeur").otherwise("Réponse du bureau d'études")
    parts = [
        _fact(demande, "cree_le", "demande_ouverte", F.col("auteur"), F.concat(opened, F.lit(" : "), "objet"), F.col("id")),
        _fact(spoken, "cree_le", "message", F.col("acteur"), F.concat(said, F.lit(" : "), preview(F.col("corps"))), F.col("demande_id")),
        _fact(demande.filter("clos_le is not null"), "clos_le", "demande_close", F.lit("dreal"), F.concat(F.lit("Demande close : "), "objet"), F.col("id")),
        _fact(rapport.filter("statut = 'valide' and valide_le is not null"), "valide_le", "bilan_valide", F.lit("be"),
              F.concat(F.lit("Bilan financier "), F.col("annee").cast("string"), F.lit(" validé (version "), F.col("version").cast("string"), F.lit(")")), none),
        _fact(baseline, "figee_le", "baseline_figee", F.lit("be"), F.concat(F.lit("Budget de référence figé : "), "libelle"), none),
    ]
    return reduce(DataFrame.unionByName, parts)


def ouvrir(demande: DataFrame, message: DataFrame, nouvelles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open threads, each with its first message: (threads, messages).

    ``nouvelles`` (id, projet_id, occurrence_id, auteur, objet, corps, cree_le):
    one row a thread, whose id the caller gives.  The first message bears the
    thread's author and time, so both tables follow from the same rows.
    """
    threads = nouvelles.drop("corps").withColumns({"statut": F.lit("ouverte"), "maj_le": F.col("cree_le")})
    first = nouvelles.select(F.col("id").alias("demande_id"), F.col("auteur").alias("acteur"), "corps", "cree_le")
    return demande.unionByName(threads, allowMissingColumns=True), message.unionByName(first, allowMissingColumns=True)
