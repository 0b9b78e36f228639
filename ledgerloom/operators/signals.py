"""Rule-based signals on projects: each one explainable, none a score."""

# Fixed values in this module: codes of the signals and the sentences that they are shown with.

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.domain import THRESHOLDS

OPEN_STATES = ("planifie", "en_cours", "a_confirmer")
_LIMITS = dict(THRESHOLDS)


def level(critical: Column) -> Column:
    return F.when(critical, "critique").otherwise("attention")


class Signal(NamedTuple):
    """Outcome of one rule, as expressions over the sums of one project."""

    code: str
    leve: Column
    critique: Column
    libelle: Column
    valeur: Column
    detail: Column

    def columns(self) -> list[Column]:
        detail = F.to_json(self.detail, {"ignoreNullFields": "false"})
        return [F.lit(self.code).alias("code"), level(self.critique).alias("niveau"), self.libelle.alias("libelle"), self.valeur.alias("valeur"), detail.alias("detail")]


def lever(sums: DataFrame, signal: Signal) -> DataFrame:
    """The projects on which the rule raises its signal."""
    return sums.filter(signal.leve).select("projet_id", *signal.columns())


def annees_obligation(projet: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per project and calendar year that owes a report."""
    first = F.year("date_decision")
    last = F.least(F.year(F.coalesce("date_fin", F.lit(as_of))), F.lit(as_of.year - 1))
    # sequence() counts down or fails when the end lies before the start.
    years = F.when(first <= last, F.sequence(first, last))
    return projet.filter("date_decision is not null and statut <> 'archive'").select(F.col("id").alias("projet_id"), "organisation_id", F.explode(years).alias("annee"))


def regle_bilan(limits: dict[str, float] = _LIMITS) -> Signal:
    n = F.size("annees_manquantes")
    years = F.array_join(F.transform("annees_manquantes", lambda y: y.cast("string")), ", ")
    return Signal(
        "bilan_manquant", n > 0, n >= limits["bilan_manquant_critique"],
        F.concat(n.cast("string"), F.lit(" bilan(s) annuel(s) non remis : "), years, F.lit(".")), n.cast("double"), F.struct(years.alias("annees")),
    )


def bilan_manquant(obligation: DataFrame, rapport: DataFrame, limits: dict[str, float] = _LIMITS) -> DataFrame:
    """Years without a validated report."""
    handed_in = rapport.filter("statut = 'valide'").select("projet_id", "annee")
    late = obligation.join(handed_in, ["projet_id", "annee"], "left_anti").groupBy("projet_id")
    return lever(late.agg(F.array_sort(F.collect_list("annee")).alias("annees_manquantes")), regle_bilan(limits))


def _late(as_of: dt.date) -> Column:
    return F.col("statut").isin(*OPEN_STATES) & (F.col("annee") < as_of.year)


def sommes_retard(as_of: dt.date) -> list[Column]:
    states = ", ".join(f"'{s}'" for s in OPEN_STATES)
    late = f"statut IN ({states}) AND annee < {as_of.year}"
    return [F.expr(e) for e in (
        f"count_if({late}) AS retard_n", f"min(CASE WHEN {late} THEN annee END) AS retard_annee", f"coalesce(sum(CASE WHEN {late} THEN montant_ht END), 0) AS retard_montant",
        f"transform(array_sort(collect_list(CASE WHEN {late} THEN struct(annee, id) END)), x -> x.id) AS retard_occurrences",
    )]


def regle_retard(as_of: dt.date, limits: dict[str, float] = _LIMITS) -> Signal:
    n, first = F.col("retard_n"), F.col("retard_annee")
    return Signal(
        "retard_execution", n > 0, as_of.year - first >= limits["retard_critique_ans"],
        F.concat(n.cast("string"), F.lit(" action(s) d'exercices échus non soldées, la plus ancienne de "), first.cast("string"), F.lit(".")), n.cast("double"),
        F.struct(first.alias("annee_min"), F.col("retard_montant").alias("montant_concerne"), F.col("retard_occurrences").alias("occurrences")),
    )


def retard_execution(occurrence: DataFrame, as_of: dt.date, limits: dict[str, float] = _LIMITS) -> DataFrame:
    """Actions of past years that are still open."""
    return lever(occurrence.filter(_late(as_of)).groupBy("projet_id").agg(*sommes_retard(as_of)), regle_retard(as_of, limits))


def regle_consommation(limits: dict[str, float] = _LIMITS) -> Signal:
    planned, spent = F.col("prevu_echu"), F.col("realise_echu")
    rate = spent.cast("double") / F.when(planned > 0, planned.cast("double"))
    return Signal(
        "sous_consommation", rate < limits["sous_conso_seuil"], rate < limits["sous_conso_critique"],
        F.concat(
            F.lit("Seuls "), F.round(rate * 100).cast("int").cast("string"), F.lit("% du budget prévu des exercices échus ont été facturés ("),
            F.round(spent).cast("decimal(28,0)").cast("string"), F.lit(" sur "), F.round(planned).cast("decimal(28,0)").cast("string"), F.lit(").")),
        F.round(rate, 4), F.struct("prevu_echu", "realise_echu", (planned - spent).alias("non_consomme")),
    )


def sous_consommation(delta: DataFrame, as_of: dt.date, limits: dict[str, float] = _LIMITS) -> DataFrame:
    """Past years in which too little of the planned budget was invoiced."""
    past = delta.filter(F.col("annee") < as_of.year).groupBy("projet_id")
    return lever(past.agg(F.sum("prevu").alias("prevu_echu"), F.sum("realise").alias("realise_echu")), regle_consommation(limits))


def sommes_derive() -> list[Column]:
    """Over occurrences with a column ``motive``: true where a reason was given, else null or false."""
    counted = "montant_initial IS NOT NULL AND statut <> 'supprime'"
    return [F.expr(e) for e in (
        f"sum(CASE WHEN {counted} THEN montant_initial END) AS derive_initial", f"sum(CASE WHEN {counted} THEN montant_ht END) AS derive_prevu",
        f"count_if({counted} AND abs(coalesce(montant_ht, 0) - montant_initial) >= 1 AND NOT coalesce(motive, false)) AS lignes_sans_motif",
    )]


def regle_derive(limits: dict[str, float] = _LIMITS) -> Signal:
    initial, planned, silent = F.col("derive_initial"), F.col("derive_prevu"), F.col("lignes_sans_motif")
    gap = planned - initial
    whole = F.when(initial > 0, initial.cast("double"))
    rate = F.abs(gap).cast("double") / whole
    return Signal(
        "derive_non_justifiee", (rate >= limits["derive_seuil_pct"]) & (silent > 0), rate >= limits["derive_critique_pct"],
        F.concat(
            F.lit("Écart de "), F.round(gap.cast("double") * 100 / whole).cast("int").cast("string"), F.lit("% au budget de référence ("),
            F.round(gap).cast("decimal(28,0)").cast("string"), F.lit("), dont "), silent.cast("string"), F.lit(" ligne(s) sans motif renseigné.")),
        F.round(rate, 4), F.struct(initial.alias("initial"), planned.alias("prevu"), gap.alias("ecart"), "lignes_sans_motif"),
    )


def derive_non_justifiee(occurrence: DataFrame, mouvement: DataFrame, limits: dict[str, float] = _LIMITS) -> DataFrame:
    """Large variance with changed lines for which nobody gave a reason.

    The occurrences with a reason are found once and joined; an empty reason
    counts as one here, as the rule asks only that it is not null.
    """
    reasons = mouvement.filter("motif is not null").select(F.col("occurrence_id").alias("id")).distinct().withColumn("motive", F.lit(True))
    lines = occurrence.filter("montant_initial is not null and statut <> 'supprime'").join(reasons, "id", "left")
    return lever(lines.groupBy("projet_id").agg(*sommes_derive()), regle_derive(limits))


def derniere_activite(projet: DataFrame, mouvement: DataFrame, rapport: DataFrame) -> DataFrame:
    """Last sign of life of each project that is neither archived nor closed."""
    changes = mouvement.groupBy("projet_id").agg(F.max("modifie_le").alias("m"))
    reports = rapport.groupBy("projet_id").agg(F.max("genere_le").alias("r"))
    return (
        projet.filter(~F.col("statut").isin("archive", "clos")).select(F.col("id").alias("projet_id"), "created_at", "updated_at")
        .join(changes, "projet_id", "left").join(reports, "projet_id", "left")
        .select("projet_id", F.greatest(F.coalesce("m", "created_at"), F.coalesce("r", "created_at"), F.col("updated_at")).alias("derniere_activite"))
    )


def regle_silence(as_of: dt.date, limits: dict[str, float] = _LIMITS) -> Signal:
    last = F.col("derniere_activite")

    def before(months: float) -> Column:
        return last < F.add_months(F.lit(as_of), -int(months)).cast("timestamp_ntz")

    # Whole seconds between two moments without time zone.
    seconds = F.timestamp_diff("SECOND", last, F.lit(as_of).cast("timestamp_ntz")).cast("double")
    return Signal(
        "silence", before(limits["silence_mois"]), before(limits["silence_critique_mois"]),
        F.concat(
            F.lit("Aucune activité enregistrée depuis "), F.floor(seconds / 2592000).cast("string"), F.lit(" mois (dernière le "),
            F.date_format(last, "dd/MM/yyyy"), F.lit(").")),
        F.round(seconds / 2592000), F.struct(last.cast("string").alias("derniere_activite")),
    )


def silence(activite: DataFrame, as_of: dt.date, limits: dict[str, float] = _LIMITS) -> DataFrame:
    """Projects without activity for some months; one count floors, the other rounds."""
    return lever(activite, regle_silence(as_of, limits))


def regles(as_of: dt.date, limits: dict[str, float] = _LIMITS) -> list[Signal]:
    """Every rule, over one row per project as ``portfolio.faits_par_projet`` makes it."""
    return [regle_bilan(limits), regle_retard(as_of, limits), regle_consommation(limits), regle_derive(limits), regle_silence(as_of, limits)]


def poser_signaux(faits: DataFrame, rules: list[Signal]) -> DataFrame:
    """Adds counts by level and ``signaux`` (null without any), critical ones first, then by code.

    The counts read the conditions, not the list, so a query that asks for
    counts only never gathers the details.
    """
    def entry(rule: Signal) -> Column:
        return F.when(rule.leve, F.struct((~F.coalesce(rule.critique, F.lit(False))).alias("ordre"), *rule.columns()))

    def count(critical: bool) -> Column:
        return reduce(add, [F.when(r.leve & (F.coalesce(r.critique, F.lit(False)) == critical), 1).otherwise(0) for r in rules]).cast("bigint")

    raised = F.array_sort(F.array_compact(F.array(*map(entry, rules))))
    return faits.withColumns({
        "nb_critique": count(True), "nb_attention": count(False), "signaux": F.when(F.size(raised) > 0, F.transform(raised, lambda s: s.dropFields("ordre"))),
    })


def tous_les_signaux(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def signaux_par_projet(signal: DataFrame) -> DataFrame:
    """Counts by level, and the signals with critical ones first, then by code."""
    entry = F.struct((F.col("niveau") != "critique").alias("ordre"), "code", "niveau", "libelle", "valeur", "detail")
    return signal.groupBy("projet_id").agg(
        F.count_if(F.col("niveau") == "critique").alias("nb_critique"), F.count_if(F.col("niveau") == "attention").alias("nb_attention"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda s: s.dropFields("ordre")).alias("signaux"),
    )
