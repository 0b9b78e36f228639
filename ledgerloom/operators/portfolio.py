"""Portfolio roll-ups: by project, organisation and year, with access rules."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import signals
from ledgerloom.operators.budget import DELETED


def peut_voir(role: str, organisation_id: int | None, column: str = "organisation_id") -> Column:
    """Rows that a role may read: controllers and admins all, operators those of their organisation."""
    if role in ("controleur", "admin"):
        return F.lit(True)
    if organisation_id is None:
        return F.lit(False)
    return F.col(column) == organisation_id


def meilleur_rapport(rapport: DataFrame) -> DataFrame:
    """Best report of each project and year: validated ones first, then the highest version."""
    order = Window.partitionBy("projet_id", "annee").orderBy(F.desc(F.col("statut") == "valide"), F.desc("version"))
    return rapport.withColumn("_rang", F.row_number().over(order)).filter("_rang = 1").drop("_rang")


def matrice_bilans(projet: DataFrame, rapport: DataFrame, as_of: dt.date) -> DataFrame:
    """State of the report in every year of every project, archived projects included."""
    first = F.year("date_decision")
    last = F.year(F.coalesce("date_fin", F.add_months(F.lit(as_of), 12)))
    cells = projet.filter("date_decision is not null").select(
        F.col("id").alias("projet_id"), "organisation_id", F.explode(F.when(first <= last, F.sequence(first, last))).alias("annee"),
    )
    best = meilleur_rapport(rapport).select("projet_id", "annee", F.col("id").alias("rapport_id"), "statut", "version", "valide_le")
    absent = F.when(F.col("annee") < as_of.year, "manquant").otherwise("a_venir")
    return cells.join(best, ["projet_id", "annee"], "left").select(
        "projet_id", "organisation_id", "annee", F.coalesce("statut", absent).alias("etat"), "rapport_id", "version", "valide_le",
    )


def finances_par_projet(delta: DataFrame, as_of: dt.date) -> DataFrame:
    """Lifetime and current-year sums, first and last year."""
    now = F.col("annee") == as_of.year
    return delta.groupBy("projet_id").agg(
        *[F.sum(m).alias(f"total_{m}") for m in ("initial", "prevu", "engage", "realise")],
        *[F.sum(F.when(now, F.col(m))).alias(f"{m}_annee_courante") for m in ("prevu", "realise")],
        F.min("annee").alias("premiere_annee"), F.max("annee").alias("derniere_annee"),
    )


def statuts_par_projet(occurrence: DataFrame) -> DataFrame:
    """Counts by state, without deleted rows."""
    return occurrence.filter("statut <> 'supprime'").groupBy("projet_id").agg(
        F.count("*").alias("nb_occurrences"), F.count_if(F.col("statut") == "realise").alias("nb_occurrences_realisees"),
        F.count_if(F.col("statut") == "repousse").alias("nb_occurrences_reportees"),
    )


def bilans_par_projet(matrice: DataFrame) -> DataFrame:
    return matrice.groupBy("projet_id").agg(
        F.count_if(F.col("etat") == "manquant").alias("nb_bilans_manquants"), F.count_if(F.col("etat") == "valide").alias("nb_bilans_valides"),
        F.max(F.when(F.col("etat") == "valide", F.col("annee"))).alias("dernier_bilan_valide"),
    )


def faits_occurrence(occurrence: DataFrame, journal: DataFrame, as_of: dt.date) -> DataFrame:
    """Everything that the portfolio asks of occurrences and their changes, per project, in one aggregate.

    ``journal`` holds occurrence_id, motif and modifie_le.  It is reduced to a
    row per occurrence before it joins.  Sums over the years of the annual
    budget are sums over its lines, so no year has to be formed first.
    """
    changes = journal.groupBy(F.col("occurrence_id").alias("id")).agg(F.max(F.col("motif").isNotNull()).alias("motive"), F.max("modifie_le").alias("change_le"))
    frozen, on, now = "montant_initial IS NOT NULL AND annee_initiale IS NOT NULL", f"statut <> '{DELETED}'", as_of.year
    amounts = {"prevu": "montant_ht", "engage": "montant_engage", "realise": "montant_realise"}
    # As text: each expression is one call to the JVM, where columns would take a dozen.
    sums = [
        f"coalesce(sum(CASE WHEN {frozen} THEN montant_initial END), 0) AS total_initial", *[f"coalesce(sum(CASE WHEN {on} THEN {c} END), 0) AS total_{m}" for m, c in amounts.items()],
        *[f"sum(CASE WHEN {on} AND annee = {now} THEN coalesce({amounts[m]}, 0) WHEN {frozen} AND annee_initiale = {now} THEN 0 END) AS {m}_annee_courante" for m in ("prevu", "realise")],
        *[f"{pick}({of}(CASE WHEN {on} THEN annee END), {of}(CASE WHEN {frozen} THEN annee_initiale END)) AS {n}_annee" for n, pick, of in (("premiere", "least", "min"), ("derniere", "greatest", "max"))],
        f"count_if({on}) AS nb_occurrences", "count_if(statut = 'realise') AS nb_occurrences_realisees", "count_if(statut = 'repousse') AS nb_occurrences_reportees",
        *[f"coalesce(sum(CASE WHEN {on} AND annee < {now} THEN {amounts[m]} END), 0) AS {m}_echu" for m in ("prevu", "realise")], "max(change_le) AS change_le",
    ]
    return occurrence.join(changes, "id", "left").groupBy("projet_id").agg(*map(F.expr, sums), *signals.sommes_retard(as_of), *signals.sommes_derive())


def faits_rapport(rapport: DataFrame) -> DataFrame:
    """Per project: state of the best report by year, as a map, and the last moment at which one was made."""
    rank = F.struct(F.col("statut") == "valide", "version")
    years = rapport.groupBy("projet_id", "annee").agg(F.max_by("statut", rank).alias("statut"), F.max("genere_le").alias("genere_le"))
    known = F.collect_list(F.when(F.col("annee").isNotNull(), F.struct("annee", "statut")))
    return years.groupBy("projet_id").agg(F.map_from_entries(known).alias("etats"), F.max("genere_le").alias("rapport_le"))


def faits_par_projet(projet: DataFrame, occurrence: DataFrame, journal: DataFrame, rapport: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per project with its signals, finances, states and reports; each table is read once.

    Projects that only occurrences name have a row too, with nulls for the
    project's own columns.
    """
    this_year = as_of.year
    started = F.year("date_decision")

    def years(last: Column, wanted: Column) -> Column:
        # sequence() counts down or fails when the end lies before the start.
        return F.coalesce(F.when(wanted & (started <= last), F.sequence(started, last)), F.array().cast("array<int>"))

    def report(year: Column) -> Column:
        return F.try_element_at("etats", year)

    def state(year: Column) -> Column:
        return F.coalesce(report(year), F.when(year < this_year, "manquant").otherwise("a_venir"))

    owed = years(F.least(F.year(F.coalesce("date_fin", F.lit(as_of))), F.lit(this_year - 1)), F.col("statut") != "archive")
    shown = years(F.year(F.coalesce("date_fin", F.add_months(F.lit(as_of), 12))), F.lit(True))
    valid = F.filter("annees_bilan", lambda y: state(y) == "valide")
    active = ~F.col("statut").isin("archive", "clos")
    wide = projet.withColumnRenamed("id", "projet_id").join(faits_occurrence(occurrence, journal, as_of), "projet_id", "full").join(faits_rapport(rapport), "projet_id", "left")
    filled = wide.withColumns({
        "annees_manquantes": F.filter(owed, lambda y: F.coalesce(report(y), F.lit("")) != "valide"), "annees_bilan": shown,
        "derniere_activite": F.when(active, F.greatest(F.coalesce("change_le", "created_at"), F.coalesce("rapport_le", "created_at"), F.col("updated_at"))),
    }).withColumns({
        "nb_bilans_manquants": F.size(F.filter("annees_bilan", lambda y: state(y) == "manquant")).cast("bigint"),
        "nb_bilans_valides": F.size(valid).cast("bigint"), "dernier_bilan_valide": F.array_max(valid),
    })
    return signals.poser_signaux(filled, signals.regles(as_of))


def signaux_des_faits(faits: DataFrame) -> DataFrame:
    """One row per project and signal."""
    return faits.select("projet_id", F.explode("signaux").alias("s")).select("projet_id", "s.*")


def parc_des_faits(faits: DataFrame, organisation: DataFrame) -> DataFrame:
    """``parc_projet`` from one row of facts per project."""
    return _completer(faits.join(_nommee(organisation), "organisation_id"))


def _nommee(organisation: DataFrame) -> DataFrame:
    return organisation.select(F.col("id").alias("organisation_id"), F.col("nom").alias("organisation_nom"))


def parc_projet(projet: DataFrame, organisation: DataFrame, signaux: DataFrame, finances: DataFrame, statuts: DataFrame, bilans: DataFrame) -> DataFrame:
    """One row per project.  The four inputs are aggregated per project before they join."""
    joined = projet.withColumnRenamed("id", "projet_id").join(_nommee(organisation), "organisation_id")
    for part in (signaux, finances, statuts, bilans):
        joined = joined.join(part, "projet_id", "left")
    return _completer(joined)


def _completer(joined: DataFrame) -> DataFrame:
    """Zeros for what a project lacks, and the columns that follow from the others."""
    zeros = [
        "nb_critique", "nb_attention", "total_initial", "total_prevu", "total_engage", "total_realise", "prevu_annee_courante", "realise_annee_courante",
        "nb_occurrences", "nb_occurrences_realisees", "nb_occurrences_reportees", "nb_bilans_manquants", "nb_bilans_valides",
    ]
    filled = {c: F.expr(f"coalesce({c}, 0)") for c in zeros}
    return joined.withColumns(filled | {
        "gravite": F.expr("CASE WHEN nb_critique > 0 THEN 2 WHEN nb_attention > 0 THEN 1 ELSE 0 END"), "delta_total": F.expr("coalesce(total_prevu, 0) - coalesce(total_initial, 0)"),
    })


def lister_parc(
    parc: DataFrame, *, role: str = "controleur", organisation_id: int | None = None, organisation_filtre: int | None = None, departement: str | None = None,
    gravite: int | None = None, signal: str | None = None, statut: str | None = None, q: str | None = None, file_controle: bool = False,
) -> DataFrame:
    """Portfolio list: the role's rows, under any of the filters, worst first."""
    wanted = [peut_voir(role, organisation_id)]
    for column, value in (("organisation_id", organisation_filtre), ("departement", departement), ("gravite", gravite), ("statut", statut)):
        if value is not None and value != "":
            wanted.append(F.col(column) == value)
    if q:
        wanted.append(F.ilike("nom", F.lit(f"%{q}%")) | F.ilike(F.coalesce("reference_interne", F.lit("")), F.lit(f"%{q}%")))
    if signal:
        wanted.append(F.coalesce(F.exists("signaux", lambda s: s["code"] == signal), F.lit(False)))
    if file_controle:
        wanted.append(F.col("gravite") > 0)
    return parc.filter(reduce(and_, wanted)).orderBy(F.desc("gravite"), F.desc("nb_critique"), F.desc("nb_attention"), F.desc("total_prevu"), "projet_id")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part.cast("double") / whole.cast("double"), 4))


def parc_organisation(organisation: DataFrame, parc: DataFrame) -> DataFrame:
    """Roll-up by organisation, those without projects included."""
    measures = ["total_prevu", "total_realise", "total_initial", "delta_total", "nb_bilans_valides", "nb_bilans_manquants", "nb_occurrences", "nb_occurrences_realisees"]
    sums = parc.groupBy("organisation_id").agg(
        F.count("*").alias("nb_projets"), *[F.count_if(F.col("gravite") == g).alias(n) for g, n in ((2, "nb_projets_critiques"), (1, "nb_projets_attention"), (0, "nb_projets_conformes"))],
        *[F.sum(m).alias(m) for m in measures],
    )
    joined = organisation.select(F.col("id").alias("organisation_id"), F.col("nom").alias("organisation_nom")).join(sums, "organisation_id", "left")
    counts = ["nb_projets", "nb_projets_critiques", "nb_projets_attention", "nb_projets_conformes", *measures[:4]]
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    valid, missing = F.col("nb_bilans_valides"), F.col("nb_bilans_manquants")
    return filled.withColumns({
        "taux_remise_bilans": _ratio(valid, valid + missing), "taux_execution": _ratio(F.col("total_realise"), F.col("total_prevu")),
        "taux_actions_realisees": _ratio(F.col("nb_occurrences_realisees"), F.col("nb_occurrences")),
    }).drop("nb_occurrences", "nb_occurrences_realisees")


def parc_financier_annuel(delta: DataFrame, projet: DataFrame, organisation: DataFrame) -> DataFrame:
    """Consolidated finances by organisation and year."""
    owner = projet.select(F.col("id").alias("projet_id"), "organisation_id")
    org = organisation.select(F.col("id").alias("organisation_id"), F.col("nom").alias("organisation_nom"))
    return delta.join(owner, "projet_id").join(org, "organisation_id").groupBy("organisation_id", "organisation_nom", "annee").agg(
        F.countDistinct("projet_id").alias("nb_projets"), *[F.sum(m).alias(m) for m in ("initial", "prevu", "engage", "realise")], F.sum("delta_prevu_initial").alias("delta"),
    )


def synthese_parc(parc: DataFrame) -> DataFrame:
    """The whole portfolio in one row."""
    return parc.agg(
        F.count("*").alias("nb_projets"), F.countDistinct("organisation_id").alias("nb_organisations"), F.coalesce(F.sum("total_prevu"), F.lit(0)).alias("budget_total"),
        F.coalesce(F.sum("total_realise"), F.lit(0)).alias("realise_cumule"), F.coalesce(F.sum("realise_annee_courante"), F.lit(0)).alias("realise_annee_courante"),
        *[F.count_if(F.col("gravite") == g).alias(n) for g, n in ((0, "nb_conformes"), (1, "nb_attention"), (2, "nb_critiques"))],
        F.coalesce(F.sum("nb_bilans_valides"), F.lit(0)).alias("bilans_valides"), F.coalesce(F.sum("nb_bilans_manquants"), F.lit(0)).alias("bilans_manquants"),
    ).withColumn("taux_remise_bilans", _ratio(F.col("bilans_valides"), F.col("bilans_valides") + F.col("bilans_manquants")))


def projets_par_signal(signal: DataFrame, parc: DataFrame | None = None) -> DataFrame:
    """Distinct projects, and critical ones, by signal code; of the portfolio's projects only, if it is given."""
    kept = signal if parc is None else signal.join(parc.select("projet_id"), "projet_id", "left_semi")
    return kept.groupBy("code").agg(
        F.countDistinct("projet_id").alias("nb_projets"), F.countDistinct(F.when(F.col("niveau") == "critique", F.col("projet_id"))).alias("nb_critiques"),
    )
