"""Budgets of projects: initial against current, variance, cumulated years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETED = "supprime"


def total(amount: Column | str, condition: Column | None = None) -> Column:
    """Sum that is zero, not null, without rows; optionally of some rows only."""
    value = F.col(amount) if isinstance(amount, str) else amount
    return F.coalesce(F.sum(value if condition is None else F.when(condition, value)), F.lit(0))


def alive() -> Column:
    return F.col("statut") != DELETED


def budget_annuel(occurrence: DataFrame) -> DataFrame:
    """Counts and sums per project and year, without deleted rows."""
    return occurrence.filter(alive()).groupBy("projet_id", "annee").agg(
        F.count("montant_ht").alias("nb_lignes_chiffrees"), F.count("*").alias("nb_occurrences"),
        total("montant_ht").alias("total_ht"), total("montant_realise").alias("total_ht_realise"), total("montant_engage").alias("total_ht_engage"),
    )


def budget_delta_annuel(occurrence: DataFrame) -> DataFrame:
    """Frozen baseline against current amounts, per project and year of either side.

    A line counts in its current year and, for its baseline, in its first one:
    it becomes an entry for each, and one aggregate sums both sides, so the
    lines are read once and nothing is joined.
    """
    amounts = [("prevu", "montant_ht"), ("engage", "montant_engage"), ("realise", "montant_realise")]
    kinds = {c: occurrence.schema[c].dataType for c in ("montant_initial", *[c for _, c in amounts])}

    def entry(year: str, now: bool) -> Column:
        sides = [*[(m, c, now) for m, c in amounts], ("initial", "montant_initial", not now)]
        return F.struct(F.col(year).alias("annee"), *[(F.col(c) if used else F.lit(None).cast(kinds[c])).alias(m) for m, c, used in sides])

    frozen = F.col("montant_initial").isNotNull() & F.col("annee_initiale").isNotNull()
    entries = F.array_compact(F.array(F.when(alive(), entry("annee", True)), F.when(frozen, entry("annee_initiale", False))))
    measures = [total(m).alias(m) for m in ("initial", "prevu", "engage", "realise")]
    sums = occurrence.select("projet_id", F.inline(entries)).groupBy("projet_id", "annee").agg(*measures)
    return sums.withColumn("delta_prevu_initial", F.col("prevu") - F.col("initial"))


def budget_ecarts(occurrence: DataFrame) -> DataFrame:
    """Variance against the baseline, by cause and reference year."""
    has_initial = F.col("montant_initial").isNotNull()
    return occurrence.groupBy("projet_id", F.coalesce("annee_initiale", "annee").alias("annee_ref")).agg(
        total("montant_initial", ~alive() & has_initial).alias("annule"),
        total("montant_ht", alive() & F.col("annee_initiale").isNotNull() & (F.col("annee") != F.col("annee_initiale"))).alias("glisse_sortant"),
        total("montant_ht", alive() & ~has_initial).alias("ajoute"),
        total(F.col("montant_ht") - F.col("montant_initial"), alive() & has_initial & (F.col("annee") == F.col("annee_initiale"))).alias("revision_prix"),
    )


def pluriannuel(delta: DataFrame, annee: int) -> DataFrame:
    """Per project: invoiced up to the year, and still to be committed after it."""
    gap = F.greatest(F.col("prevu") - F.col("engage"), F.lit(0))
    return delta.groupBy("projet_id").agg(
        total("realise", F.col("annee") <= annee).alias("cumul_realise_fin_annee"), total(gap, F.col("annee") > annee).alias("restant_a_engager"),
    )


def synthese(delta: DataFrame) -> DataFrame:
    """Execution and commitment rates; null where nothing is planned.  Half-even rounding."""
    planned = F.col("prevu").cast("double")

    def rate(name: str) -> Column:
        return F.when(planned != 0, F.bround(F.col(name).cast("double") / planned, 4))

    return delta.withColumn("taux_execution", rate("realise")).withColumn("taux_engagement", rate("engage"))


def controle_croise(lines: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Sheets whose declared total differs from the sum of their lines by more than the tolerance."""
    sums = lines.groupBy("feuille").agg(
        F.sum(F.when(~F.col("est_total"), F.col("montant"))).alias("detail"), F.max(F.when(F.col("est_total"), F.col("montant"))).alias("declare"),
    )
    gap = F.abs(F.col("declare") - F.col("detail"))
    return sums.filter(F.col("declare").isNotNull() & F.col("detail").isNotNull() & (gap > F.abs(F.col("declare")) * tolerance)).withColumn("ecart", gap)


def par_categorie(lines: DataFrame) -> DataFrame:
    """Totals of report lines by category."""
    return lines.groupBy("categorie").agg(
        F.count("*").alias("nb_lignes"), *[total(m).alias(f"total_{m}") for m in ("montant_initial", "montant_ht", "montant_engage", "montant_realise")],
    )


def cascade(ecarts: DataFrame, delta: DataFrame) -> DataFrame:
    """Steps from the initial to the planned budget of each project and year.

    What was moved to other years or cancelled counts against the budget.
    Posts under one unit are left out; what the kept ones don't explain is the
    residue.  ``largeur`` is each post's share of the largest, in percent.
    """
    posts = [("glisse_sortant", -F.abs("glisse_sortant")), ("annule", -F.abs("annule")), ("ajoute", F.col("ajoute")), ("revision_prix", F.col("revision_prix"))]
    signed = ecarts.select(
        "projet_id", F.col("annee_ref").alias("annee"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("ordre"), F.lit(name).alias("poste"), value.alias("montant")) for k, (name, value) in enumerate(posts)])).alias("p"),
    ).select("projet_id", "annee", "p.*").filter("abs(montant) >= 1")
    top = signed.groupBy("projet_id", "annee").agg(F.max(F.abs("montant")).alias("plus_grand"), F.sum("montant").alias("explique"))
    known = delta.select("projet_id", "annee", (F.col("prevu") - F.col("initial")).alias("delta"))
    return signed.join(top, ["projet_id", "annee"]).join(known, ["projet_id", "annee"]).select(
        "projet_id", "annee", "ordre", "poste", "montant",
        F.bround(F.abs("montant").cast("double") / F.col("plus_grand").cast("double") * 100, 1).alias("largeur"),
        (F.col("delta") - F.col("explique")).alias("residu"),
    )


def sous_execution(delta: DataFrame, occurrence: DataFrame, soldees: float = 0.7, taux: float = 0.7) -> DataFrame:
    """Years in which most actions are settled although little was invoiced."""
    settled = occurrence.filter(alive()).groupBy("projet_id", "annee").agg(
        F.count("*").alias("nb"), F.count_if(F.col("statut").isin("realise", "repousse")).alias("nb_soldees"),
    )
    share = F.col("nb_soldees") / F.col("nb")
    rate = F.when(F.col("prevu") > 0, F.col("realise").cast("double") / F.col("prevu").cast("double"))
    return delta.join(settled, ["projet_id", "annee"]).select(
        "projet_id", "annee", F.round(share, 4).alias("part_soldee"), F.round(rate, 4).alias("taux_execution"),
        F.coalesce((share >= soldees) & (rate < taux), F.lit(False)).alias("sous_execution"),
    )


def largeurs(delta: DataFrame) -> DataFrame:
    """Bar width of each year's planned amount, in percent of the project's largest."""
    top = delta.groupBy("projet_id").agg(F.greatest(F.max("prevu").cast("double"), F.lit(1.0)).alias("plus_grand"))
    return delta.join(top, "projet_id").select("projet_id", "annee", F.bround(F.col("prevu").cast("double") / F.col("plus_grand") * 100, 1).alias("largeur"))
