"""The one-pass facts of a project against the operators that compute each part by itself."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import budget, portfolio, signals
from ledgerloom.plans.portfolio_plans import facts_of, parc_of, signals_of
from ledgerloom.sources.domain import AS_OF, Domain

SF = "/root/testdata/sf0.001"
MONEY = ("montant_initial", "montant_ht", "montant_engage", "montant_realise")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def stamp(year, month=1):
    return dt.datetime(year, month, 1)


@pytest.fixture(scope="module")
def small(spark):
    """Projects without reports, occurrences or dates; null states and years; an occurrence of an unknown project."""
    projet = spark.createDataFrame(
        [(1, 1, "actif", dt.date(1996, 1, 1), None), (2, 1, "archive", dt.date(1995, 1, 1), dt.date(1997, 1, 1)), (3, 2, "actif", None, None),
         (4, 2, None, dt.date(1999, 1, 1), None), (5, 2, "actif", dt.date(2005, 1, 1), dt.date(2001, 1, 1))],
        "id long, organisation_id long, statut string, date_decision date, date_fin date",
    ).withColumns({"nom": F.concat(F.lit("P"), "id"), "created_at": F.lit(stamp(1996)).cast("timestamp_ntz"), "updated_at": F.lit(stamp(1997)).cast("timestamp_ntz")})
    lines = [
        (10, 1, 1997, 1996, "planifie", 100, 150, 50, None), (11, 1, 1998, None, "realise", 100, 100, None, 20), (12, 1, None, 1998, "realise", None, 70, None, None),
        (13, 1, 2000, 2000, "supprime", 500, 500, 500, 500), (14, 1, 1999, 1999, "en_cours", 40, 40, None, 0), (20, 2, 1996, 1996, "supprime", None, 5, None, None),
        (30, 3, 1995, 1995, None, 10, 20, 5, 5), (90, 9, 1990, 1990, "a_confirmer", 10, 99, None, None), (15, 1, 2000, 1999, "repousse", None, None, None, None),
    ]
    occurrence = spark.createDataFrame(lines, "id long, projet_id long, annee int, annee_initiale int, statut string, " + ", ".join(f"{m} int" for m in MONEY))
    occurrence = occurrence.withColumns({m: F.col(m).cast("decimal(18,2)") for m in MONEY})
    journal = spark.createDataFrame(
        [(10, None, stamp(1997)), (14, "", stamp(1998, 6)), (14, None, None), (11, None, stamp(1996)), (77, "gone", stamp(2000))], "occurrence_id long, motif string, modifie_le timestamp_ntz")
    rapport = spark.createDataFrame(
        [(1, 1, 1996, 1, "valide", stamp(1997)), (2, 1, 1996, 2, "brouillon", stamp(1998)), (3, 1, 1997, 1, "brouillon", stamp(1998)), (4, 1, None, 1, "valide", None),
         (5, 2, 1995, 1, None, stamp(1996)), (6, 2, 1996, None, "valide", stamp(1996)), (7, 1, 1998, 2, None, None)],
        "id long, projet_id long, annee int, version int, statut string, genere_le timestamp_ntz").withColumn("valide_le", F.col("genere_le"))
    organisation = spark.createDataFrame([(1, "A"), (2, "B")], "id long, nom string")
    return projet, occurrence, journal, rapport, organisation


def separate(projet, occurrence, mouvement, rapport):
    delta = budget.budget_delta_annuel(occurrence)
    found = signals.tous_les_signaux([
        signals.bilan_manquant(signals.annees_obligation(projet, AS_OF), rapport), signals.retard_execution(occurrence, AS_OF), signals.sous_consommation(delta, AS_OF),
        signals.derive_non_justifiee(occurrence, mouvement), signals.silence(signals.derniere_activite(projet, mouvement, rapport), AS_OF),
    ])
    return delta, found


def check(projet, occurrence, mouvement, rapport, organisation, faits):
    delta, found = separate(projet, occurrence, mouvement, rapport)
    columns = ["projet_id", "code", "niveau", "libelle", "valeur", "detail"]
    assert rows(portfolio.signaux_des_faits(faits), *columns) == rows(found, *columns)
    parc = portfolio.parc_projet(
        projet, organisation, signals.signaux_par_projet(found), portfolio.finances_par_projet(delta, AS_OF), portfolio.statuts_par_projet(occurrence),
        portfolio.bilans_par_projet(portfolio.matrice_bilans(projet, rapport, AS_OF)))
    one_pass = portfolio.parc_des_faits(faits, organisation)
    assert {c for c in parc.columns} <= set(one_pass.columns)
    assert rows(one_pass, *sorted(parc.columns)) == rows(parc, *sorted(parc.columns))
    return found


def test_facts_equal_separate_operators_with_nulls_and_orphans(small):
    projet, occurrence, journal, rapport, organisation = small
    mouvement = journal.join(occurrence.select(F.col("id").alias("occurrence_id"), "projet_id"), "occurrence_id")
    found = check(projet, occurrence, mouvement, rapport, organisation, portfolio.faits_par_projet(projet, occurrence, journal, rapport, AS_OF))
    assert {r.projet_id for r in found.filter("code = 'retard_execution'").collect()} == {1, 9}


def test_facts_equal_separate_operators_on_the_tables(spark):
    d = Domain(spark, SF)
    check(d.projet, d.occurrence, d.mouvement, d.rapport, d.organisation, facts_of(d))


def test_facts_of_empty_tables(small):
    projet, occurrence, journal, rapport, organisation = small
    faits = portfolio.faits_par_projet(projet.limit(0), occurrence.limit(0), journal.limit(0), rapport.limit(0), AS_OF)
    assert portfolio.parc_des_faits(faits, organisation).count() == 0 and portfolio.signaux_des_faits(faits).count() == 0


def test_yearly_budget_sums_both_years_of_a_line(small):
    got = {(r.projet_id, r.annee): (r.initial, r.prevu) for r in budget.budget_delta_annuel(small[1]).collect()}
    assert got[1, 1996] == (100, 0) and got[1, 1997] == (0, 150) and got[1, 1998] == (0, 100) and got[1, None] == (0, 70)
    assert got[1, 2000] == (500, 0) and (2, 1996) not in got and got[9, 1990] == (10, 99)


@pytest.mark.parametrize("query", [signals_of, parc_of])
def test_each_table_is_read_once_per_use(spark, query):
    plan = query(Domain(spark, SF))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("orders.parquet") == 3  # projects, occurrences and reports are all made of orders
    assert plan.count("lineitem.parquet") == 1 and plan.count("events.parquet") == 1
