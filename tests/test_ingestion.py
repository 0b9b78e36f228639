import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ingestion


def test_a_project_from_metadata(spark):
    rows = spark.createDataFrame([("", " Op ", None, ["A", "B"], None, 2020, 2024), ("N", None, "R1", [], 3, None, None)], "nom string, nom_operation string, reference_interne string, communes array<string>, duree_ans int, annee_debut int, annee_fin int")
    got = [tuple(r) for r in ingestion.project_from_metadata(rows, dt.date(2024, 1, 2)).collect()]
    assert got == [("Op", "REF-20240102", "A", 5), ("N", "R1", None, 3)]


def test_seed_keeps_edits_and_counts(spark):
    meta = spark.createDataFrame([(1, "old")], "projet_id int, nom string")
    sheet = spark.createDataFrame([(1, "a", "x")], "projet_id int, cle string, titre string")
    rule = spark.createDataFrame([(1, "e", "C1", "01-01", "02-01", "old")], "projet_id int, cle string, code_operation string, fenetre_debut string, fenetre_fin string, libelle string")
    occ = spark.createDataFrame([(1, 7, 2020, "ia", None), (2, 7, 2021, "ia", dt.datetime(2020, 1, 1)), (3, None, 2020, "manuel", None)], "id int, echeance_id int, annee int, origine string, modifie_le timestamp")
    incoming = {
        "metadata": spark.createDataFrame([(1, "new"), (2, "other")], meta.schema), "fiche": spark.createDataFrame([(1, "a", "y"), (1, "b", "z")], sheet.schema),
        "echeance": spark.createDataFrame([(1, "e", "C9", "09-09", "10-10", "new")], rule.schema),
        "occurrence": spark.createDataFrame([(10, 7, 2020, "ia", None), (11, 7, 2021, "ia", None), (12, None, 2020, "ia", None), (13, 7, 2020, "ia", None)], occ.schema),
    }
    tables = {"metadata": meta, "fiche": sheet, "echeance": rule, "occurrence": occ}
    got = ingestion.seed(tables, incoming, replace=False)
    assert sorted(r.nom for r in got["metadata"].collect()) == ["new", "other"]
    assert sorted((r.cle, r.titre) for r in got["fiche"].collect()) == [("a", "y"), ("b", "z")]
    assert [(r.code_operation, r.fenetre_debut, r.libelle) for r in got["echeance"].collect()] == [("C1", "01-01", "new")]
    assert sorted(r.id for r in got["occurrence"].collect()) == [1, 2, 3, 12]
    assert tuple(ingestion.import_counters(occ, incoming["occurrence"], got["occurrence"]).first()) == (4, 1, 3)
    assert sorted(r.id for r in ingestion.seed(tables, incoming, replace=True)["occurrence"].collect()) == [2, 3, 10, 12]


def test_budget_rows(spark):
    lines = spark.createDataFrame([(0, " ", 1.0, "f", None, ["1", "x", "22"])], "rang int, libelle_prestation string, montant_ht double, feuille string, est_total boolean, source_lignes array<string>")
    r = ingestion.budget_rows(lines, 5).first()
    assert (r.projet_id, r.libelle_prestation, r.est_total, r.source_lignes, len(r.empreinte)) == (5, "(sans libellé)", False, [1, 22], 64)


def test_schema_changes_can_be_repeated(spark):
    table = spark.createDataFrame([(1, "a", None)], "id int, unites string, ug string")
    once = ingestion.evolve(table, {"unites": "ug"}, {"theme": "string"}, ("vieux",))
    assert once.columns == ["id", "ug", "theme"] and once.first().ug == "a"
    assert ingestion.evolve(once, {"unites": "ug"}, {"theme": "string"}, ("vieux",)).columns == once.columns


def test_stages_resume(spark, tmp_path):
    calls = []

    def make(n):
        def build():
            calls.append(n)
            if n == 2 and calls.count(2) == 1:
                raise RuntimeError("lost")
            return spark.range(n)
        return build

    run = ingestion.StagedRun(spark, str(tmp_path), "r1")
    run.stage("one", make(1))
    with pytest.raises(RuntimeError):
        run.stage("two", make(2))
    assert {r.stage: r.state for r in run.status().collect()} == {"one": "done", "two": "error"}
    assert run.stage("one", make(1)).count() == 1 and run.stage("two", make(2)).count() == 2
    assert calls == [1, 2, 2] and {r.state for r in run.status().collect()} == {"done"}


def test_batch_goes_on_after_a_failure(spark):
    def work(k):
        if k == 2:
            raise ValueError("bad")
        return f"done {k}"

    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "id int, autre string").repartition(3)
    got = {r.autre: (r.id, r.resultat, r.erreur) for r in ingestion.run_batch(items, "id", work).collect()}
    assert got == {"a": (1, "done 1", None), "b": (2, None, "ValueError: bad"), "c": (3, "done 3", None), "d": (None, "done None", None)}
    assert ingestion.run_batch(items.limit(0), "id", work).count() == 0


def test_audit_rows(spark):
    assert ingestion.audit("bilan.valider", 3, "rapport", {"b": 1}, spark).filter(F.col("detail").contains("b")).count() == 1


def test_sheet_lines_need_one_aggregate(spark):
    from ledgerloom.sources import readers

    schema = "sheet string, row int, col int, value string, is_text boolean, merge_id int, merge_rank int, is_sum boolean"
    cells = [("a", 2, 3, "x", True, None, None, False), ("a", 2, 1, "T", True, 7, 0, False), ("a", 2, 2, None, True, 7, 1, False), ("a", 9, 1, "4", False, 8, 0, True), ("a", 9, 2, None, False, 8, 1, True), ("b", 1, 1, "", True, None, None, True)]
    found = readers.flatten_sheet(spark.createDataFrame(cells, schema))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 2, "T | T | x"), ("a", 9, "4 |  |  [TOTAL?]")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
