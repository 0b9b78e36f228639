"""Hand-written expectations: the worked examples and rules without a SQL twin."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import budget, calendar, export_check, geo, mutations, portfolio, report
from ledgerloom.sources import readers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


RULE = ("id long, projet_id long, type string, ancrage_annee int, intervalle_ans double, duree_ans int, occurrences_par_an int, "
        "paliers array<struct<intervalle_ans:double,nombre_occurrences:int>>, code_operation string, libelle string, confiance double, champs_a_confirmer array<string>")
TIERS = [(1.0, 4), (3.0, 5)]


def rule(kind, anchor, step=None, years=None, times=None, tiers=()):
    return (1, 1, kind, anchor, step, years, times, list(tiers), "tu 3", "Suivi", 0.9, [])


@pytest.mark.parametrize(
    "row, horizon, expected",
    [
        (rule("paliers", 2019, tiers=TIERS), 2048, [2019, 2020, 2021, 2022, 2023, 2026, 2029, 2032, 2035, 2038]),
        (rule("paliers", 2019, tiers=TIERS), 2030, [2019, 2020, 2021, 2022, 2023, 2026, 2029]),
        (rule("paliers", 2019), 2048, []),
        (rule("periodique", None, 1.0), 2030, []),
        (rule("periodique", 2020, 2.5), 2027, [2020, 2022, 2024, 2026]),
        (rule("periodique", 2020, 0.2), 2022, [2020, 2021, 2022]),
        (rule("periodique", 2025), 2024, []),
        (rule("campagnes", 2020, years=3, times=2), 2021, [2020, 2021]),
        (rule("campagnes", 2020), 2021, [2020]),
        (rule("ponctuel", 2020), 2019, []),
        (rule("dependant_evenement", 2020), 2020, [2020]),
        (rule("autre", 2020), 2030, []),
    ],
)
def test_years_of_a_rule(spark, row, horizon, expected):
    rules = spark.createDataFrame([row], RULE)
    assert rules.select(calendar.annees(rules, horizon).alias("y")).first().y == expected


def test_generated_occurrences(spark):
    rules = spark.createDataFrame([rule("campagnes", 2020, years=3, times=2)], RULE)
    got = calendar.generer_occurrences(rules, 2021, 2021).orderBy("annee").collect()
    assert [(r.code, r.titre, r.statut) for r in got] == [("TU 3", "Suivi (×2/an)", "a_confirmer"), ("TU 3", "Suivi (×2/an)", "planifie")]
    assert calendar.non_placables(spark.createDataFrame([rule("paliers", 2019)], RULE), 2048).count() == 1


def test_scalars(spark):
    L = F.lit
    r = one(
        spark, S.normalize_ug_id(L("UG 1")).alias("a"), S.normalize_ug_id(L("")).alias("b"), S.normalize_ug_ids(F.array(L("UG2"), L("ug 1"), L("ug2")), ordered=False).alias("c"),
        S.display_code(L("TU3")).alias("d"), S.display_code(L("x-1")).alias("e"), S.slugify(L("  Été à l'île ! ")).alias("f"), S.fit(L("  "), 5)["texte"].alias("g"),
        S.deadline(L(2023), L(11), L(2)).alias("h"), S.month_of(L("13-01")).alias("i"), S.month_of(L("09-01")).alias("j"), S.money(L("2.345")).alias("k"),
        S.json_inside(L("```json\n{\"a\": {\"b\": 1}}\n```")).alias("l"), S.is_vertical_sum(L("=SUM(C3:C9)")).alias("m"), S.is_vertical_sum(L("=SUM(C3:D9)")).alias("n"), S.is_vertical_sum(L("=SUM(C9:C3)")).alias("o"),
        S.join_targets(F.array(L(" a "), L(""), L("b"))).alias("p"), S.department_srid(L("2A")).alias("q"), S.department_srid(L("974")).alias("r"), S.department_srid(L("999")).alias("s"),
        S.euros(L(-1234.0)).alias("t"), S.euros(L(None).cast("double")).alias("u"), S.euros(L(12345.0), signed=True, short=True).alias("v"), S.percent(L(0.256)).alias("w"),
        S.cell_text(L("0.30000000000000004"), L("0.00")).alias("x"), S.cell_text(L("a|b"), L("@")).alias("y"), S.cell_text(L("0.25"), L("0%")).alias("z"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("ug1", None, ["ug2", "ug1"], "TU 3", "x-1", "Ete_a_l_ile", "-")
    assert (r.h, r.i, r.j, str(r.k), r.l) == (dt.date(2024, 2, 29), None, 9, "2.35", '{"a": {"b": 1}}')
    assert (r.m, r.n, r.o, r.p, r.q, r.r, r.s) == (True, False, False, "a|b", 2154, 2975, None)
    assert (r.t, r.u, r.v, r.w) == ("-1\u202f234\u202f€", "—", "+12,3 k€", "25,6\u202f%")
    assert (r.x, r.y, r.z) == ("0.3", "a\\|b", "25.0%")


@pytest.mark.parametrize("role, org, expected", [("controleur", None, 3), ("admin", 1, 3), ("operateur", 1, 2), ("operateur", None, 0)])
def test_access(spark, role, org, expected):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "organisation_id int")
    assert rows.filter(portfolio.peut_voir(role, org)).count() == expected


def test_variance(spark):
    rows = [
        (1, "supprime", 2020, 2020, 100, 100), (2, "planifie", 2021, 2020, 90, 80), (3, "planifie", 2020, None, None, 50), (4, "planifie", 2020, 2020, 100, 120),
    ]
    table = spark.createDataFrame(rows, "id int, statut string, annee int, annee_initiale int, montant_initial int, montant_ht int").withColumn("projet_id", F.lit(1))
    for c in ("montant_initial", "montant_ht"):
        table = table.withColumn(c, F.col(c).cast("decimal(18,2)"))
    r = budget.budget_ecarts(table).first()
    assert [int(x) for x in (r.annule, r.glisse_sortant, r.ajoute, r.revision_prix)] == [100, 80, 50, 20]


def test_a_decision_in_the_future_owes_nothing(spark):
    from ledgerloom.operators.signals import annees_obligation

    projects = spark.createDataFrame([(1, 1, dt.date(2027, 1, 1), None, "actif"), (2, 1, dt.date(2024, 5, 1), None, "actif")], "id int, organisation_id int, date_decision date, date_fin date, statut string")
    got = annees_obligation(projects, dt.date(2026, 3, 1)).collect()
    assert sorted((r.projet_id, r.annee) for r in got) == [(2, 2024), (2, 2025)]


POLYGON = ("Polygon", False, False)


def export_row(**changes):
    row = dict(id=1, nom="Projet", cibles=["Eau", "Sol"], description="d", decision="arrêté", refei="r", categorie="C1.1.a", departement="34", geoms=[POLYGON], hash_verse=None, hash_courant="h", nb_parties=1)
    return {**row, **changes}


EXPORT = ("id int, nom string, cibles array<string>, description string, decision string, refei string, categorie string, departement string, "
          "geoms array<struct<type_geom:string,invalide:boolean,reparee:boolean>>, hash_verse string, hash_courant string, nb_parties int")


@pytest.mark.parametrize(
    "changes, codes, decision",
    [
        ({}, [], "exporter"), ({"geoms": []}, ["E01"], "bloque"), ({"geoms": [("Point", False, False)]}, ["E01", "E02"], "bloque"), ({"geoms": [POLYGON, ("Polygon", True, False)]}, ["E03"], "bloque"),
        ({"departement": "999"}, ["E04"], "bloque"), ({"nom": " "}, ["E05"], "bloque"), ({"categorie": None}, ["E06"], "bloque"), ({"categorie": "Z9.9.z"}, ["E07"], "bloque"), ({"cibles": None}, ["E08"], "bloque"),
        ({"cibles": ["Eau", "feu"]}, ["E09"], "bloque"), ({"nom": "n" * 51}, ["W01"], "exporter"), ({"description": "d" * 255}, ["W02"], "exporter"), ({"refei": None}, ["W03"], "exporter"),
        ({"geoms": [("MultiPolygon", False, True)]}, ["W04"], "exporter"), ({"categorie": "C1"}, ["W06"], "exporter"), ({"hash_verse": "h"}, ["W07"], "a_confirmer"), ({"hash_verse": "g"}, ["W08"], "exporter"), ({"nb_parties": 2}, ["W09"], "exporter"),
    ],
)
def test_export_checks(spark, changes, codes, decision):
    table = spark.createDataFrame([tuple(export_row(**changes).values())], EXPORT)
    found = export_check.controler(table, ["C1.1.a", "C1"])
    assert sorted(r.code for r in found.collect()) == codes
    assert export_check.decider(table, found).first().decision == decision
    assert export_check.decider(table, found, confirmed=True).first().decision == ("bloque" if decision == "bloque" else "exporter")


def test_export_of_the_geometry_alone_asks_for_no_attributes(spark):
    table = spark.createDataFrame([tuple(export_row(nom=None, cibles=None, categorie=None, refei=None).values())], EXPORT)
    assert export_check.controler(table, [], mode="geometrie_seule").count() == 0
    assert export_check.attributs(table, "geometrie_seule").first().asDict() == {"id": 1, "numero": "1", **{k: "-" for k in ("nom", "description", "decision", "refei", "categorie", "cible")}}


def test_export_attributes_and_parts(spark):
    r = export_check.attributs(spark.createDataFrame([tuple(export_row(nom="n" * 60, refei=" ").values())], EXPORT)).first()
    assert (len(r.nom), r.cible, r.refei) == (50, "Eau|Sol", "-")
    parts = spark.createDataFrame([(1, ["p", "q"]), (2, [])], "id int, polygones array<string>")
    assert [(r.id, r.numero) for r in export_check.parties(parts, "explode").orderBy("numero").collect()] == [(1, 1), (1, 2)]
    assert [(r.id, r.numero, r.polygones) for r in export_check.parties(parts, "multi").collect()] == [(1, 1, ["p", "q"])]


def test_display(spark):
    L = F.lit
    r = one(spark, S.summary_sentence(L(2024), L(0.5), L(None).cast("double"), L(1500.0), L(0.0), L(None).cast("double")).alias("a"), S.journal_value(L("12000"), L("montant_ht")).alias("b"),
            S.journal_value(L("realise"), L("statut")).alias("c"), S.journal_value(L(""), L("statut")).alias("d"), S.label(L("x"), S.CHAMP_LABELS).alias("e"), S.french_date(L(dt.datetime(2024, 2, 3, 4, 5)), True).alias("f"))
    assert r.a == "En 2024, 50,0\u202f% du budget prévu a été facturé. Sur l'exercice, 1\u202f500\u202f€ ont été reportés sur un autre exercice."
    assert (r.b, r.c, r.d, r.e, r.f) == ("12\u202f000\u202f€", "Réalisée", "—", "x", "03/02/2024 à 04h05")


def test_geometry(spark):
    ring = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 200D, 'y', 0D), named_struct('x', 200D, 'y', 100D), named_struct('x', 0D, 'y', 100D))")
    r = one(spark, geo.surface_ha(F.array(ring)).alias("ha"), geo.mercator_to_lonlat(F.expr("array(named_struct('x', 20037508.342789244D, 'y', 0D))"))[0].alias("p"), geo.ring_area(F.slice(ring, 1, 2)).alias("none"),
            geo.kind_of(F.lit("MultiPolygon"), F.lit(False)).alias("k"), geo.kind_of(F.lit("Point"), F.lit(True)).alias("e"))
    assert (r.ha, round(r.p.lon, 6), round(r.p.lat, 6), r.none, r.k, r.e) == (2.0, 180.0, 0.0, 0.0, "surf", "emprise")
    rows = spark.createDataFrame([(1, "Point", ["0,0"], {"_x": "1", "nom": "a"})], "id int, geometry_type string, points array<string>, properties map<string,string>")
    assert geo.feature(rows).first().feature.properties == {"nom": "a"}


def test_json_sources(spark):
    raw = spark.createDataFrame([(1, '[{"cle": "a"}]'), (2, '{"occurrences": [{"cle": "b"}, {"cle": "c"}]}')], "f int, json string")
    assert sorted(r.cle for r in readers.wrapped_or_list(raw, "json", "occurrences", "struct<cle:string>").collect()) == ["a", "b", "c"]
    budgets = spark.createDataFrame([(json.dumps({"cartographie": {}, "extraction": {"lignes": [{"libelle_prestation": "x", "montant_ht": 2}]}}),), (json.dumps({"lignes": [{"libelle_prestation": "y"}]}),)], "json string")
    assert sorted(r.libelle_prestation for r in readers.budget_lines(budgets).collect()) == ["x", "y"]
    geojson = spark.createDataFrame([('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point"},"properties":{"n":"1"}},{"type":"Feature","geometry":null,"properties":{}}]}',),
                                     ('{"type":"Feature","geometry":{"type":"Point"},"properties":{"n":"2"}}',)], "json string")
    assert sorted((r.feature_index, r.properties.get("n")) for r in readers.geojson_features(geojson).collect() if r.properties) == [(0, "1"), (0, "2")]
    themes = spark.createDataFrame([(json.dumps({"familles": [{"code": "R", "label": "Réduire", "groupes": [{"id": "g", "label": "G", "mesures": [{"code": "R1", "intitule": "un"}, {"code": "R2", "intitule": "deux"}]}]}]}),)], "json string")
    measures = readers.catalogue(themes)
    assert sorted(r.code for r in measures.collect()) == ["R1", "R2"]
    assert readers.catalogue_text(measures).first().texte == "R - Réduire\n    R1 : un\n    R2 : deux"


def test_records_are_validated(spark):
    good = {"cle": "a", "code_operation": " tu 1 ", "recurrence": {"type": "ponctuel"}, "unites_gestion": ["ug1"]}
    rows = [good, {**good, "cle": None}, {**good, "recurrence": {"type": "parfois"}}, {**good, "confiance": 2.0}]
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("not json",)], "json string")
    valid, rejected = readers.validate_rules(raw)
    r = valid.first()
    assert (valid.count(), rejected.count()) == (1, 4)
    assert (r.code_operation, r.ug_ids, r.confiance) == ("TU1", ["ug1"], 0.0)


def test_sheet_is_flattened(spark):
    cells = spark.createDataFrame(
        [("s", 1, 1, "Titre", True, 1, 0, False), ("s", 1, 3, None, True, 1, 1, False), ("s", 2, 1, "5", False, 2, 0, False), ("s", 2, 3, None, False, 2, 1, False), ("s", 3, 3, "9", False, None, None, True), ("s", 4, 2, "", True, None, None, False)],
        "sheet string, row int, col int, value string, is_text boolean, merge_id int, merge_rank int, is_sum boolean")
    got = {r.row: r.ligne for r in readers.flatten_sheet(cells).collect()}
    assert got == {1: "Titre | Titre", 2: "5 | ", 3: " | 9 [TOTAL?]"}


def test_changes_without_author_carry_empty_text(spark):
    schema = "id int, projet_id int, annee int, statut string, montant_ht int, montant_engage int, montant_realise int"
    old = spark.createDataFrame([(1, 9, 2020, "planifie", 1, None, None)], schema)
    new = spark.createDataFrame([(1, 9, 2021, "planifie", 1, None, 5)], schema)
    got = sorted((r.champ, r.ancienne_val, r.nouvelle_val, r.motif, r.modifie_par) for r in mutations.capture_changes(old, new).collect())
    assert got == [("annee", "2020", "2021", "", ""), ("montant_realise", None, "5", "", "")]
    assert mutations.capture_changes(old, old).count() == 0


def test_refused_columns(spark):
    with pytest.raises(ValueError):
        mutations.update_where(spark.range(1), F.lit(True), {"id": F.lit(2)}, {"statut"})


def test_forced_validation(spark):
    drafts = spark.createDataFrame([(1, 1, "brouillon", None), (2, 2, "brouillon", None), (3, 1, "valide", None)], "id int, projet_id int, statut string, valide_le timestamp_ntz")
    checks = spark.createDataFrame([(1, "bloquant")], "projet_id int, niveau string")
    now = dt.datetime(2020, 1, 1)
    assert {r.id: r.decision for r in report.valider(drafts, checks, False, now).collect()} == {1: "refuse", 2: "valide", 3: "inchange"}
    assert {r.id: r.statut for r in report.valider(drafts, checks, True, now).collect()} == {1: "valide", 2: "valide", 3: "valide"}


def test_mock_is_seeded(spark):
    a = readers.mock_occurrences(spark, 200, 2015, 2030, 2020).collect()
    assert a == readers.mock_occurrences(spark, 200, 2015, 2030, 2020).collect() and len({r.annee for r in a}) > 8
    assert all(r.montant_realise is None for r in a if r.statut != "realise")


def test_parameters_are_bound(spark):
    spark.range(5).createOrReplaceTempView("cinq")
    assert readers.read_parametrised(spark, "select * from cinq where id >= :bas", bas=3).count() == 2
