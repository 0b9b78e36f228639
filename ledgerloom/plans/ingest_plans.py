"""Queries on files, staged loads and seeds, with their oracles.

The files are made from the driver's tables, as JSON or cells, and read back by
the readers; the oracles state what must come out, from the tables alone.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import geo, ingestion, mutations
from ledgerloom.plans.oracles import SQL_VIEWS
from ledgerloom.plans.report_plans import simple
from ledgerloom.session import materialise, shared_folder, ship_package
from ledgerloom.sources import readers
from ledgerloom.sources.domain import AS_OF, Domain


def _bound(d: Domain) -> DataFrame:
    d.raw("customer").createOrReplaceTempView("clients_a_lire")
    return readers.read_parametrised(d.spark, "SELECT c_custkey AS id, c_name AS nom FROM clients_a_lire WHERE c_acctbal >= :bas AND c_mktsegment = :segment", bas=1000.0, segment="BUILDING")


simple("s01_requete_parametree", "SELECT c_custkey AS id, c_name AS nom FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment = 'BUILDING'", _bound)

# Extraction records: rules as JSON, some of them broken in one way each.
_CLE = "CASE WHEN id % 11 <> 0 THEN cle END"
_TYPE = "CASE WHEN id % 7 = 0 THEN 'parfois' ELSE type END"
_SURE = "CASE WHEN id % 13 = 0 THEN confiance + 1 WHEN id % 13 = 1 THEN confiance - 1 ELSE confiance END"
SQL_VIEWS["v_extraits"] = f"""SELECT id, {_CLE} AS cle, code_operation, libelle, {_TYPE} AS type, {_SURE} AS confiance, unites, CASE WHEN id % 17 = 0 OR {_CLE} IS NULL THEN 'cle absente'
    WHEN {_TYPE} = 'parfois' THEN 'type de recurrence inconnu' WHEN {_SURE} > 1 OR {_SURE} < 0 THEN 'confiance hors de 0..1' END AS motif_rejet FROM d_echeance"""


def _records(d: Domain) -> tuple[DataFrame, DataFrame]:
    record = F.to_json(F.struct(
        F.expr(_CLE).alias("cle"), "code_operation", "libelle", F.expr("CASE WHEN id % 3 = 0 THEN unites END").alias("ug_ids"), F.expr("CASE WHEN id % 3 = 1 THEN unites END").alias("unites_gestion"),
        F.struct(F.expr(_TYPE).alias("type"), "intervalle_ans", "paliers").alias("recurrence"), F.expr(_SURE).alias("confiance")))
    return readers.validate_rules(d.echeance.select("id", F.when(F.col("id") % 17 == 0, "pas de JSON").otherwise(record).alias("json")))


simple("t24_extraits_valides", """SELECT id, cle, upper(replace(code_operation, ' ', '')) AS code_operation, libelle, CASE WHEN id % 3 = 2 THEN '' ELSE array_to_string(unites, ',') END AS ug_ids,
    coalesce(confiance, 0) AS confiance, type FROM v_extraits WHERE motif_rejet IS NULL""", lambda d: _records(d)[0].withColumn("ug_ids", F.array_join("ug_ids", ",")))
simple("t24_extraits_rejetes", "SELECT id, motif_rejet FROM v_extraits WHERE motif_rejet IS NOT NULL", lambda d: _records(d)[1].select("id", "motif_rejet"))


def _wrapped(d: Domain) -> DataFrame:
    items = F.expr("transform(CASE WHEN c_custkey % 4 = 0 THEN array() ELSE sequence(1, CAST(c_custkey % 4 AS INT)) END, j -> named_struct('cle', concat(c_custkey, '-', j), 'annee', 2000 + j))")
    both = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), F.to_json(items))).otherwise(F.to_json(F.struct(items.alias("occurrences"))))
    return readers.wrapped_or_list(d.raw("customer").select(F.col("c_custkey").alias("id"), both.alias("json")), "json", "occurrences", "struct<cle:string,annee:int>")


simple("s05_objet_ou_liste", "SELECT c_custkey AS id, c_custkey || '-' || j AS cle, CAST(2000 + j AS INTEGER) AS annee FROM (SELECT c_custkey, unnest(range(1, c_custkey % 4 + 1)) AS j FROM customer)", _wrapped)

# Budget files: one per order, its lines those of the order, in either accepted shape.
_LABEL = "CASE WHEN l_linenumber % 5 = 0 THEN ' ' WHEN l_linenumber % 5 <> 1 THEN concat('Lot ', l_suppkey) END"
_TOTAL = "CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag = 'R' END"
SQL_VIEWS["v_lignes_budget"] = f"""SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1 AS INTEGER) AS rang, {_LABEL} AS libelle_prestation,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS montant_ht, l_linestatus AS feuille, {_TOTAL} AS est_total, [CAST(l_linenumber AS VARCHAR), 'L' || l_linenumber] AS source_lignes FROM lineitem"""


def _budget_lines(d: Domain) -> DataFrame:
    line = F.struct(
        *[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")], F.expr(_LABEL).alias("libelle_prestation"), F.col("l_extendedprice").cast("decimal(18,2)").alias("montant_ht"),
        F.col("l_linestatus").alias("feuille"), F.expr(_TOTAL).alias("est_total"), F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("L"), "l_linenumber")).alias("source_lignes"))
    files = d.raw("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("lignes"))
    shape = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.struct(F.lit(1).alias("pages")).alias("cartographie"), F.struct("lignes").alias("extraction")))).otherwise(F.to_json(F.struct("lignes")))
    return readers.budget_lines(files.select("id", shape.alias("json")))


simple("s06_lignes_budget", "SELECT id, rang, libelle_prestation, CAST(montant_ht AS DOUBLE) AS montant_ht, feuille, est_total, array_to_string(source_lignes, ',') AS source_lignes FROM v_lignes_budget",
       lambda d: _budget_lines(d).withColumns({"montant_ht": F.col("montant_ht").cast("double"), "source_lignes": F.array_join("source_lignes", ",")}))
_TEXT = "coalesce('\"' || {} || '\"', 'null')"
simple("k24_lignes_budget", f"""SELECT CAST(7 AS INTEGER) AS projet_id, rang, coalesce(nullif(trim(libelle_prestation), ''), '(sans libellé)') AS libelle_prestation, CAST(montant_ht AS DOUBLE) AS montant_ht, feuille, coalesce(est_total, false) AS est_total,
    source_lignes[1] AS source_lignes, sha256('{{"est_total":' || coalesce(CAST(est_total AS VARCHAR), 'null') || ',"feuille":' || {_TEXT.format('feuille')} || ',"id":' || id || ',"libelle_prestation":' || {_TEXT.format('libelle_prestation')}
    || ',"montant_ht":' || montant_ht || ',"rang":' || rang || ',"source_lignes":["' || array_to_string(source_lignes, '","') || '"]}}') AS empreinte FROM v_lignes_budget""",
       lambda d: ingestion.budget_rows(_budget_lines(d), 7).withColumns({"montant_ht": F.col("montant_ht").cast("double"), "source_lignes": F.array_join("source_lignes", ",")}))

# Geometry uploads: collections of up to three features, single features, and other JSON.
_KINDS = ["MultiPolygon", "LineString", "Point"]
SQL_VIEWS["v_features"] = f"""SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE j END AS INTEGER) AS feature_index, ({_KINDS})[(c_custkey + j) % 3 + 1] AS forme, c_custkey || '/' || j AS nom
    FROM (SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN [0] WHEN 1 THEN range(0, c_custkey % 4) ELSE [] END) AS j FROM customer)"""


def _features(d: Domain) -> DataFrame:
    one = f"""named_struct('type', 'Feature', 'geometry', named_struct('type', element_at(array({', '.join(map(repr, _KINDS))}), CAST((c_custkey + j) % 3 + 1 AS INT)), 'coordinates', array(1.5D, j)),
        'properties', named_struct('nom', concat(c_custkey, '/', j), 'rang', j))"""
    indexes = "CASE WHEN c_custkey % 4 = 0 THEN array() ELSE sequence(0, CAST(c_custkey % 4 AS INT) - 1) END"
    text = f"""CASE c_custkey % 3 WHEN 0 THEN to_json(transform(array(0), j -> {one})[0]) WHEN 1 THEN to_json(named_struct('type', 'FeatureCollection', 'features', transform({indexes}, j -> {one})))
        ELSE '{{"type": "Topology"}}' END"""
    rows = readers.geojson_features(d.raw("customer").select(F.col("c_custkey").alias("id"), F.expr(text).alias("json")))
    return rows.select("id", "feature_index", F.get_json_object("geometry", "$.type").alias("forme"), F.col("properties")["nom"].alias("nom"))


simple("s08_features_geojson", "SELECT id, feature_index, forme, nom FROM v_features", _features)
simple("k25_couches", """SELECT id, feature_index, nom, CASE WHEN id % 5 = 0 THEN 'emprise' WHEN forme = 'Point' THEN 'pct' WHEN forme = 'LineString' THEN 'lin' ELSE 'surf' END AS couche FROM v_features""",
       lambda d: materialise(_features(d).select("id", "feature_index", "nom", geo.kind_of(F.col("forme"), F.col("id") % 5 == 0).alias("couche")), "couches", ("couche",)))

# A catalogue file: regions as families, nations as groups, three measures in each.
SQL_VIEWS["v_mesures"] = """SELECT r_name AS famille, 'Famille ' || r_name AS famille_label, 'g' || n_nationkey AS groupe, n_name || '.' || j AS code, 'Mesure ' || j || ' é' AS intitule
    FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES (1), (2), (3)) t(j)"""


def _measures(d: Domain) -> DataFrame:
    measures = F.expr("transform(array(1, 2, 3), j -> named_struct('code', concat(n_name, '.', j), 'intitule', concat('Mesure ', j, ' é')))")
    nation = d.raw("nation").select("n_regionkey", F.struct(F.concat(F.lit("g"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), measures.alias("mesures")).alias("g"))
    groups = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("g").alias("groupes"))
    family = F.struct(F.col("r_name").alias("code"), F.concat(F.lit("Famille "), "r_name").alias("label"), "groupes")
    return readers.catalogue(d.raw("region").join(groups, "r_regionkey").select(F.to_json(F.struct(F.array(family).alias("familles"))).alias("json")))  # a file per family


simple("s13_catalogue", "SELECT famille, famille_label, groupe, code, intitule FROM v_mesures", _measures)
simple("c40_catalogue_en_texte", "SELECT famille, famille || ' - ' || famille_label || chr(10) || string_agg('    ' || code || ' : ' || intitule, chr(10) ORDER BY '    ' || code || ' : ' || intitule) AS texte FROM v_mesures GROUP BY famille, famille_label",
       lambda d: readers.catalogue_text(_measures(d)))

# One sheet per order: a title merged over two columns, a merged number, an empty column, a sum.
_CELL = """CASE WHEN ligne = 1 AND col = 1 AND o_orderkey % 3 <> 0 THEN concat('T', o_orderkey) WHEN ligne = 2 AND col = 1 AND o_orderkey % 2 <> 0 THEN o_orderstatus WHEN ligne = 2 AND col = 4 AND o_orderkey % 2 <> 0 THEN '3'
    WHEN ligne = 3 AND col = 1 THEN '5' WHEN ligne = 3 AND col = 4 THEN CAST(o_orderkey AS STRING) WHEN col = 3 THEN '' END"""


def sheet_cells(d: Domain) -> DataFrame:
    grid = d.raw("orders").select("o_orderkey", "o_orderstatus", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).withColumns({"ligne": F.expr("CAST(k div 4 + 1 AS INT)"), "col": F.expr("CAST(k % 4 + 1 AS INT)")})
    merged = (F.col("ligne") != 2) & (F.col("col") <= 2)
    return grid.select(
        F.concat(F.lit("s"), "o_orderkey").alias("sheet"), F.col("ligne").alias("row"), "col", F.expr(_CELL).alias("value"), (F.col("ligne") == 1).alias("is_text"),
        F.when(merged, F.col("ligne")).alias("merge_id"), F.when(merged, F.col("col") - 1).alias("merge_rank"), ((F.col("ligne") == 3) & (F.col("col") == 4)).alias("is_sum"))


SHEETS_SQL = """SELECT 's' || o_orderkey AS sheet, CAST(l AS INTEGER) AS row, CASE l WHEN 1 THEN concat('T', o_orderkey, ' | T', o_orderkey, ' | ') WHEN 2 THEN o_orderstatus || vide || ' | 3' ELSE '5' || vide || ' | ' || o_orderkey || ' [TOTAL?]' END AS ligne
    FROM (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN ' | ' ELSE '' END AS vide FROM orders, (VALUES (1), (2), (3)) t(l)) WHERE l = 3 OR (l = 1 AND o_orderkey % 3 <> 0) OR (l = 2 AND o_orderkey % 2 <> 0)"""
simple("t28_feuilles", SHEETS_SQL, lambda d: readers.flatten_sheet(sheet_cells(d)))


def _draw(salt: int) -> str:
    return f"(CAST('0x' || substr(md5(id || ':1:{salt}'), 1, 6) AS INTEGER) % 1000 / 1000.0::DOUBLE)"


simple("t32_occurrences_fictives", f"""SELECT id, annee, CAST(montant_ht AS DOUBLE) AS montant_ht, statut, CASE WHEN statut IN ('realise', 'en_cours') THEN CAST(montant_ht AS DOUBLE) END AS montant_engage,
    CASE WHEN statut = 'realise' THEN CAST(round(montant_ht * CAST(0.9::DOUBLE + {_draw(4)} * 0.2::DOUBLE AS DECIMAL(6,3)), 2) AS DOUBLE) END AS montant_realise
    FROM (SELECT *, CASE WHEN annee < 2020 THEN CASE WHEN {_draw(3)} < 0.8::DOUBLE THEN 'realise' WHEN {_draw(3)} < 0.9::DOUBLE THEN 'repousse' ELSE 'en_cours' END
        WHEN annee = 2020 AND {_draw(3)} < 0.4::DOUBLE THEN 'en_cours' ELSE 'planifie' END AS statut
    FROM (SELECT id, CAST(2015 + floor({_draw(1)} * 16) AS INTEGER) AS annee, CAST(round(500 + {_draw(2)} * 20000, 2) AS DECIMAL(18,2)) AS montant_ht FROM (SELECT p_partkey AS id FROM part)))""",
       lambda d: readers.mock_for(d.raw("part").select(F.col("p_partkey").alias("id")), 2015, 2030, 2020).withColumns({c: F.col(c).cast("double") for c in ("montant_ht", "montant_engage", "montant_realise")}))

# A load over the domain: known projects get new metadata and sheets, rules keep what users edited.
_NEW_YEAR = "CAST(1990 + o_orderkey % 20 AS INT)"
_NEW_RULE = "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 400 END"
SQL_VIEWS["v_recues"] = f"SELECT o_orderkey + 100000000000 AS id, {_NEW_RULE} AS echeance_id, {_NEW_YEAR} AS annee, CASE WHEN o_orderkey % 4 = 0 THEN 'manuel' ELSE 'ia' END AS origine FROM orders"
SQL_VIEWS["v_amorce"] = """SELECT id, echeance_id, annee, origine FROM d_occurrence UNION ALL SELECT id, echeance_id, annee, origine FROM v_recues WHERE origine <> 'ia' OR echeance_id IS NULL UNION ALL
    SELECT min(id), echeance_id, annee, 'ia' FROM v_recues r WHERE origine = 'ia' AND echeance_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_occurrence o WHERE o.origine = 'ia' AND o.echeance_id = r.echeance_id AND o.annee = r.annee) GROUP BY 2, 3"""


def _load(d: Domain) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    rule = d.echeance.select("projet_id", "cle", "code_operation", "libelle", F.lit("01-01").alias("fenetre_debut"), F.lit("02-01").alias("fenetre_fin"))
    tables = {"metadata": d.projet.select(F.col("id").alias("projet_id"), "nom"), "fiche": d.fiche.select("projet_id", "cle", "titre"), "echeance": rule, "occurrence": d.occurrence.select("id", "echeance_id", "annee", "origine", "modifie_le")}
    incoming = {
        "metadata": d.raw("supplier").select(F.expr("s_suppkey * 3").alias("projet_id"), F.col("s_name").alias("nom")),
        "fiche": d.raw("part").select(F.expr("p_partkey % 100").alias("projet_id"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('A', p_partkey) ELSE concat('B', p_partkey) END").alias("cle"), F.col("p_brand").alias("titre")),
        "echeance": d.raw("part").select(F.expr("p_partkey % 100").alias("projet_id"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('E', p_partkey) ELSE concat('F', p_partkey) END").alias("cle"), F.lit("neuf").alias("code_operation"),
                                         F.col("p_brand").alias("libelle"), F.lit("03-01").alias("fenetre_debut"), F.lit("04-01").alias("fenetre_fin")),
        "occurrence": d.raw("orders").select(F.expr("o_orderkey + 100000000000").alias("id"), F.expr(_NEW_RULE).alias("echeance_id"), F.expr(_NEW_YEAR).alias("annee"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'manuel' ELSE 'ia' END").alias("origine"), F.lit(None).cast("timestamp_ntz").alias("modifie_le")),
    }
    return tables, incoming, ingestion.seed(tables, incoming, replace=False)


simple("k01_metadonnees", "SELECT coalesce(p.id, s_suppkey * 3) AS projet_id, coalesce(s_name, nom) AS nom FROM d_projet p FULL JOIN supplier ON p.id = s_suppkey * 3", lambda d: _load(d)[2]["metadata"])
simple("k01_fiches", """SELECT projet_id, cle, CASE WHEN p_brand IS NULL THEN titre ELSE p_brand END AS titre FROM d_fiche LEFT JOIN part ON p_partkey = id AND id % 2 = 0
    UNION ALL SELECT p_partkey % 100, 'B' || p_partkey, p_brand FROM part WHERE p_partkey % 2 = 1""", lambda d: _load(d)[2]["fiche"])
simple("k01_regles", """SELECT projet_id, cle, code_operation, CASE WHEN p_brand IS NULL THEN libelle ELSE p_brand END AS libelle, '01-01' AS fenetre_debut, '02-01' AS fenetre_fin FROM d_echeance LEFT JOIN part ON p_partkey = id AND id % 2 = 0
    UNION ALL SELECT p_partkey % 100, 'F' || p_partkey, 'neuf', p_brand, '03-01', '04-01' FROM part WHERE p_partkey % 2 = 1""", lambda d: _load(d)[2]["echeance"])
simple("k01_occurrences", "SELECT id, echeance_id, annee, origine FROM v_amorce", lambda d: _load(d)[2]["occurrence"].drop("modifie_le"))


def _counted(d: Domain) -> DataFrame:
    tables, incoming, after = _load(d)
    return ingestion.import_counters(*[t["occurrence"] for t in (tables, incoming, after)])


simple("k01_compteurs", "SELECT (SELECT count(*) FROM v_recues) AS recues, (SELECT count(*) FROM v_amorce) - (SELECT count(*) FROM d_occurrence) AS inserees, (SELECT count(*) FROM v_recues) + (SELECT count(*) FROM d_occurrence) - (SELECT count(*) FROM v_amorce) AS ignorees", _counted)

simple("k37_projets_extraits", """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'Opération' ELSE 'Projet sans nom' END AS nom, CASE WHEN c_custkey % 4 = 0 THEN 'R' || c_custkey ELSE 'REF-20000630' END AS reference_interne,
    CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS commune, CAST(CASE WHEN c_custkey % 6 = 0 THEN 9 WHEN c_custkey % 6 < 4 THEN c_custkey % 6 + 1 END AS INTEGER) AS duree_annees FROM customer""",
       lambda d: ingestion.project_from_metadata(d.raw("customer").select(
           F.col("c_custkey").alias("id"), F.expr("CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN ' ' END").alias("nom"), F.expr("CASE c_custkey % 3 WHEN 1 THEN ' Opération ' ELSE '' END").alias("nom_operation"),
           F.expr("CASE WHEN c_custkey % 4 = 0 THEN concat('R', c_custkey) WHEN c_custkey % 4 = 1 THEN ' ' END").alias("reference_interne"), F.expr("CASE WHEN c_custkey % 5 <> 0 THEN array(c_mktsegment, 'autre') ELSE array() END").alias("communes"),
           F.expr("CASE WHEN c_custkey % 6 = 0 THEN 9 END").alias("duree_ans"), F.lit(2000).alias("annee_debut"), F.expr("CASE WHEN c_custkey % 6 < 4 THEN 2000 + c_custkey % 6 END").alias("annee_fin")), AS_OF, keep=("id",)))


def _evolved(d: Domain) -> DataFrame:
    table = d.projet.select("id", "nom", "reference_interne", "commune", F.expr("CASE WHEN id % 2 = 0 THEN concat('u', id) END").alias("unites"), F.expr("CASE WHEN id % 3 = 0 THEN 'ug' END").alias("ug"))
    steps = ({"reference_interne": "reference", "unites": "ug"}, {"theme": "string", "nom": "string"}, ("commune", "absente"))
    return ingestion.evolve(ingestion.evolve(table, *steps), *steps)


simple("k36_schema_evolue", "SELECT id, nom, reference_interne AS reference, CASE WHEN id % 3 = 0 THEN 'ug' WHEN id % 2 = 0 THEN 'u' || id END AS ug, CAST(NULL AS VARCHAR) AS theme FROM d_projet", _evolved)
simple("k38_projets_fictifs", "SELECT coalesce(p.id, s_suppkey * 40) AS id, coalesce(s_name, p.nom) AS nom, p.statut FROM d_projet p FULL JOIN supplier ON s_suppkey * 40 = p.id",
       lambda d: mutations.upsert(d.projet.select("id", "nom", "statut"), d.raw("supplier").select(F.expr("s_suppkey * 40").alias("id"), F.col("s_name").alias("nom")), ["id"]))


def _staged(d: Domain) -> ingestion.StagedRun:
    """A run whose second stage fails at first and is resumed; the first one is not made again."""
    run = ingestion.StagedRun(d.spark, f"{shared_folder(d.spark)}/ledgerloom-etapes-{uuid.uuid4().hex}", "r1")

    def lost() -> DataFrame:
        raise OSError("perdu")

    run.stage("regles", lambda: d.echeance.select("id", "projet_id", "type"))
    for make in (lost, lambda: run.stage("regles", lost).groupBy("type").agg(F.count("*").alias("nb"))):
        try:
            run.stage("types", make)
        except OSError:
            continue
    run.stage("vide", lambda: d.spark.range(0))
    return run


simple("t33_reprise", "SELECT type, count(*) AS nb FROM d_echeance GROUP BY type", lambda d: _staged(d).stage("types", lambda: d.spark.range(0)))
simple("k34_etat_des_etapes", """SELECT * FROM (SELECT 'regles' AS stage, 'done' AS state, '' AS detail, count(*) AS lignes FROM d_echeance UNION ALL SELECT 'types', 'done', '', count(DISTINCT type) FROM d_echeance
    UNION ALL SELECT 'vide', 'done', '', 0)""", lambda d: _staged(d).status(lines=True))


def _read_counter(text: str | None) -> str:
    return str(1000 // (json.loads(text)["k"] % 5))


def _batch(d: Domain) -> DataFrame:
    ship_package(d.spark)
    return ingestion.run_batch(d.raw("events").select(F.col("event_id").alias("id"), "props"), "props", _read_counter).drop("props")


simple("t34_lot", """SELECT id, CASE WHEN k <> 0 THEN CAST(1000 // k AS VARCHAR) END AS resultat, CASE WHEN k = 0 THEN 'ZeroDivisionError: integer division or modulo by zero' END AS erreur
    FROM (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS k FROM events)""", _batch)


def _audited(d: Domain) -> DataFrame:
    row = ingestion.audit("bilan.valider", 7, "rapport", {"b": 1, "a": dt.date(2000, 1, 2).isoformat()}, d.spark)
    return d.rapport.filter("statut = 'valide'").select(F.lit("bilan.figer").alias("action"), "projet_id", F.lit("rapport").alias("cible"), F.concat(F.lit("v"), "version").alias("detail")).unionByName(row)


simple("k23_journal", """SELECT 'bilan.figer' AS action, projet_id, 'rapport' AS cible, 'v' || version AS detail FROM d_rapport WHERE statut = 'valide'
    UNION ALL SELECT 'bilan.valider', 7, 'rapport', '{"a": "2000-01-02", "b": 1}'""", _audited)
