"""Queries on export checks, display, geometry and validated changes, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import dialogue, export_check, geo, mutations
from ledgerloom.plans.oracles import SQL_VIEWS
from ledgerloom.plans.report_plans import simple
from ledgerloom.sources.domain import Domain

CATEGORIES = ["TU", "MR2.1a"]
THIN = S._TYPOGRAPHIC

# What an export is made from, over the customers; the SQL twin is v_export.
_EXPORT = {
    "id": "c_custkey",
    "nom": "CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 5 = 1 THEN repeat(c_name, 4) ELSE c_name END",
    "description": "CASE WHEN c_custkey % 7 = 0 THEN repeat(c_mktsegment, 40) WHEN c_custkey % 7 <> 1 THEN c_mktsegment END",
    "decision": "CASE WHEN c_custkey % 3 <> 0 THEN concat('D', c_custkey) END",
    "refei": "CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE concat('R', c_custkey) END",
    "categorie": "CASE c_custkey % 6 WHEN 1 THEN 'TU' WHEN 2 THEN 'MR2.1a' WHEN 3 THEN ' TU ' WHEN 4 THEN 'inconnue' WHEN 5 THEN '' END",
    "departement": "CASE c_custkey % 4 WHEN 0 THEN ' 2a' WHEN 1 THEN lpad(CAST(c_custkey % 95 + 1 AS STRING), 2, '0') WHEN 2 THEN '974' ELSE 'XX' END",
    "hash_verse": "CASE WHEN c_custkey % 3 <> 0 THEN concat('h', c_custkey % 4) END",
    "hash_courant": "concat('h', c_custkey % 2)",
    "nb_parties": "c_custkey % 3",
}
_TARGETS = "CASE c_custkey % 4 WHEN 1 THEN {0}'Sol'{1} WHEN 2 THEN {0}'Sol', ' Eau ', ''{1} WHEN 3 THEN {0}'Lune', 'Air'{1} END"
SQL_VIEWS["v_export"] = f"SELECT c_custkey AS k, {', '.join(f'{sql} AS {name}' for name, sql in _EXPORT.items())}, {_TARGETS.format('[', ']')} AS cibles FROM customer"


def export_of(d: Domain) -> DataFrame:
    geoms = """transform(CASE WHEN c_custkey % 3 = 0 THEN array() ELSE sequence(1, c_custkey % 3) END, j -> named_struct(
        'type_geom', element_at(array('Polygon', 'MultiPolygon', 'LineString', ''), CAST((c_custkey + j) % 4 + 1 AS INT)),
        'invalide', (c_custkey + j) % 5 = 0, 'reparee', (c_custkey + j) % 7 = 0))"""
    made = [F.expr(sql).alias(name) for name, sql in _EXPORT.items()]
    return d.raw("customer").select(*made, F.expr(_TARGETS.format("array(", ")")).alias("cibles"), F.expr(geoms).alias("geoms"))


def _count(test: str) -> str:
    return f"len([j FOR j IN range(1, k % 3 + 1) IF {test}])"


_KIND = "['polygon', 'multipolygon', 'linestring', ''][(k + j) % 4 + 1]"
_AREAS = "('polygon', 'multipolygon')"
_BLANK = "coalesce(trim({}), '') = ''"
_KNOWN = ", ".join("'" + t.replace("'", "''") + "'" for t in export_check.TARGETS)
_RULES = [
    ("E01", "bloquant", True, f"CAST({_count(f'{_KIND} IN {_AREAS}')} = 0 AS INT)"),
    ("E02", "bloquant", True, _count(f"{_KIND} = 'linestring'")), ("E03", "bloquant", True, _count("(k + j) % 5 = 0")),
    ("E04", "bloquant", True, "CAST(k % 4 = 3 AS INT)"), ("E05", "bloquant", False, f"CAST({_BLANK.format('nom')} AS INT)"),
    ("E06", "bloquant", False, f"CAST({_BLANK.format('categorie')} AS INT)"),
    ("E07", "bloquant", False, f"CAST(NOT ({_BLANK.format('categorie')}) AND trim(categorie) NOT IN ('TU', 'MR2.1a') AS INT)"),
    ("E08", "bloquant", False, "CAST(cibles IS NULL AS INT)"), ("E09", "bloquant", False, f"CAST(len([c FOR c IN coalesce(cibles, []) IF c NOT IN ({_KNOWN})]) > 0 AS INT)"),
    ("W01", "avertissement", False, "CAST(length(trim(nom)) > 50 AS INT)"), ("W02", "avertissement", False, "CAST(coalesce(length(trim(description)) > 254, false) AS INT)"),
    ("W03", "avertissement", False, f"CAST({_BLANK.format('decision')} OR {_BLANK.format('refei')} AS INT)"), ("W04", "avertissement", True, _count("(k + j) % 7 = 0")),
    ("W06", "avertissement", False, f"CAST(NOT ({_BLANK.format('categorie')}) AND length(trim(categorie)) < 6 AS INT)"),
    ("W07", "avertissement", True, "CAST(coalesce(hash_verse = hash_courant, false) AS INT)"), ("W08", "avertissement", True, "CAST(coalesce(hash_verse <> hash_courant, false) AS INT)"),
    ("W09", "avertissement", True, "CAST(nb_parties > 1 AS INT)"),
]


def _found(view: str, alone: bool) -> None:
    parts = [f"SELECT id, '{c}' AS code, '{n}' AS niveau, CAST({sql} AS INTEGER) AS nb FROM v_export" for c, n, always, sql in _RULES if always or not alone]
    SQL_VIEWS[view] = f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE nb > 0"


_found("v_constats", False)
_found("v_constats_geometrie", True)
simple("t25_controles_export", "SELECT id, code, niveau, nb FROM v_constats", lambda d: export_check.controler(export_of(d), CATEGORIES))
simple("t25_controles_geometrie", "SELECT id, code, niveau, nb FROM v_constats_geometrie", lambda d: export_check.controler(export_of(d), CATEGORIES, "geometrie_seule"))


def _fit(name: str) -> str:
    return f"left(coalesce(nullif(trim({name}), ''), '-'), {export_check.WIDTHS[name]}) AS {name}"


_CUT = ["nom", "description", "decision", "refei", "categorie"]
simple("t26_attributs_export", f"""SELECT id, '1' AS numero, {', '.join(map(_fit, _CUT))},
    CASE WHEN cibles IS NULL THEN '-' ELSE array_to_string([trim(c) FOR c IN cibles IF trim(c) <> ''], '|') END AS cible FROM v_export""", lambda d: export_check.attributs(export_of(d)))
simple("t26_attributs_geometrie", f"SELECT id, '1' AS numero, {_fit('nom')}, {', '.join(f'''{export_check.BLANK!r} AS {c}''' for c in [*_CUT[1:], 'cible'])} FROM v_export",
       lambda d: export_check.attributs(export_of(d), "geometrie_seule"))
for _name, _yes in (("t27_decision_export", False), ("t27_decision_confirmee", True)):
    simple(_name, f"""SELECT e.id, CAST(coalesce(sum(CAST(niveau = 'bloquant' AS INT)), 0) AS BIGINT) AS nb_erreurs, CAST(coalesce(sum(CAST(niveau = 'avertissement' AS INT)), 0) AS BIGINT) AS nb_avertissements,
        CASE WHEN coalesce(sum(CAST(niveau = 'bloquant' AS INT)), 0) > 0 THEN 'bloque' WHEN coalesce(bool_or(code = 'W07'), false) AND NOT {_yes} THEN 'a_confirmer' ELSE 'exporter' END AS decision
        FROM v_export e LEFT JOIN v_constats_geometrie c ON c.id = e.id GROUP BY e.id""",
           lambda d, yes=_yes: export_check.decider(export_of(d), export_check.controler(export_of(d), CATEGORIES, "geometrie_seule"), yes))


def _polygons(d: Domain) -> DataFrame:
    return d.raw("customer").select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN array() ELSE sequence(1, CAST(c_custkey % 4 AS INT)) END").alias("polygones"))


simple("g05_parties_eclatees", "SELECT c_custkey AS id, CAST(j AS INTEGER) AS numero, 1 AS nb FROM (SELECT c_custkey, unnest(range(1, c_custkey % 4 + 1)) AS j FROM customer)",
       lambda d: export_check.parties(_polygons(d), "explode").select("id", "numero", F.size("polygones").alias("nb")))
simple("g05_parties_groupees", "SELECT c_custkey AS id, 1 AS numero, CAST(c_custkey % 4 AS INTEGER) AS nb FROM customer WHERE c_custkey % 4 > 0",
       lambda d: export_check.parties(_polygons(d), "multi").select("id", "numero", F.size("polygones").alias("nb")))


def _grouped(x: str, decimals: int) -> str:
    return f"replace(replace(format('{{:,.{decimals}f}}', CAST({x} AS DOUBLE)), ',', '{THIN}'), '.', ',')"


def _euros(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN '—' ELSE {_grouped(x, 0)} || '{THIN}€' END)"


def _percent(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN '—' ELSE replace(format('{{:.1f}}', {x} * 100), '.', ',') || '{THIN}%' END)"


_AMOUNT = "CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey * 37 % 200000 - 50000) / 4.0 END"
simple("c23_affichage", f"""SELECT id, {_euros('m')} AS simple, CASE WHEN m > 0 THEN '+' ELSE '' END || {_euros('m')} AS signe,
    CASE WHEN abs(m) >= 10000 THEN regexp_replace({_grouped('m / 1000', 1)}, ',0$', '') || ' k€' ELSE {_euros('m')} END AS court, {_percent('p')} AS taux,
    coalesce(strftime(jour, '%d/%m/%Y'), '—') AS jour, coalesce(strftime(jour, '%d/%m/%Y à %Hh%M'), '—') AS moment
    FROM (SELECT o_orderkey AS id, {_AMOUNT} AS m, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 1000 / 1000.0::DOUBLE END AS p, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS jour FROM orders)""",
       lambda d: d.raw("orders").select(F.col("o_orderkey").alias("id"), F.expr(_AMOUNT).cast("double").alias("m"), F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 1000 / 1000.0D END").alias("p"),
                                        F.expr("CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END").alias("j")).select(
           "id", S.euros(F.col("m")).alias("simple"), S.euros(F.col("m"), signed=True).alias("signe"), S.euros(F.col("m"), short=True).alias("court"), S.percent(F.col("p")).alias("taux"),
           S.french_date(F.col("j")).alias("jour"), S.french_date(F.col("j"), True).alias("moment")))

_RATE = {"e": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 1000 / 1000.0{0} END", "c": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 700 / 1000.0{0} END",
         "g": "o_orderkey % 4 * 1000.0{0}", "a": "o_orderkey % 3 * 250000.0{0}", "n": "o_orderkey % 2 * 12.0{0}"}
# The sentence's words are fixed values: they are those of the report.
simple("c27_phrase", f"""SELECT id, CASE WHEN e IS NULL THEN 'En ' || y || ', aucun budget prévu n''est renseigné' ELSE 'En ' || y || ', ' || {_percent('e')} || ' du budget prévu a été facturé' END
    || CASE WHEN c IS NULL THEN '' ELSE ', ' || {_percent('c')} || ' a été contractualisé' END || '.'
    || CASE WHEN g < 1 AND a < 1 AND n < 1 THEN '' ELSE ' Sur l''exercice, ' || concat_ws(', ', CASE WHEN g >= 1 THEN {_euros('g')} || ' ont été reportés sur un autre exercice' END,
        CASE WHEN a >= 1 THEN {_euros('a')} || ' ont été économisés sur des actions annulées' END,
        CASE WHEN n >= 1 THEN {_euros('n')} || ' correspondent à des actions ajoutées après le figeage du budget de référence' END) || '.' END AS phrase
    FROM (SELECT o_orderkey AS id, year(o_orderdate) AS y, {', '.join(f'{sql.format("::DOUBLE")} AS {k}' for k, sql in _RATE.items())} FROM orders)""",
       lambda d: d.raw("orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y"), *[F.expr(sql.format("D")).alias(k) for k, sql in _RATE.items()]).select(
           "id", S.summary_sentence(*[F.col(c) for c in ("y", "e", "c", "g", "a", "n")]).alias("phrase")))

_CELL = "CASE o_orderkey % 4 WHEN 0 THEN concat('a|b', o_orderkey) WHEN 1 THEN concat(o_orderkey % 1000, '.', lpad(CAST(o_orderkey % 8 * 125 AS STRING), 3, '0')) WHEN 2 THEN concat(o_orderkey % 50, '.3000000001') END"
_FORMAT = "CASE o_orderkey % 3 WHEN 0 THEN '0.00%' WHEN 1 THEN '0 €' ELSE 'General' END"
simple("c24_cellules", f"""SELECT id, CASE WHEN n IS NULL THEN replace(coalesce(v, ''), '|', '\\|') WHEN f LIKE '%\\%%' ESCAPE '\\' THEN CAST(round(n * 100, 4) AS VARCHAR) || '%'
    ELSE CASE WHEN round(n, 6) = floor(round(n, 6)) THEN CAST(CAST(floor(round(n, 6)) AS BIGINT) AS VARCHAR) ELSE CAST(round(n, 6) AS VARCHAR) END || CASE WHEN f LIKE '%€%' THEN ' €' ELSE '' END END AS texte
    FROM (SELECT o_orderkey AS id, {_CELL} AS v, TRY_CAST({_CELL} AS DOUBLE) AS n, {_FORMAT} AS f FROM orders)""",
       lambda d: d.raw("orders").select(F.col("o_orderkey").alias("id"), S.cell_text(F.expr(_CELL), F.expr(_FORMAT)).alias("texte")))
_FORMULA = "CASE o_orderkey % 5 WHEN 0 THEN concat('=SUM(A4:A', o_orderkey % 9, ')') WHEN 1 THEN concat('= somme( $B$2 : $b$', o_orderkey % 7, ' )') WHEN 2 THEN '=SUM(A1:B9)' WHEN 3 THEN concat('=A1+A', o_orderkey) END"
_SUM = r"(?i)^=\s*(?:SUM|SOMME)\(\s*\$?([A-Z]+)\$?(\d+)\s*:\s*\$?([A-Z]+)\$?(\d+)\s*\)$"
simple("c25_sommes", f"""SELECT id, coalesce(p[1] <> '' AND upper(p[1]) = upper(p[3]) AND TRY_CAST(p[4] AS BIGINT) > TRY_CAST(p[2] AS BIGINT), false) AS verticale
    FROM (SELECT id, [{', '.join(f"regexp_extract(f, '{_SUM}', {g})" for g in (1, 2, 3, 4))}] AS p FROM (SELECT o_orderkey AS id, {_FORMULA} AS f FROM orders))""",
       lambda d: d.raw("orders").select(F.col("o_orderkey").alias("id"), S.is_vertical_sum(F.expr(_FORMULA)).alias("verticale")))
simple("c36_cles_publiques", "SELECT c_custkey AS id, array_to_string(list_sort(['nom', c_mktsegment]), ',') AS cles FROM customer",
       lambda d: d.raw("customer").select(F.col("c_custkey").alias("id"), F.array_join(F.array_sort(F.map_keys(S.public_keys(F.create_map(
           F.lit("nom"), "c_name", F.concat(F.lit("_"), "c_name"), F.lit("x"), F.col("c_mktsegment"), F.lit("y"), F.lit("_id"), F.lit("z"))))), ",").alias("cles")))

_WKT = """CASE o_orderkey % 6 WHEN 0 THEN concat('POINT Z (', o_orderkey, ' 2.5 7)') WHEN 1 THEN concat('LineString(', o_orderkey, ' 1, 3  4 )') WHEN 2 THEN concat('POLYGON ((0 0 1, ', o_orderkey, ' 0 1, 5 -5.5 1, 0 0 1))')
    WHEN 3 THEN concat('MULTIPOLYGON Z (((0 0 9, ', o_orderkey, ' 0 9, 1 1 9, 0 0 9)), ((2 2 9, 3 2 9, 3 3 9, 2 2 9)))') WHEN 4 THEN 'POLYGON EMPTY' ELSE 'rien' END"""
simple("g01_wkt_multi", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('MULTIPOINT ((', o_orderkey, ' 2.5))') WHEN 1 THEN concat('MULTILINESTRING ((', o_orderkey, ' 1, 3 4 ))')
    WHEN 2 THEN concat('MULTIPOLYGON (((0 0, ', o_orderkey, ' 0, 5 -5.5, 0 0)))') WHEN 3 THEN concat('MULTIPOLYGON (((0 0, ', o_orderkey, ' 0, 1 1, 0 0)), ((2 2, 3 2, 3 3, 2 2)))') WHEN 4 THEN 'MULTIPOLYGON EMPTY' END AS wkt FROM orders""",
       lambda d: d.raw("orders").select(F.col("o_orderkey").alias("id"), geo.wkt_to_multi(F.expr(_WKT)).alias("wkt")))
_PLACE = {"x": "(o_orderkey % 3600 - 1800) * 10000.0{0}", "y": "(o_orderkey % 3000 - 1500) * 10000.0{0}"}
simple("g02_lon_lat", f"SELECT o_orderkey AS id, round({_PLACE['x'].format('::DOUBLE')} / 6378137.0::DOUBLE * (180 / pi()), 6) AS lon, round((atan(exp({_PLACE['y'].format('::DOUBLE')} / 6378137.0::DOUBLE)) * 2 - pi() / 2) * (180 / pi()), 6) AS lat FROM orders",
       lambda d: d.raw("orders").select(F.col("o_orderkey").alias("id"), geo.mercator_to_lonlat(F.array(F.struct(*[F.expr(sql.format("D")).alias(k) for k, sql in _PLACE.items()])))[0].alias("p"))
       .select("id", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat")))
_RINGS = """array(array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', w, 'y', 0.0D), named_struct('x', w, 'y', h), named_struct('x', 0.0D, 'y', h)),
    array(named_struct('x', 5.0D, 'y', 5.0D), named_struct('x', 5.0D + w, 'y', 5.0D), named_struct('x', 5.0D, 'y', 5.0D + h), named_struct('x', 5.0D, 'y', 5.0D)), array(named_struct('x', 1.0D, 'y', 1.0D)))"""
simple("g04_surfaces", "SELECT o_orderkey AS id, round(((o_orderkey % 97 + 1) * 20.0::DOUBLE * (o_orderkey % 89 + 1) * 10 * 1.5) / 10000, 4) AS surface_ha, true AS ordre_indifferent FROM orders",
       lambda d: d.raw("orders").select(F.col("o_orderkey").alias("id"), F.expr("(o_orderkey % 97 + 1) * 20.0D").alias("w"), F.expr("(o_orderkey % 89 + 1) * 10.0D").alias("h")).withColumn("r", F.expr(_RINGS))
       .select("id", geo.surface_ha(F.col("r")).alias("surface_ha"), (geo.geometry_hash(F.col("r")) == geo.geometry_hash(F.reverse("r"))).alias("ordre_indifferent")))
simple("g06_features", "SELECT o_orderkey AS id, 'Feature' AS type, 'Point' AS geometry_type, 1 AS nb_points, o_orderpriority AS priorite, false AS interne FROM orders",
       lambda d: geo.feature(d.raw("orders").select(F.col("o_orderkey").alias("id"), F.lit("Point").alias("geometry_type"), F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))).alias("points"),
                                                    F.create_map(F.lit("priorite"), "o_orderpriority", F.lit("_interne"), F.lit("x")).alias("properties")))
       .select("id", "feature.type", "feature.geometry.geometry_type", F.size("feature.geometry.points").alias("nb_points"), F.col("feature.properties")["priorite"].alias("priorite"),
               F.array_contains(F.map_keys("feature.properties"), "_interne").alias("interne")))
_FIRST = {"priorite": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END", "client": "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END"}
simple("g07_resume_attributs", f"SELECT o_orderstatus AS couche, count(*) AS nb, {', '.join(f'list({sql} ORDER BY o_orderkey)[1] AS {k}' for k, sql in _FIRST.items())} FROM orders GROUP BY 1",
       lambda d: geo.resume_attributs(d.raw("orders").select(F.col("o_orderstatus").alias("couche"), F.col("o_orderkey").alias("ordre"), F.create_map(
           F.lit("priorite"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END"), F.lit("client"), F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS STRING) ELSE 'NaN' END")).alias("attributs")))
       .select("couche", "nb", F.col("premier")["priorite"].alias("priorite"), F.col("premier")["client"].alias("client")))

# Changes to contractors: every third customer key asks for one, of keys known and unknown.
_OP = "CASE c_custkey % 3 WHEN 0 THEN 'creer' WHEN 1 THEN 'modifier' ELSE 'supprimer' END"
_NAME = "CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 7 <> 0 THEN concat('N', c_custkey) END"
SQL_VIEWS["v_demandes_ecriture"] = f"SELECT c_custkey * 2 AS id, {_OP} AS op, {_NAME} AS nom, c_custkey % 4 <> 0 AS actif FROM customer"
SQL_VIEWS["v_ecritures"] = """SELECT v.*, CASE WHEN op = 'creer' AND p.id IS NOT NULL THEN 'existe' WHEN op <> 'creer' AND p.id IS NULL THEN 'introuvable'
    WHEN op <> 'supprimer' AND trim(v.nom) = '' THEN 'nom_vide' WHEN op = 'creer' AND v.nom IS NULL THEN 'nom_absent' END AS erreur FROM v_demandes_ecriture v LEFT JOIN d_prestataire p ON p.id = v.id"""


def _written(d: Domain) -> tuple[DataFrame, DataFrame]:
    changes = d.raw("customer").select(F.expr("c_custkey * 2").alias("id"), F.expr(_OP).alias("op"), F.expr(_NAME).alias("nom"), F.expr("c_custkey % 4 <> 0").alias("actif"))
    rules = {"nom_vide": F.trim("nom") == "", "nom_absent": (F.col("op") == "creer") & F.col("nom").isNull()}
    return mutations.appliquer(d.prestataire.select("id", "nom", "siret_norm", "actif"), changes, rules)


simple("k29_ecrire", """SELECT coalesce(p.id, e.id) AS id, coalesce(e.nom, p.nom) AS nom, p.siret_norm, coalesce(e.actif, p.actif) AS actif FROM d_prestataire p
    FULL JOIN (SELECT * FROM v_ecritures WHERE erreur IS NULL) e ON e.id = p.id WHERE e.op IS NULL OR e.op <> 'supprimer'""", lambda d: _written(d)[0])
simple("k29_refus", "SELECT id, op, erreur FROM v_ecritures WHERE erreur IS NOT NULL", lambda d: _written(d)[1])

SQL_VIEWS["v_versements"] = "SELECT o_orderkey AS id, o_custkey AS projet_id, CASE WHEN o_orderkey % 3 = 0 THEN 'verse' WHEN o_orderkey % 3 = 1 THEN 'annule' END AS nouveau FROM orders WHERE o_orderkey % 2 = 0"


def _handed_in(d: Domain) -> tuple[DataFrame, DataFrame]:
    export = d.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("projet_id"), F.lit("genere").alias("statut"), F.lit(None).cast("date").alias("verse_le"), F.lit("c").alias("commentaire"))
    patches = d.raw("orders").filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("id"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'verse' WHEN o_orderkey % 3 = 1 THEN 'annule' END").alias("statut"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN DATE '2000-01-31' END").alias("verse_le"), F.lit(None).cast("string").alias("commentaire"))
    projet = d.projet.select("id", F.col("nom").alias("nom_export"), (F.col("id") % 11 == 0).alias("nom_verrouille"))
    return mutations.verser_exports(projet, export, patches)


simple("k30_historique", """SELECT o_orderkey AS id, o_custkey AS projet_id, coalesce(nouveau, 'genere') AS statut, CASE WHEN nouveau = 'verse' THEN DATE '2000-01-31' END AS verse_le, 'c' AS commentaire
    FROM orders LEFT JOIN v_versements v ON v.id = o_orderkey""", lambda d: _handed_in(d)[1])
simple("k30_renommer", """SELECT id, CASE WHEN refus OR nouveau IS NULL THEN nom ELSE nouveau END AS nom_export, verrou AS nom_verrouille, refus FROM (
    SELECT *, coalesce(verrou AND nouveau <> nom, false) AS refus FROM (SELECT p.id, nom, p.id % 11 = 0 OR EXISTS (SELECT 1 FROM v_versements v WHERE v.projet_id = p.id AND nouveau = 'verse') AS verrou,
        CASE p.id % 3 WHEN 0 THEN nom || ' bis' WHEN 1 THEN nom END AS nouveau FROM d_projet p))""",
       lambda d: mutations.renommer(_handed_in(d)[0], d.projet.filter("id % 3 <> 2").select("id", F.expr("CASE id % 3 WHEN 0 THEN concat(nom, ' bis') ELSE nom END").alias("nom_export"))))


def _dropped(d: Domain) -> tuple[DataFrame, DataFrame]:
    journal = d.mouvement.filter("champ = 'statut'").select(F.lit("maj_statut").alias("action"), F.col("occurrence_id").alias("cible_id"), F.col("modifie_par").alias("auteur"))
    ids = d.raw("customer").select(F.expr("c_custkey * 3").alias("id"))
    return mutations.supprimer_avec_trace(d.rapport.select("id", "projet_id", "statut"), ids, journal, "supprimer_rapport", "admin")


simple("k35_supprimer_rapport", "SELECT id, projet_id, statut FROM d_rapport WHERE id NOT IN (SELECT c_custkey * 3 FROM customer)", lambda d: _dropped(d)[0])
simple("k35_journal", """SELECT 'maj_statut' AS action, occurrence_id AS cible_id, modifie_par AS auteur FROM d_mouvement WHERE champ = 'statut'
    UNION ALL SELECT 'supprimer_rapport', id, 'admin' FROM d_rapport WHERE id IN (SELECT c_custkey * 3 FROM customer)""", lambda d: _dropped(d)[1])


def _opened(d: Domain) -> tuple[DataFrame, DataFrame]:
    new = d.raw("supplier").select(
        F.expr("s_suppkey + 1000000").alias("id"), F.expr("s_suppkey % 100").alias("projet_id"), F.expr("s_suppkey % 150").alias("occurrence_id"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'be' ELSE 'dreal' END").alias("auteur"),
        F.col("s_name").alias("objet"), F.concat(F.lit("Bonjour de "), "s_name").alias("corps"), F.expr("timestamp_ntz'2001-01-01 00:00:00'").alias("cree_le"))
    return dialogue.ouvrir(d.demande, d.message, new)


_NEW = "s_suppkey + 1000000"
simple("k22_ouvrir_demandes", f"""SELECT id, projet_id, occurrence_id, auteur, objet, statut, cree_le, maj_le, clos_le FROM d_demande
    UNION ALL SELECT {_NEW}, s_suppkey % 100, s_suppkey % 150, CASE WHEN s_suppkey % 2 = 0 THEN 'be' ELSE 'dreal' END, s_name, 'ouverte', TIMESTAMP '2001-01-01', TIMESTAMP '2001-01-01', NULL FROM supplier""",
       lambda d: _opened(d)[0].select("id", "projet_id", "occurrence_id", "auteur", "objet", "statut", "cree_le", "maj_le", "clos_le"))
simple("k22_premiers_messages", f"""SELECT demande_id, count(*) AS nb, arg_min(acteur, cree_le) AS premier FROM (SELECT demande_id, acteur, cree_le FROM d_message
    UNION ALL SELECT {_NEW}, CASE WHEN s_suppkey % 2 = 0 THEN 'be' ELSE 'dreal' END, TIMESTAMP '2001-01-01' FROM supplier) GROUP BY 1""",
       lambda d: _opened(d)[1].groupBy("demande_id").agg(F.count("*").alias("nb"), F.min_by("acteur", "cree_le").alias("premier")))
