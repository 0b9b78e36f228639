"""Queries on checked records, single rows and rewritten partitions, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import json_schema
from ledgerloom.operators import ingestion, mutations
from ledgerloom.plans.process_plans import plain
from ledgerloom.plans.report_plans import simple
from ledgerloom.session import shared_folder
from ledgerloom.sources import readers
from ledgerloom.sources.domain import Domain

#: What an extracted rule must look like; rules may hold rules.
RULE = {
    "$ref": "#/$defs/Regle",
    "$defs": {
        "Recurrence": {"type": "object", "properties": {"type": {"enum": ["annuelle", "intervalle", "ponctuelle"]}, "intervalle_ans": {"anyOf": [{"type": "integer", "minimum": 1}, {"type": "null"}]}}},
        "Regle": {
            "type": "object",
            "properties": {
                "cle": {"type": "string", "minLength": 1}, "recurrence": {"$ref": "#/$defs/Recurrence"}, "confiance": {"type": "number", "minimum": 0, "maximum": 1},
                "ug_ids": {"type": "array", "items": {"type": "string", "pattern": "^[A-Z]+[0-9]+$"}, "maxItems": 3}, "sous_regles": {"type": "array", "items": {"$ref": "#/$defs/Regle"}},
            },
        },
    },
}
_WHOLE = '''"recurrence": {"type": "annuelle", "intervalle_ans": null}, "confiance": 0.5, "ug_ids": ["UG1", "UG2"]'''
_PLAIN = '{"cle": "F", ' + _WHOLE + ', "sous_regles": []}'
# By the customer's number: a record that is right, or wrong in one way, and what must be found.
_RECORDS = [
    ('{"cle": "C@", ' + _WHOLE + ', "sous_regles": [' + _PLAIN + "]}", []),
    ("{" + _WHOLE + ', "sous_regles": []}', [("$.cle", "required")]),
    ('{"cle": "", "recurrence": {"type": "parfois", "intervalle_ans": 0}, "confiance": 0.5, "ug_ids": [], "sous_regles": []}', [("$.cle", "minLength"), ("$.recurrence.type", "enum"), ("$.recurrence.intervalle_ans", "anyOf")]),
    ('{"cle": @, ' + _WHOLE + ', "sous_regles": [], "note": "@"}', [("$.cle", "type"), ("$.note", "additionalProperties")]),
    ('Voici :\n```json\n{"cle": "C@", "recurrence": {"type": "ponctuelle", "intervalle_ans": 2}, "confiance": 1.5, "ug_ids": ["UG@", "ug", "U1", "7"], "sous_regles": []}\n```',
     [("$.confiance", "maximum"), ("$.ug_ids", "maxItems"), ("$.ug_ids[1]", "pattern"), ("$.ug_ids[3]", "pattern")]),
    ('{"cle": "C@", ' + _WHOLE, [("$", "json")]),
    ('{"cle": "C@", ' + _WHOLE + ', "sous_regles": [' + _PLAIN + ', {"cle": null, ' + _WHOLE + ', "sous_regles": {}}]}', [("$.sous_regles[1].cle", "type"), ("$.sous_regles[1].sous_regles", "type")]),
    ('{"cle": "C@", ' + _WHOLE + ', "sous_regles": [{"cle": "D", ' + _WHOLE + ', "sous_regles": [{"cle": "E", ' + _WHOLE + ', "sous_regles": [' + _PLAIN + "]}]}]}",
     [("$.sous_regles[0].sous_regles[0].sous_regles[0]", "depth")]),
]


def _checked(d: Domain) -> DataFrame:
    kinds = F.array(*(F.lit(text) for text, _ in _RECORDS))
    text = F.replace(F.element_at(kinds, (F.col("c_custkey") % len(_RECORDS) + 1).cast("int")), F.lit("@"), F.col("c_custkey").cast("string"))
    # The file is small for what its rows cost, so they are dealt to all cores.
    dealt = d.raw("customer").select("c_custkey").repartition(d.spark.sparkContext.defaultParallelism)
    rows = dealt.select(F.col("c_custkey").alias("id"), json_schema.json_of(text).alias("json"))
    found = json_schema.violations(F.col("json"), json_schema.harden(RULE), depth=3)
    return rows.select("id", F.explode(found).alias("f")).select("id", "f.*")


_EXPECTED = ", ".join(f"({k}, '{path}', '{rule}')" for k, (_, found) in enumerate(_RECORDS) for path, rule in found)
simple("s11_violations", f"SELECT c_custkey AS id, chemin, regle FROM customer JOIN (VALUES {_EXPECTED}) t(k, chemin, regle) ON c_custkey % {len(_RECORDS)} = k", _checked)

# Keys that occur never, once and several times.
simple("t08_au_plus_une_ligne", """SELECT k, n = 1 AS trouve, CASE WHEN n > 1 THEN 'plusieurs lignes pour ' || k || ' : ' || n END AS motif, CASE WHEN n = 1 THEN montant END AS montant FROM (
    SELECT c_custkey AS k, count(o_orderkey) AS n, CAST(max(o_totalprice) AS DOUBLE) AS montant FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 9 = 0 GROUP BY c_custkey)""",
       lambda d: readers.at_most_one(d.raw("customer").select(F.col("c_custkey").alias("k")), d.raw("orders").filter("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").cast("double").alias("montant")), "k", strict=False))


def _rewritten(d: Domain) -> DataFrame:
    """New generated rows for the projects of one lot; the table's other lots are not touched."""
    folder = f"{shared_folder(d.spark)}/ledgerloom-lots-{uuid.uuid4().hex}"
    rows = d.occurrence.select("id", "projet_id", "annee", "origine", "modifie_le", "statut", "annee_initiale", "montant_initial", "montant_ht", (F.col("projet_id") % 20).alias("lot"))
    rows.write.partitionBy("lot").parquet(folder)
    table = d.spark.read.parquet(folder)
    seeded = table.filter("lot = 3")
    fresh = seeded.withColumns({"id": F.col("id") + 1000000000, "origine": F.lit("ia"), "modifie_le": F.lit(None).cast("timestamp_ntz")})
    ingestion.replace_partitions(mutations.reseed(seeded, fresh), folder, ["lot"])
    ingestion.replace_partitions(mutations.figer_baseline(table.filter("lot = 7"), "ecraser"), folder, ["lot"])
    return plain(d.spark.read.parquet(folder).select("id", "projet_id", "annee", "origine", "annee_initiale", "montant_initial"))


_KEPT = "id, projet_id, annee, origine, annee_initiale, CAST(montant_initial AS DOUBLE) AS montant_initial FROM d_occurrence"
simple("k06_par_lot", f"""SELECT {_KEPT} WHERE projet_id % 20 NOT IN (3, 7) UNION ALL SELECT {_KEPT} WHERE projet_id % 20 = 3 AND NOT (origine = 'ia' AND modifie_le IS NULL)
    UNION ALL SELECT id + 1000000000, projet_id, annee, 'ia', annee_initiale, CAST(montant_initial AS DOUBLE) FROM d_occurrence WHERE projet_id % 20 = 3
    UNION ALL SELECT id, projet_id, annee, origine, CASE WHEN statut <> 'supprime' THEN annee ELSE annee_initiale END, CAST(CASE WHEN statut <> 'supprime' THEN montant_ht ELSE montant_initial END AS DOUBLE) FROM d_occurrence WHERE projet_id % 20 = 7""", _rewritten)
