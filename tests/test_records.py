import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import json_schema
from ledgerloom.operators import context, ingestion
from ledgerloom.plans.record_plans import RULE
from ledgerloom.sources import readers

KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def is_kind(v, name):
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    if name == "number":
        return number
    return number and v == int(v) if name == "integer" else isinstance(v, KINDS[name])


def brute(v, s, path="$"):
    """The rules of the schema language that are supported, by recursion."""
    if json_schema.DEEPER in s:
        return [(path, "depth")]
    if "type" in s and not any(is_kind(v, t) for t in (s["type"] if isinstance(s["type"], list) else [s["type"]])):
        return [(path, "type")]
    out = []
    if "enum" in s and v not in s["enum"]:
        out.append((path, "enum"))
    if is_kind(v, "number"):
        out += [(path, r) for r, wrong in (("minimum", lambda b: v < b), ("maximum", lambda b: v > b)) if r in s and wrong(s[r])]
    if isinstance(v, str):
        out += [(path, "minLength")] if len(v) < s.get("minLength", 0) else []
        out += [(path, "pattern")] if "pattern" in s and not re.search(s["pattern"], v) else []
    if isinstance(v, list):
        out += [(path, "maxItems")] if len(v) > s.get("maxItems", 10**9) else []
        for k, x in enumerate(v):
            out += brute(x, s.get("items", {}), f"{path}[{k}]")
    if isinstance(v, dict):
        out += [(f"{path}.{n}", "required") for n in s.get("required", []) if n not in v]
        for n, x in v.items():
            if n in s.get("properties", {}):
                out += brute(x, s["properties"][n], f"{path}.{n}")
            elif s.get("additionalProperties") is False:
                out.append((f"{path}.{n}", "additionalProperties"))
    if "anyOf" in s and all(brute(v, t, path) for t in s["anyOf"]):
        out.append((path, "anyOf"))
    return out


def random_record(rng, depth=0):
    if rng.random() < 0.1:
        return rng.choice([None, 3, 2.5, 4.0, "x", "UG1", True, [], {}, ["UG2", 1]])
    record = {
        "cle": rng.choice(["a", "", None, 3, "é"]), "recurrence": rng.choice([{"type": "annuelle", "intervalle_ans": rng.choice([None, 0, 1, 2.0, 2.5, "x"])}, {"type": "x"}, {"type": "ponctuelle", "intervalle_ans": 3, "y": 1}, []]),
        "confiance": rng.choice([0, 0.5, 1, 1.5, -1, "0.5"]), "ug_ids": rng.choice([["UG1"], [], ["UG1", "u", 3], ["A1", "B2", "C3", "D4"], None]), "sous_regles": [random_record(rng, depth + 1) for _ in range(rng.randrange(3))] if depth < 4 else [],
    }
    for name in list(record):
        if rng.random() < 0.1:
            del record[name]
    if rng.random() < 0.1:
        record["autre"] = 1
    return record


def test_violations_equal_a_recursion(spark):
    rng = random.Random(4)
    records = [random_record(rng) for _ in range(400)]
    schema = json_schema.harden(RULE)
    flat = json_schema.inline(schema, 3)
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "id int, json string")
    got = {r.id: [tuple(f) for f in r.f] for r in rows.select("id", json_schema.violations(F.col("json"), schema, 3).alias("f")).collect()}
    for k, r in enumerate(records):
        assert got[k] == sorted(brute(r, flat)), r
    assert {rule for f in got.values() for _, rule in f} >= {"type", "enum", "required", "additionalProperties", "anyOf", "maxItems", "pattern", "minLength", "minimum", "maximum", "depth"}


def test_references_are_followed_and_bounded():
    assert json_schema.inline({"$ref": "#/$defs/a/b", "title": "t", "$defs": {"a": {"b": {"type": "string", "title": "u"}}}}) == {"type": "string", "title": "t"}
    loop = {"$ref": "#", "type": "object"}
    flat = json_schema.inline({"type": "object", "properties": {"x": {"$ref": "#"}}}, 2)
    assert json.dumps(flat).count("properties") == 3 and json_schema.DEEPER in json.dumps(flat)
    assert json_schema.DEEPER in json.dumps(json_schema.inline(loop, 3))
    assert json_schema.harden({"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {}}}}})["properties"]["a"]["required"] == ["b"]


def test_texts_that_are_no_json_and_other_rules(spark):
    schema = {"oneOf": [{"type": "integer"}, {"type": "number", "exclusiveMaximum": 5}], "allOf": [{"const": 7}]}
    rows = spark.createDataFrame([(t,) for t in ("7", "6", "4.5", "nope", None, "", "null", '"7"')], "t string")
    got = {r.t: r.f for r in rows.select("t", json_schema.feedback(json_schema.violations(F.col("t"), schema)).alias("f")).collect()}
    assert got == {"7": None, "6": "$ : const", "4.5": "$ : const", "nope": "$ : json", None: "$ : json", "": "$ : json", "null": "$ : const\n$ : oneOf", '"7"': "$ : const\n$ : oneOf"}
    answers = ['```json\n{"a": 1}\n```', 'Voici : {"a": {"b": 2}} fin', " [1] ", "rien", None, "```\n{}\n```\nmot"]
    out = [r[0] for r in spark.createDataFrame([(a,) for a in answers], "t string").select(json_schema.json_of(F.col("t"))).collect()]
    assert out == ['{"a": 1}', '{"a": {"b": 2}}', "[1]", "rien", None, "{}"]


def test_at_most_one_row_or_an_error(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    told = {r.k: (r.trouve, r.motif, r.v) for r in readers.at_most_one(keys, table, "k", strict=False).collect()}
    assert told == {1: (True, None, "a"), 2: (False, "plusieurs lignes pour 2 : 2", None), 3: (False, None, None), None: (False, None, None)}
    with pytest.raises(Exception, match="plusieurs lignes pour 2"):
        readers.at_most_one(keys, table, "k").collect()
    assert {r.k: r.v for r in readers.at_most_one(keys.filter("k <> 2"), table, "k").collect()} == {1: "a", 3: None}


def test_only_the_partitions_with_rows_are_rewritten(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(100).withColumn("lot", F.col("id") % 4).write.partitionBy("lot").parquet(folder)

    def files():
        return {k: sorted(n for n in os.listdir(f"{folder}/lot={k}") if n.endswith(".parquet")) for k in range(4)}

    before = files()
    changed = spark.read.parquet(folder).filter("lot = 2").withColumn("id", F.col("id") + 1000)
    ingestion.replace_partitions(changed, folder, ["lot"])
    after = files()
    assert {k for k in range(4) if before[k] != after[k]} == {2}
    assert spark.read.parquet(folder).count() == 100 and spark.read.parquet(folder).filter("lot = 2").agg(F.min("id")).first()[0] == 1002


def test_a_view_shows_what_its_reader_may_see(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 5).cast("int").alias("organisation_id")).write.parquet(str(tmp_path / "p"))
    context.declare(spark)
    context.protect(spark.read.parquet(str(tmp_path / "p")), "projets_a_moi")
    counts, plans = {}, {}
    for role, organisation in (("admin", None), ("controleur", 1), ("operateur", 3), ("operateur", None), ("inconnu", 3), (None, 3)):
        context.act_as(spark, role, organisation)
        seen = spark.table("projets_a_moi")
        counts[role, organisation] = seen.count()
        plans[role, organisation] = seen._jdf.queryExecution().executedPlan().toString()
    context.act_as(spark)
    assert counts == {("admin", None): 100, ("controleur", 1): 100, ("operateur", 3): 20, ("operateur", None): 0, ("inconnu", 3): 0, (None, 3): 0}
    assert "organisation_id" in plans["operateur", 3].split("PushedFilters")[1]  # the condition is in the scan
    assert "Filter" not in plans["admin", None].split("Scan")[0]


def test_a_record_is_parsed_once_however_many_rules_there_are(spark):
    schema = json_schema.harden({"type": "object", "properties": {name: {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}}} for name in "abcde"}})
    rows = spark.createDataFrame([('{"a": {"n": 0}, "b": {}, "c": {"n": 2}, "d": 1, "e": {"n": 1, "m": 1}}',)], "j string")
    found = rows.select(json_schema.violations(F.col("j"), schema).alias("f"))
    assert [tuple(f) for f in found.head().f] == [("$.a.n", "minimum"), ("$.b.n", "required"), ("$.d", "type"), ("$.e.m", "additionalProperties")]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_parse_json") == 1 and plan.count("map<string,variant>") + plan.count("MapType(StringType,VariantType") == 6
