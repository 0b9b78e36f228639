"""JSON schemas as column expressions: every violation of a record, with its path.

``inline`` resolves the references of a schema, recursive ones to a given depth;
``violations`` compiles the result to expressions over a VARIANT column, so
records are checked inside Catalyst, without a parser of our own and without
Python per row.  ``feedback`` words the violations for whoever has to correct
the record.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<chemin:string,regle:string>>"
# The names of JSON's types in the schema language, and in that of VARIANT.
_KINDS = {"object": ["OBJECT"], "array": ["ARRAY"], "string": ["STRING"], "boolean": ["BOOLEAN"], "null": ["VOID"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]}
DEEPER = "$deeper"  # stands where a recursive reference was cut


def inline(schema: Any, depth: int = 4) -> Any:
    """The schema without references; a definition that holds itself is followed ``depth`` times.

    Definitions are found by their path in the document (``#/$defs/...``); keys
    beside a reference stay and go before what it names.
    """
    def resolve(node: Any, open_: tuple[str, ...]) -> Any:
        if isinstance(node, list):
            return [resolve(n, open_) for n in node]
        if not isinstance(node, dict):
            return node
        rest = {k: resolve(v, open_) for k, v in node.items() if k not in ("$ref", "$defs", "definitions")}
        if "$ref" not in node:
            return rest
        reference = node["$ref"]
        if open_.count(reference) >= depth:
            return {DEEPER: reference}
        target = schema
        for step in reference.removeprefix("#").strip("/").split("/"):
            target = target[step.replace("~1", "/").replace("~0", "~")] if step else target
        return {**resolve(target, (*open_, reference)), **rest}

    return resolve(schema, ())


def harden(schema: Any) -> Any:
    """The schema with every object closed, and all its properties required."""
    if isinstance(schema, list):
        return [harden(n) for n in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: {n: harden(p) for n, p in v.items()} if k == "properties" else harden(v) for k, v in schema.items()}
    if schema.get("type") == "object" and "properties" in schema:
        out |= {"additionalProperties": False, "required": list(schema["properties"])}
    return out


def _none() -> Column:
    return F.array().cast(FOUND)


def _one(path: Column, rule: str, wrong: Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.struct(path.alias("chemin"), F.lit(rule).alias("regle")))).otherwise(_none())


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _is_kind(v: Column, kind: Column, name: str) -> Column:
    if name == "integer":  # 3.0 is one
        return kind.isin("BIGINT") | (kind.isin("DECIMAL", "DOUBLE", "FLOAT") & (_number(v) == F.floor(_number(v))))
    return kind.isin(*_KINDS[name])


def _text(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _all(rules: list[Column]) -> Column:
    """The violations of several rules, in one array."""
    return F.flatten(F.array(*rules))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _check(v: Column, schema: Any, path: Column) -> Column:
    """Violations of a present value, which must be cheap to name: a column or a bound value."""
    if schema is True or schema == {}:
        return _none()
    if schema is False:
        return _one(path, "false", F.lit(True))
    if DEEPER in schema:
        return _one(path, "depth", F.lit(True))
    return _bound(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), lambda kind: _check_kind(v, kind, schema, path))


def _check_kind(v: Column, kind: Column, schema: Any, path: Column) -> Column:
    rules: list[Column] = []
    if "enum" in schema or "const" in schema:
        name = "enum" if "enum" in schema else "const"
        allowed = [_text(x) for x in (schema["enum"] if name == "enum" else [schema["const"]])]
        rules.append(_one(path, name, ~F.to_json(v).isin(*allowed)))
    number, text = kind.isin(*_KINDS["number"]), kind == "STRING"
    for name, wrong in (
        ("minimum", lambda x, b: x < b), ("maximum", lambda x, b: x > b), ("exclusiveMinimum", lambda x, b: x <= b), ("exclusiveMaximum", lambda x, b: x >= b),
    ):
        if name in schema:
            rules.append(_one(path, name, number & wrong(_number(v), float(schema[name]))))
    string = F.try_variant_get(v, "$", "string")
    if "minLength" in schema:
        rules.append(_one(path, "minLength", text & (F.length(string) < schema["minLength"])))
    if "maxLength" in schema:
        rules.append(_one(path, "maxLength", text & (F.length(string) > schema["maxLength"])))
    if "pattern" in schema:
        rules.append(_one(path, "pattern", text & ~string.rlike(schema["pattern"])))
    if {"items", "minItems", "maxItems"} & schema.keys():
        items = F.when(kind == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))
        if "minItems" in schema:
            rules.append(_one(path, "minItems", F.size(items) < schema["minItems"]))
        if "maxItems" in schema:
            rules.append(_one(path, "maxItems", F.size(items) > schema["maxItems"]))
        if "items" in schema:
            each = F.transform(items, lambda x, i: _check(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            rules.append(F.coalesce(F.flatten(each), _none()))
    if {"properties", "required", "additionalProperties"} & schema.keys():
        fields = F.when(kind == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>"))
        rules.append(_bound(fields, lambda f: _check_fields(f, schema, path)))
    for several, wrong in (("anyOf", lambda sizes: F.forall(sizes, lambda n: n > 0)), ("oneOf", lambda sizes: F.size(F.filter(sizes, lambda n: n == 0)) != 1)):
        if several in schema:
            rules.append(_one(path, several, wrong(F.array(*(F.size(_check(v, s, path)) for s in schema[several])))))
    rules += [_check(v, s, path) for s in schema.get("allOf", [])]
    found = _all(rules) if rules else _none()
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = F.lit(False)
        for name in names:
            fits = fits | _is_kind(v, kind, name)
        found = F.when(fits, found).otherwise(_one(path, "type", F.lit(True)))  # of a wrong type nothing more can be said
    return found


def _check_fields(fields: Column, schema: dict, path: Column) -> Column:
    """Violations of the rules on an object's fields; null fields (no object) have none."""
    rules = [_none()]
    named = schema.get("properties", {})
    for name in schema.get("required", []):
        rules.append(_one(F.concat(path, F.lit(f".{name}")), "required", ~F.map_contains_key(fields, name)))

    def field(name: str, below: Any) -> Column:
        return _bound(F.try_element_at(fields, F.lit(name)), lambda value: _check(value, below, F.concat(path, F.lit(f".{name}"))))

    rules += [F.when(F.coalesce(F.map_contains_key(fields, name), F.lit(False)), field(name, below)).otherwise(_none()) for name, below in named.items()]
    if schema.get("additionalProperties") is False:
        unknown = F.filter(F.map_keys(fields), lambda k: ~k.isin(*named)) if named else F.map_keys(fields)
        rules.append(F.coalesce(F.transform(unknown, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("chemin"), F.lit("additionalProperties").alias("regle"))), _none()))
    return _all(rules)


def violations(text: Column, schema: dict, depth: int = 4) -> Column:
    """Every violation (chemin, regle) of a JSON text, in the order of its paths; empty if it conforms.

    A null text, or one that is no JSON, has the single violation ``json`` at
    the root.  What is nested more deeply than a recursive schema was followed
    is reported as ``depth``, not passed.
    """
    unread = F.array(F.struct(F.lit("$").alias("chemin"), F.lit("json").alias("regle")))
    whole = inline(schema, depth)
    return _bound(F.try_parse_json(text), lambda v: F.when(v.isNull(), unread).otherwise(F.array_sort(_check(v, whole, F.lit("$")))))


def feedback(found: Column) -> Column:
    """A line per violation, for the next attempt; null if there is none."""
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda f: F.concat(f["chemin"], F.lit(" : "), f["regle"])), "\n"))


def json_of(answer: Column) -> Column:
    """The JSON object in an answer that may wrap it in a fence or in words."""
    bare = F.regexp_replace(F.trim(answer), r"(?s)^```[^\n]*\n(.*?)\s*(?:```.*)?$", "$1")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(bare)
