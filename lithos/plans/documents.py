"""Queries over JSON documents: each nation lends one for each way to break it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents as dc
from ..registry import query, table

JSON_CASES = [('{"a": [1, 2.5, null, true]}', ""), ('{"a": 1, "a": 2}', "json.duplicate_key"), ("[NaN]", "json.not_a_number"), ("[1e999]", "json.number_overflow"), ("[1e-999]", "json.number_underflow"), ("[0e-999]", ""), ("[9223372036854775808]", "json.integer_range"), ("[9223372036854775807]", ""), ("{", "json.invalid_json"), ("", "json.invalid_json")]

SCHEMA = {
    "type": "object", "required": ["id"], "additionalProperties": False, "dependentRequired": {"unit": ["size"]},
    "$defs": {"small": {"type": "number", "minimum": 0, "exclusiveMaximum": 10}, "loop": {"$ref": "#/$defs/loop"}},
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z]+$", "minLength": 2, "maxLength": 4}, "kind": {"enum": ["a", 1]}, "one": {"const": 1}, "size": {"$ref": "#/$defs/small"}, "unit": {"type": ["string", "null"]}, "lost": {"$ref": "#/$defs/none"}, "loop": {"$ref": "#/$defs/loop"},
        "list": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "prefixItems": [{"type": "integer"}], "items": {"type": ["number", "string"]}, "contains": {"type": "number"}, "maxContains": 2},
        "any": {"anyOf": [{"type": "string"}, {"minimum": 5}]}, "sole": {"oneOf": [{"type": "integer"}, {"minimum": 5}]}, "no": {"not": {"type": "string"}}, "never": False, "all": {"allOf": [{"maximum": 3}, {"exclusiveMinimum": 1}]},
        "cond": {"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"type": "null"}},
    },
}
SCHEMA_CASES = [
    ({"id": "ab"}, ""), ([], "type"), ({}, "required"), ({"id": "ab", "x": 1}, "additional_property"), ({"id": "ab", "unit": None}, "dependent_required"), ({"id": "AB"}, "pattern"), ({"id": "a"}, "min_length"), ({"id": "abcde"}, "max_length"),
    ({"id": "ab", "kind": 1.0}, ""), ({"id": "ab", "kind": True}, "enum"), ({"id": "ab", "one": 2}, "const"), ({"id": "ab", "size": -1}, "minimum"), ({"id": "ab", "size": 10}, "exclusive_maximum"), ({"id": "ab", "lost": 1}, "ref"), ({"id": "ab", "loop": 1}, "ref_cycle"),
    ({"id": "ab", "list": []}, "min_items contains"), ({"id": "ab", "list": [1, "a", "b", "c"]}, "max_items"), ({"id": "ab", "list": [1, 1.0]}, "unique_items"), ({"id": "ab", "list": ["a", 2]}, "type"), ({"id": "ab", "list": [1, None]}, "type"), ({"id": "ab", "list": [1, 2, 3]}, "contains"),
    ({"id": "ab", "any": 4}, "any_of"), ({"id": "ab", "sole": 7}, "one_of"), ({"id": "ab", "no": "x"}, "not"), ({"id": "ab", "never": 1}, "false"), ({"id": "ab", "all": 4}, "maximum"), ({"id": "ab", "all": 1}, "exclusive_minimum"), ({"id": "ab", "cond": "x"}, "min_length"), ({"id": "ab", "cond": 1}, "type"),
]
PRIVATE_CASES = [
    ({"a": ["fine", 1, "v1.2.3"]}, ""), ({"note": "see /home/x/y"}, "absolute_path"), ({"note": "~/x"}, "absolute_path"), ({"note": "C:\\x"}, "absolute_path"), ({"note": "../x/y"}, "absolute_path"), ({"note": "$HOME/x"}, "absolute_path"),
    ({"note": "box.lan"}, "network_location"), ({"note": "localhost:80"}, "network_location"), ({"note": "at 10.0.0.1"}, "network_location"), ({"note": "999.0.0.1"}, ""), ({"kernel": "7.8.1.0"}, ""), ({"note": "fe80::1"}, "network_location"), ({"note": "gs://bucket"}, "network_location absolute_path"),
    ({"note": "password: x"}, "secret_value"), ({"api_key": "x"}, "secret_field"), ({"api_key": ""}, ""), ({"note": "a?sig=1"}, "signed_url"), ({"note": "token=abc"}, "secret_value signed_url"),
]


def _docs(spark, sf_dir, texts: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("text")) for i, t in enumerate(texts)])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(each).alias("t")).select(F.concat("n_nationkey", F.lit("/"), "t.i").alias("doc"), "t.text")


def _want(cases: list, prefix: str = "") -> str:
    rows = ", ".join(f"({i}, '{prefix}{c}')" for i, (_, codes) in enumerate(cases) for c in codes.split())
    return f"SELECT n_nationkey || '/' || i AS doc, code FROM nation, (VALUES {rows}) t(i, code)"


@query(_want(JSON_CASES))
def strict_json(spark, sf_dir):
    return dc.json_findings(_docs(spark, sf_dir, [t for t, _ in JSON_CASES])).select("doc", "code")


@query(_want(SCHEMA_CASES, "schema."))
def schema_rules(spark, sf_dir):
    return dc.schema_findings(_docs(spark, sf_dir, [json.dumps(d) for d, _ in SCHEMA_CASES]), SCHEMA).select("doc", "code").distinct()


@query(_want(PRIVATE_CASES, "privacy."))
def privacy_leaves(spark, sf_dir):
    return dc.privacy_findings(_docs(spark, sf_dir, [json.dumps(d) for d, _ in PRIVATE_CASES])).select("doc", "code").distinct()
