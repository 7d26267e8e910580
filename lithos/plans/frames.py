"""Queries over frames and transforms: each nation lends sound ones, and one set for each way to break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..registry import query, table

_TURN = [0.0, -1.0, 0.0, 3.0, 1.0, 0.0, 0.0, -2.0, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0]
_BACK = [0.0, 1.0, 0.0, 2.0, -1.0, 0.0, 0.0, 3.0, 0.0, 0.0, 1.0, -0.5, 0.0, 0.0, 0.0, 1.0]
_GOOD = {
    "id": "t", "source": "a", "target": "b", "layout": "row-major", "convention": "column-vector", "units": "contract-linear-units", "type": "rigid", "matrix": _TURN, "inverse": _BACK, "reflection_allowed": False,
    "held_out": 3, "round_trip_max": 1e-9, "round_trip_tolerance": 1e-6, "norm": "infinity", "condition": 1.0, "reciprocal": 1.0,
}


def _with(m: list[float], **cells: float) -> list[float]:
    return [cells.get(f"c{i}", x) for i, x in enumerate(m)]


def _diagonal(*d: float) -> dict:
    full = lambda v: [v[i // 5] if i % 5 == 0 else 0.0 for i in range(16)]
    return {"matrix": full([*d, 1.0]), "inverse": full([*(1 / x for x in d), 1.0])}


#: Changes to the sound transform, and the findings that follow.
CASES: list[tuple[dict, str]] = [
    ({}, ""), ({"target": "q"}, "reference.frame"), ({"target": "a"}, "geometry.self_transform"), ({"layout": "column-major"}, "transform.layout"), ({"convention": "row-vector"}, "transform.vector_convention"), ({"units": "mm"}, "transform.translation_units"),
    ({"type": "warp"}, "transform.type"), ({"matrix": [1.0]}, "transform.matrix_size"), ({"reflection_allowed": None}, "transform.reflection_flag"), ({"held_out": 0}, "transform.held_out"), ({"round_trip_max": 1.0}, "transform.round_trip"), ({"norm": "one"}, "transform.conditioning_norm"),
    ({"matrix": _with(_TURN, c15=2.0)}, "transform.homogeneous_row transform.inverse"), ({"inverse": _with(_BACK, c3=9.0)}, "transform.inverse"), ({"type": "affine", "matrix": _with(_TURN, c10=0.0)}, "transform.singular transform.inverse"),
    (_diagonal(-1.0, 1.0, 1.0), "transform.undocumented_reflection transform.handedness"), (_diagonal(-1.0, 1.0, 1.0) | {"reflection_allowed": True}, ""), (_diagonal(-1.0, 1.0, 1.0) | {"target": "mirror"}, "transform.undocumented_reflection"),
    (_diagonal(2.0, 2.0, 2.0), "transform.not_rigid"), (_diagonal(2.0, 2.0, 2.0) | {"type": "similarity"}, ""), (_diagonal(2.0, 2.0, 4.0) | {"type": "similarity", "condition": 2.0, "reciprocal": 0.5}, "transform.not_similarity"), ({"condition": 2.0}, "transform.conditioning"), ({"reciprocal": 0.5}, "transform.conditioning"),
    (_diagonal(1e7, 1.0, 1e-7) | {"type": "affine", "condition": 1e14, "reciprocal": 1e-14}, "transform.conditioning transform.singular"), ({"type": "rigid", "matrix": _with(_TURN, c0=0.001, c1=-1.0), "inverse": _with(_BACK, c5=0.001)}, "transform.non_orthogonal transform.not_rigid transform.inverse transform.conditioning"),
]
CASES[-1] = (CASES[-1][0] | {"type": "affine", "condition": 1.001, "reciprocal": 0.999}, "transform.inverse transform.conditioning")
_SHEAR = {"matrix": [1.0, 0.5, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0], "inverse": [1.0, -0.5, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0], "condition": 2.25, "reciprocal": 1 / 2.25}
CASES.append(({k: [float(x) for x in v] if isinstance(v, list) else v for k, v in _SHEAR.items()}, "transform.not_rigid transform.non_orthogonal"))
SCHEMA = "i int, id string, source string, target string, layout string, convention string, units string, type string, matrix array<double>, inverse array<double>, reflection_allowed boolean, held_out int, round_trip_max double, round_trip_tolerance double, norm string, condition double, reciprocal double"


def _docs(spark, sf_dir, rows: list[dict]) -> DataFrame:
    import json

    struct = "array<struct<" + ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in SCHEMA.split(", ")) + ">>"
    each = F.explode(F.from_json(F.lit(json.dumps(rows)), struct))
    return table(spark, sf_dir, "nation").select("n_nationkey", each.alias("t")).select(F.concat("n_nationkey", F.lit("/"), "t.i").alias("doc"), *[f"t.{c.split()[0]}" for c in SCHEMA.split(", ")[1:]])


def _want(rows: list[tuple[int, str]]) -> str:
    return "SELECT n_nationkey || '/' || i AS doc, code FROM nation, (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in rows) + ") t(i, code)"


_MORE = [_GOOD | {"i": 100}, _GOOD | {"i": 100, "id": "u"}, _GOOD | {"i": 101}, _GOOD | {"i": 101, "source": "b", "target": "a", "matrix": _BACK, "inverse": _TURN}]


@query(_want([*((i, c) for i, (_, codes) in enumerate(CASES) for c in codes.split()), (100, "reference.duplicate_transform"), (101, "reference.duplicate_id")]))
def transform_rules(spark, sf_dir):
    t = _docs(spark, sf_dir, [*(_GOOD | change | {"i": i} for i, (change, _) in enumerate(CASES)), *_MORE])
    hands = F.explode(F.array(*[F.struct(F.lit(n).alias("id"), F.lit(h).alias("handedness")) for n, h in (("a", "right"), ("b", "right"), ("mirror", "left"))]))
    frames = t.select("doc").distinct().select("doc", hands.alias("f")).select("doc", "f.id", "f.handedness")
    return fr.transform_findings(t, frames).select("doc", "code").distinct()


_LOOP = [_GOOD | {"id": "ab"}, _GOOD | {"id": "bc", "source": "b", "target": "c"}, _GOOD | {"id": "ca", "source": "c", "target": "a"}, _GOOD | {"id": "de", "source": "d", "target": "e"}]
_TWICE = {"matrix": [-1.0, 0.0, 0.0, 5.0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0], "inverse": [-1.0, 0.0, 0.0, 5.0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 1.0, -1.0, 0.0, 0.0, 0.0, 1.0]}


@query(_want([(0, "transform.cycle")]))
def transform_cycles(spark, sf_dir):
    """Three quarter turns do not lead back; in the second set the way back is that of two."""
    good = [_LOOP[0], _LOOP[1], _GOOD | _TWICE | {"id": "ac", "target": "c"}, _LOOP[3]]
    t = _docs(spark, sf_dir, [*(r | {"i": 0} for r in _LOOP), *(r | {"i": 1} for r in good)])
    return fr.cycle_findings(t).select("doc", "code").distinct()


@query(_want([(1, "reference.transform"), (2, "reference.transform_order"), (3, "reference.transform_order"), (5, "reference.transform_order")]))
def transform_chains(spark, sf_dir):
    t = _docs(spark, sf_dir, [r | {"i": i} for i in range(6) for r in _LOOP])
    ids = [["ab", "bc"], ["ab", "zz"], ["bc", "ab"], ["ab"], [], []]
    chain = F.get(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in ids]), F.substring_index("doc", "/", -1).cast("int"))
    goal = F.when(F.col("doc").endswith("/4"), "a").otherwise("c")
    chains = t.select("doc").distinct().select("doc", F.lit("main").alias("chain"), F.lit("a").alias("start"), goal.alias("goal"), chain.alias("ids"))
    return fr.chain_findings(chains, t).select("doc", "code")
