"""Operators against brute force, on hard rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lithos.functions import plane, router
from lithos.operators import cloud, documents, kinematics, prefix, reports, robot_files, topology, world_files


def test_running_totals_do_not_depend_on_partitions(spark):
    rows = [(i * 7 % 101, i % 5) for i in range(101)]
    want, total = {}, 0
    for k, v in sorted(rows):
        want[k], total = total, total + v
    for n in (1, 6):
        got = prefix.running_totals(spark.createDataFrame(rows, "k long, v long").repartition(n), ["k"], {"before": "v"}).collect()
        assert {r.k: r.before for r in got} == want
    assert prefix.running_totals(spark.createDataFrame([], "k long, v long"), ["k"], {"before": "v"}).count() == 0


def test_area_draws(spark):
    faces = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "face long, area double")
    a = reports.area_sample(faces, "face", "area", 4000, 3).collect()
    assert Counter((r.draw, r.face) for r in a) == Counter((r.draw, r.face) for r in reports.area_sample(faces.repartition(7), "face", "area", 4000, 3).collect())
    n = Counter(r.face % 4 for r in a)
    assert len({r.draw for r in a}) == 4000 and n[0] == 0 and abs(n[3] / 4000 - 0.5) < 0.05 and abs(n[1] / 4000 - 1 / 6) < 0.04
    assert reports.area_sample(faces.filter("area > 9"), "face", "area", 10).count() == 0


def test_long_chains_of_joints(spark):
    n, rnd = 21, random.Random(4)
    rows, at, turn = [], [0.0, 0.0], 0.0
    want = {"l0": (0.0, 0.0)}
    for i in range(n):
        step, angle = rnd.uniform(0, 2), rnd.uniform(-1, 1)
        origin = [1.0, 0.0, 0.0, step, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
        rows.append((1, f"l{i}", f"l{i + 1}", origin, "continuous", [0.0, 0.0, 1.0], angle))
        at = [at[0] + step * math.cos(turn), at[1] + step * math.sin(turn)]
        want[f"l{i + 1}"] = tuple(at)
        turn += angle
    rows += [(1, "x", "y", kinematics.IDENTITY, "fixed", [1.0, 0.0, 0.0], 0.0), (1, "y", "x", kinematics.IDENTITY, "fixed", [1.0, 0.0, 0.0], 0.0)]
    joints = spark.createDataFrame(rows, "robot long, parent string, child string, origin array<double>, type string, axis array<double>, value double")
    got = {r.link: (r.pose[3], r.pose[7]) for r in kinematics.link_poses(joints).collect()}
    assert set(got) == set(want) and all(math.dist(got[k], want[k]) < 1e-9 for k in want)


def test_mimic_chains_end(spark):
    rows = [(1, "a", 2.0, None, None, None), (1, "b", 9.0, "a", 3.0, 1.0), (1, "c", 9.0, "b", None, 1.0), (1, "d", 5.0, "e", 2.0, 0.0), (1, "e", 6.0, "d", 2.0, 0.0), (1, "f", 4.0, "gone", 2.0, 0.0)]
    got = kinematics.resolve_mimics(spark.createDataFrame(rows, "robot long, joint string, value double, mimic string, multiplier double, offset double")).collect()
    values = {r.joint: r.value for r in got}
    assert (values["a"], values["b"], values["c"], values["f"]) == (2.0, 7.0, 8.0, 4.0) and len(got) == 6


def test_stream_hash_is_that_of_the_text(spark):
    import hashlib

    pts = [(0.1, -0.0, 1e300), (2.0, 1 / 3, -5.0), (0.0, 7.0, 5e-324)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "idx long, x double, y double, z double")
    text = "".join(" ".join("0" if c == 0 else format(c, ".17g") for c in p) + "\n" for p in pts)
    r = cloud.canonical_sha256(df.repartition(3), 2).first()
    assert (r.n, r.sha256) == (3, hashlib.sha256(text.encode()).hexdigest())


def test_requests(spark):
    rows = [(None, "fallback", "none"), ("do not change it, only build", "read-only", "none"), ("What now? Build it", "operate", "scoped"), ("what shall we build", "read-only", "none"), ("that build", "fallback", "none"), ("Will you extract it", "operate", "scoped")]
    for r in router.route(spark.createDataFrame(rows, "text string, want string, m string"), "text").collect():
        assert (r.route, r.mutation) == (r.want, r.m), r.text


def test_lookup_probes_tables_in_order(spark):
    e = spark.createDataFrame([("vertex", 4, "x"), ("face", 2, "x"), ("face", 1, "x"), ("edge", 0, "o1.e1")], "kind string, row int, id string")
    got = topology.lookup(spark.createDataFrame([("x",), ("e1",), ("",), (None,)], "ref string"), e, single=F.lit("o1")).collect()
    assert {r.ref: (r.kind, r.row) for r in got} == {"x": ("face", 1), "e1": ("edge", 0), "": (None, None), None: (None, None)}


def test_files_that_cannot_be_read(spark):
    docs = spark.createDataFrame([("a.urdf", None), ("a.txt", "<robot/>"), ("b.urdf", "<robot")], "doc string, xml string")
    assert {(r.doc, r.code) for r in robot_files.urdf_findings(docs).collect()} == {("a.urdf", "unreadable_file"), ("a.txt", "invalid_target"), ("b.urdf", "invalid_xml")}
    none = docs.filter("doc is null")
    assert robot_files.urdf_findings(none).count() == robot_files.srdf_findings(none).count() == world_files.sdf_findings(none).count() == 0
    assert {r.code for r in world_files.sdf_findings(docs.filter("doc = 'a.urdf'")).collect()} == {"invalid_xml"}


@pytest.mark.parametrize("text", ["{}", "[1]", '"é"', "-0.0"])
def test_strict_json_takes_json(text):
    import json

    assert documents.strict_json(text) == json.loads(text)


def test_plane_functions(spark):
    one = spark.range(1)
    first = lambda c: one.select(c.alias("c")).first().c
    assert first(plane.decimate(F.sequence(F.lit(0), F.lit(9)), 4)) == [0, 3, 6, 9] and first(plane.decimate(F.array(F.lit(1)), 4)) == [1]
    assert first(plane.circle_through(*[(F.lit(float(x)), F.lit(0.0)) for x in range(3)])) is None
    assert first(plane.bulge_arc(*[F.lit(0.0)] * 2, *[F.lit(1.0)] * 2, F.lit(0.0))) is None
    assert first(plane.normal_path(F.lit("../../a/./b/.."))) == "a" and first(plane.base36(F.lit(0))) == "0"
    assert first(plane.polyline_length(F.array().cast("array<struct<x:double,y:double,z:double>>"))) == 0.0


def test_merged_components_are_never_broadcast(spark, sf):
    from lithos.plans import topology as plans

    for part in topology.merge_assembly(plans.occurrences(spark, sf), plans.entities(spark, sf), plans.relations(spark, sf)):
        joins = [x for x in part._jdf.queryExecution().executedPlan().toString().splitlines() if "Broadcast" in x and "Join" in x]
        assert joins and all("[_p#" in x for x in joins)  # only the totals of partitions


def test_equal_ids_of_an_assembly(spark, sf):
    """Against all rows of an id: names borne twice within a component, and occurrences of one name."""
    from lithos.plans import topology as plans

    twice = F.when((F.col("kind") == "edge") & (F.col("row") % 3 == 1), F.col("ordinal") - 1).otherwise(F.col("ordinal"))
    e = plans.entities(spark, sf).filter("comp between 1 and 3").withColumn("ordinal", twice)
    occ = spark.createDataFrame([(9, "o1.1", 1), (1, "o1.2", 2), (5, "o1.1", 3), (7, "o1.1", 1), (3, "o1.1.f1", 1), (2, None, 1)], "seq long, occ string, comp long")
    occ = occ.withColumn("transform", F.array(*[F.lit(float(x % 5 == 0)) for x in range(16)]))
    rows = topology.merge_assembly(occ, e, plans.relations(spark, sf).filter("comp between 1 and 3"))[0].select("kind", "id", "row", "first").collect()
    least = {}
    for r in rows:
        least[r.kind, r.id] = min(r.row, least.get((r.kind, r.id), r.row))
    assert len(rows) == 5 * 27 and sum(not r.first for r in rows) == 2 * 27 + 3 * 4
    assert all(r.first == (r.row == least[r.kind, r.id]) for r in rows)


def test_decimation_asks_only_for_kept_places(spark, tmp_path):
    from lithos.registry import QUERIES

    keys = [0, 1, 22, 10**12]  # a list up to the last would be beyond any row
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in QUERIES["decimated"](spark, str(tmp_path)).collect()}
    assert got == {(k, 5, 1, k + 20, 1 + (k + 20) // 2) for k in keys}


def test_decimation_of_lists(spark):
    """Lists and places agree; short, empty and missing lists."""
    lists = spark.createDataFrame([(list(range(n)),) for n in range(30)] + [(None,)], "l array<int>")
    for most in (2, 3, 7):
        for r in lists.select("l", plane.decimate(F.col("l"), most).alias("a"), plane.decimate_by(F.size("l"), lambda i: i, most).alias("b")).collect():
            n = len(r.l or [])
            assert r.a == r.b == (r.l if r.l is None or n <= most else [math.floor(k * (n - 1) / (most - 1) + 0.5) for k in range(most)])
