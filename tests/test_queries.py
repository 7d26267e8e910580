"""Every registered query of the library against its SQL, and operators against brute force."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lithos.functions import text as tx
from lithos.operators import boxes, cloud, graph, robots
from lithos.registry import ORACLES, QUERIES
from lithos.sources import points as src
from lithos.streaming import events

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = got.select(*want.columns).collect()
    assert Counter(tuple(map(plain, r)) for r in rows) == Counter(tuple(map(plain, r)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_nearest_is_exact(spark):
    rnd = random.Random(1)
    at = lambda s: tuple(rnd.gauss(0, s) for _ in "xyz")
    q = [(i, *at(1)) for i in range(60)] + [(99, 500.0, 0.0, -3.0)]
    t = [at(1) for _ in range(80)]
    got = {r.q: r.distance for r in cloud.nearest(spark.createDataFrame(q, "q long, x double, y double, z double"), spark.createDataFrame(t, "x double, y double, z double")).collect()}
    assert set(got) == {r[0] for r in q}
    for i, *p in q:
        assert math.isclose(got[i], min(math.dist(p, x) for x in t), rel_tol=1e-12)
    none = cloud.nearest(spark.createDataFrame(q[:2], "q long, x double, y double, z double"), spark.createDataFrame([], "x double, y double, z double"))
    assert [r.distance for r in none.collect()] == [None, None]


def test_distances_of_all_magnitudes(spark):
    at = lambda rows: spark.createDataFrame(rows, "q long, x double, y double, z double")
    for size in (1e-200, 1e200, 1e308, 5e-324, 1.0):
        d = cloud.nearest(at([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)]), at([(0, size, 0.0, 0.0)]).drop("q"))
        s = cloud.distance_statistics(d, size / 10 or 1.0).first()
        assert s.n == 2 and s.mean == s.rms == s.maximum == s.p50 == s.p99 == size and s.within_percent == (100.0 if size == 5e-324 else 0.0)
    mixed = cloud.nearest(at([(1, 0.0, 0.0, 0.0), (2, 1e200, 0.0, 1.0)]), at([(0, 1e-200, 0.0, 0.0), (0, 1e200, 0.0, 0.0)]).drop("q"))
    assert {r.q: r.distance for r in mixed.collect()} == {1: 1e-200, 2: 1.0}
    with pytest.raises(Exception, match="range"):
        cloud.nearest(at([(1, -1e308, 0.0, 0.0)]), at([(0, 1e308, 0.0, 0.0)]).drop("q")).collect()
    with pytest.raises(Exception, match="underflow"):
        cloud.distance_statistics(spark.createDataFrame([(0.0,)] * 99_999 + [(5e-324,)], "distance double"), 5e-324).collect()
    assert cloud.distance_statistics(spark.createDataFrame([], "distance double"), 1.0).count() == 0


def test_overlaps_are_exact(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(80):
        lo = [rnd.randrange(-8, 8) / 2 for _ in "xyz"]
        rows.append((i, *[x for a in lo for x in (a, a + rnd.choice([0.0, 0.5, 1.0]))]))
    df = spark.createDataFrame(rows, "id long, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")
    got = Counter((r.a, r.b) for r in boxes.overlaps(df, 0.7).collect())
    want = Counter((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and all(a[1 + 2 * k] <= b[2 + 2 * k] and b[1 + 2 * k] <= a[2 + 2 * k] for k in range(3)))
    assert got == want


def test_masks_are_checked():
    good = {"frame": "w", "include": [{"type": "sphere", "center": [0, 0, 0], "radius": 1}]}
    assert cloud.compile_mask(good, "w") is good
    for bad in ({"frame": "v"}, {"frame": "w", "more": 1}, {"frame": "w", "include": [{"type": "cone"}]}, {"frame": "w", "exclude": [{"type": "aabb", "min": [0, 0, 2], "max": [1, 1, 1]}]}, {"frame": "w", "include": [{"type": "sphere", "center": [0, 0, 0], "radius": True}]}, {"frame": "w", "include": [{"type": "sphere", "center": [0, 0, math.inf], "radius": 1}]}):
        with pytest.raises(ValueError):
            cloud.compile_mask(bad, "w")


def test_certificate_findings(spark):
    d = spark.createDataFrame([(i / 10,) for i in range(40)], "distance double")
    good = cloud.certificate(d, 1.0)
    assert cloud.verify_certificate(good).count() == 0
    broken = good.withColumn("sum", F.when(F.col("start_index") == 0, 99.0).otherwise(F.col("sum")))
    assert {r.code for r in cloud.verify_certificate(broken).collect()} == {"certificate_sum", "certificate_moments"}
    assert "certificate_blocks" in {r.code for r in cloud.verify_certificate(good.filter("start_index <> 0")).collect()}


def test_sample_does_not_depend_on_partitions(spark, sf):
    from lithos.plans.clouds import points

    p = points(spark, sf)
    one = cloud.hash_rank_sample(p, 20, "display", 3).select("idx").collect()
    assert one == cloud.hash_rank_sample(p.repartition(7), 20, "display", 3).select("idx").collect()
    assert one != cloud.hash_rank_sample(p, 20, "measurement", 3).select("idx").collect()
    assert cloud.merkle_fingerprint(p).first() == cloud.merkle_fingerprint(p.repartition(5)).first()


def test_point_files(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("﻿# note\n1 2 3 9\n\n// note\n4,5 ,6e-1\n; note\n")
    got = src.read_xyz(spark, str(tmp_path / "a.xyz")).orderBy("idx")
    assert [(r.idx, r.x, r.y, r.z) for r in got.collect()] == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 0.6)]
    src.write_xyz(got, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*"))) == "1 2 3\n4 5 0.59999999999999998\n"
    (tmp_path / "b.xyz").write_text("1 2 1e999\n")
    with pytest.raises(Exception, match="not a point"):
        src.read_xyz(spark, str(tmp_path / "b.xyz")).collect()
    ply = "ply\nformat ascii 1.0\ncomment c\nelement vertex 2\nproperty float x\nproperty float y\nproperty double z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0 255\n1 2.5 3 0\n3 0 1 0\n"
    (tmp_path / "c.ply").write_text(ply)
    assert [(r.x, r.y, r.z) for r in src.read_ply(spark, str(tmp_path / "c.ply")).orderBy("idx").collect()] == [(0, 0, 0), (1, 2.5, 3)]
    assert src.detect("q.ply") == "ply" and src.detect("q", "ply\n") == "ply" and src.detect("q.csv") == "xyz"
    for a, b in (("255", "256"), ("2.5", "nan"), ("3 0 1 0\n", "3 0 1\n"), ("3 0 1 0\n", "3 0 1 0\n7\n"), ("end_header\n", ""), ("float y", "list uchar int y"), ("vertex 2", "vertex 3"), ("ascii", "binary"), ("float y", "float x")):
        with pytest.raises(ValueError):
            src.parse_ply(ply.replace(a, b))
    assert src.source_identity(spark, str(tmp_path / "c.ply")).first().bytes == len(ply)


def test_robot_rules(spark):
    links = spark.createDataFrame([(x,) for x in ("base", "arm", "hand", "arm2", "arm2", "lone", "x")], "link string")
    j = "joint string, type string, parent string, child string, lower double, upper double, ax double, ay double, az double, mimic string"
    joints = spark.createDataFrame(
        [
            ("j1", "revolute", "base", "arm", 1.0, -1.0, 0.0, 0.0, 1.0, None), ("j2", "fixed", "arm", "hand", 0.0, None, 0.0, 0.0, 0.0, None), ("j3", "hinge", "arm", "hand", None, None, 0.0, 0.0, 1.0, "j3"),
            ("j4", "prismatic", "arm2", "gone", None, 1.0, 0.0, 0.0, 0.0, "j2"), ("j5", "continuous", "x", "x", None, 2.0, 0.0, 0.0, 2.0, "j6"), ("j6", "continuous", "gone2", "arm2", None, None, 1.0, 0.0, 0.0, "j5"), ("x", "fixed", "base", "arm2", None, None, 0.0, 0.0, 0.0, "none"),
        ],
        j,
    )
    got = {(r.code, r.subject) for r in robots.joint_findings(joints).collect()}
    assert got == {("reversed_limit_bounds", "j1"), ("fixed_joint_limits", "j2"), ("unsupported_joint_type", "j3"), ("self_mimic", "j3"), ("missing_limit_bounds", "j4"), ("zero_joint_axis", "j4"), ("continuous_position_limits", "j5"), ("non_unit_joint_axis", "j5")}
    got = {(r.code, r.subject) for r in robots.structure_findings(links, joints).collect()}
    assert got == {
        ("duplicate_link_name", "arm2"), ("joint_link_name_collision", "x"), ("missing_parent_link", "j6"), ("missing_child_link", "j4"), ("multiple_parents", "hand"), ("multiple_parents", "arm2"),
        ("joint_graph_cycle", "x"), ("not_a_tree", "base"), ("not_a_tree", "lone"), ("missing_mimic_target", "x"), ("mimic_of_fixed_joint", "j4"), ("mimic_cycle", "j5"), ("mimic_cycle", "j6"),
    }
    mass = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0), ("b", 0.0, 1.0, 1.0, 9.0, 0.0, 0.0, 0.0), ("c", None, 1.0, 1.0, 1.0, 3.0, 0.0, 0.0)], "link string, mass double, ixx double, iyy double, izz double, ixy double, ixz double, iyz double")
    assert {(r.code, r.subject) for r in robots.inertia_findings(mass).collect()} == {("nonpositive_mass", "b"), ("inertia_triangle_inequality", "b"), ("missing_mass", "c"), ("inertia_not_psd", "c"), ("inertia_triangle_inequality", "c")}


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent long, child long")
    got = {(r.ancestor, r.node): r.depth for r in graph.closure(e).collect()}
    assert got[1, 1] == 3 and got[1, 4] == 3 and (4, 1) not in got


def test_bodies_are_exact(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(55)] + [(200 + i, 201 + i) for i in range(20)]
    name = {n: n for link in links for n in link}
    while any(name[a] != name[b] for a, b in links):
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    assert {r.node: r.body for r in graph.bodies(spark.createDataFrame(links, "a long, b long")).collect()} == name


def test_merkle_of_several_levels(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = [f"{i} 0 0" for i in range(23)]
    between = "\n"
    while len(level) > 1:
        level, between = [sha(between.join(level[i : i + 3])) for i in range(0, len(level), 3)], ""
    got = cloud.merkle_fingerprint(spark.range(23).selectExpr("id AS idx", "double(id) AS x", "0D AS y", "0D AS z"), 3)
    assert [r.merkle for r in got.collect()] == level


def test_text_functions(spark):
    rows = spark.createDataFrame([(x,) for x in ("item10", "Item9", "item 2", "item-1", None)], "s string")
    assert [r.s for r in rows.filter("s is not null").orderBy(tx.natural_key("s")).collect()] == ["item 2", "item-1", "Item9", "item10"]
    docs = spark.createDataFrame([('{"b": 1, "a": [true]}',), ('{"a":[true],"b":1}',), ('{"a":1,"a":2}',), ("NaN",), (None,)], "s string")
    a, b, *rest = [r[0] for r in docs.select(tx.canonical_json_sha256("s")).collect()]
    assert a == b and rest == [None, None, None]
    n = spark.createDataFrame([("1.5",), ("1e999",), ("1e-999",), ("0e-999",), (" 1",), ("0x1",), ("1\n",), (".5",)], "s string")
    assert [r[0] for r in n.select(tx.strict_double(F.col("s"))).collect()] == [1.5, None, None, 0.0, None, None, None, 0.5]


def test_version_bumps(spark):
    says = {"feat: a": 1, "feat(x): a": 1, "feature: a": 0, "fix: a [minor]": 1, "x!: a": 2, "fix(a)!: b": 2, "fix: a\n\nBREAKING CHANGE: b": 2, "a\nBREAKING-CHANGE:": 2, "fix: BREAKING CHANGE: b": 0, "\n feat: a": 1, "fix: a\n\nfeat: b": 0, "": 0}
    rows = spark.createDataFrame([(m, r) for m, r in says.items()], "m string, r int")
    assert rows.filter(tx.bump_rank(F.col("m")) != F.col("r")).count() == 0
    v = spark.createDataFrame([("1.2.3", 2), ("1.2.3", 1), ("1.2.9", 0), ("1.2", 0), ("01.2.3", 0)], "v string, r int")
    assert [r[0] for r in v.select(tx.bumped(F.col("v"), F.col("r"))).collect()] == ["2.0.0", "1.3.0", "1.2.10", None, None]


def test_streams_agree_with_tables(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = events.hourly(stream, "1000 days").writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    out.processAllAvailable()
    out.stop()
    assert Counter(map(plain, (tuple(r)[:3] for r in spark.sql("SELECT * FROM hourly").collect()))) == Counter(map(plain, (tuple(r)[:3] for r in events.hourly(table).collect())))
    cmds = spark.createDataFrame([(1, 1, "G91"), (1, 2, "M82"), (2, 1, "M83"), (1, 3, "G90"), (2, 2, "G1")], "program long, line long, command string")
    cmds.write.parquet(str(tmp_path / "cmds"))
    s = spark.readStream.schema(cmds.schema).parquet(str(tmp_path / "cmds"))
    q = events.modes(s).writeStream.format("memory").queryName("modes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM modes").collect()} == {(1, 1, False, False), (1, 2, False, True), (1, 3, True, True), (2, 1, True, False), (2, 2, True, False)}
