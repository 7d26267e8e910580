"""Rules over robot descriptions as tables: links ``(link)`` and joints ``(joint, type, parent, child, lower, upper, axis, mimic, mass ...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as v
from .graph import closure

TYPES = ["fixed", "revolute", "continuous", "prismatic", "floating", "planar"]


def finding(df: DataFrame, code: str, subject: str, severity: str = "error") -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(subject).alias("subject"))


def joint_findings(joints: DataFrame) -> DataFrame:
    """Findings on single joints ``(joint, type, lower, upper, ax, ay, az, mimic)``."""
    moving = F.col("type").isin("revolute", "prismatic")
    axis = v.length((F.col("ax"), F.col("ay"), F.col("az")))
    bound = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    rules = {
        "unsupported_joint_type": ~F.coalesce(F.col("type").isin(TYPES), F.lit(False)),
        "missing_limit_bounds": moving & (F.col("lower").isNull() | F.col("upper").isNull()),
        "nonfinite_limit_bounds": bound(F.col("lower")) | bound(F.col("upper")),
        "reversed_limit_bounds": F.col("lower") > F.col("upper"),
        "fixed_joint_limits": (F.col("type") == "fixed") & (F.col("lower").isNotNull() | F.col("upper").isNotNull()),
        "continuous_position_limits": (F.col("type") == "continuous") & (F.col("lower").isNotNull() | F.col("upper").isNotNull()),
        "zero_joint_axis": (F.col("type") != "fixed") & (axis <= 1e-12),
        "non_unit_joint_axis": (F.col("type") != "fixed") & (axis > 1e-12) & (F.abs(axis - 1) > 1e-6),
        "self_mimic": F.col("mimic") == F.col("joint"),
    }
    codes = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return joints.select(F.lit("error").alias("severity"), F.explode(codes).alias("code"), F.col("joint").alias("subject"))


def inertia_findings(links: DataFrame) -> DataFrame:
    """Findings on ``(link, mass, ixx, iyy, izz, ixy, ixz, iyz)``."""
    e = v.symmetric_eigenvalues(*[F.col(c) for c in ("ixx", "iyy", "izz", "ixy", "ixz", "iyz")])
    rules = {
        "missing_mass": F.col("mass").isNull(), "nonpositive_mass": F.col("mass") <= 0,
        "nonpositive_inertia_diagonal": F.least("ixx", "iyy", "izz") <= 0, "inertia_not_psd": e[2] < -1e-12, "inertia_triangle_inequality": e[1] + e[2] < e[0] * (1 - 1e-9),
    }
    codes = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return links.select(F.lit("error").alias("severity"), F.explode(codes).alias("code"), F.col("link").alias("subject"))


def structure_findings(links: DataFrame, joints: DataFrame) -> DataFrame:
    """Findings on names, references and the tree that joints make of links."""
    twice = lambda df, c: df.groupBy(c).count().filter("count > 1")
    out = [finding(twice(links, "link"), "duplicate_link_name", "link"), finding(twice(joints, "joint"), "duplicate_joint_name", "joint")]
    out.append(finding(links.join(joints.select(F.col("joint").alias("link")), "link", "left_semi").distinct(), "joint_link_name_collision", "link"))
    for end in ("parent", "child"):
        out.append(finding(joints.join(links.withColumnRenamed("link", end), end, "left_anti"), f"missing_{end}_link", "joint"))
    out.append(finding(joints.groupBy("child").count().filter("count > 1"), "multiple_parents", "child"))
    edges = joints.select("parent", "child")
    out.append(finding(closure(edges).filter("ancestor = node"), "joint_graph_cycle", "node"))
    roots = links.join(joints.select(F.col("child").alias("link")), "link", "left_anti").distinct()
    out.append(finding(roots.withColumn("n", F.count("*").over(Window.partitionBy())).filter("n > 1"), "not_a_tree", "link"))
    mimics = joints.filter("mimic is not null").select("joint", "mimic", F.lit(1).alias("m"))
    out.append(finding(mimics.join(joints.select(F.col("joint").alias("mimic")), "mimic", "left_anti"), "missing_mimic_target", "joint"))
    out.append(finding(mimics.join(joints.filter("type = 'fixed'").select(F.col("joint").alias("mimic")), "mimic", "left_semi"), "mimic_of_fixed_joint", "joint"))
    out.append(finding(closure(mimics.filter("joint <> mimic").select(F.col("joint").alias("parent"), F.col("mimic").alias("child"))).filter("ancestor = node"), "mimic_cycle", "node"))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found.dropDuplicates()
