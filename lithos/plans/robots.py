"""Queries over robot descriptions: each nation lends a sound robot, and one for each way to break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import robot_files as rf
from ..operators import world_files as wf
from ..registry import query, table

_INERTIAL = '<inertial><mass value="1"/><inertia ixx="1" ixy="0" ixz="0" iyy="1" iyz="0" izz="1"/></inertial>'
_BOX = '<visual><geometry><box size="1 1 1"/></geometry><material name="red"/></visual>'
_MESH = '<collision><geometry><mesh filename="package://kit/arm.stl"/></geometry></collision>'
_J1 = '<joint name="j1" type="revolute"><parent link="base"/><child link="arm"/><axis xyz="0 0 1"/><limit lower="-1" upper="1" effort="1" velocity="1"/></joint>'
_J2 = '<joint name="j2" type="prismatic"><parent link="arm"/><child link="tip"/><axis xyz="1 0 0"/><limit lower="0" upper="2" effort="1" velocity="1"/><mimic joint="j1"/></joint>'
_J3 = '<joint name="j3" type="fixed"><parent link="base"/><child link="foot"/></joint>'
URDF = f'<robot name="NAME"><material name="red"><color rgba="1 0 0 1"/></material><link name="base"/><link name="arm">{_INERTIAL}{_BOX}</link><link name="tip">{_INERTIAL}{_MESH}</link><link name="foot"/>{_J1}{_J2}{_J3}</robot>'
_MESH_URI = 'filename="package://kit/arm.stl"'

#: What is replaced by what, and the findings that follow.
URDF_CASES: list[tuple[str, str, str]] = [
    ("", "", ""), ("</robot>", "", "invalid_xml"), ("robot", "robots", "invalid_root"), ('"NAME"', '" "', "missing_robot_name"), ("</robot>", "<lnk/></robot>", "unknown_element"),
    ("</robot>", "<x:y xmlns:x='u'/><!-- c --></robot>", ""), ('<link name="foot"/>', "<link/>", "missing_link_name missing_child_link"), ('<link name="foot"/>', '<link name="foot"/><link name="foot"/>', "duplicate_link_name"),
    (URDF[URDF.index("<link") : URDF.index("<joint")], "", "no_links missing_parent_link missing_child_link"), (_INERTIAL, _INERTIAL * 2, "duplicate_inertial"), ('<mass value="1"/>', "", "missing_mass"),
    ('<mass value="1"/>', '<mass value="0"/>', "nonpositive_mass"), ('<mass value="1"/>', "<mass/>", "missing_attribute"), ('<mass value="1"/>', '<mass value="x"/>', "invalid_number"), ('<mass value="1"/>', '<mass value="inf"/>', "nonfinite_number"),
    (_INERTIAL, '<inertial><mass value="1"/></inertial>', "missing_inertia"), ('ixx="1"', 'ixx="-1"', "nonpositive_inertia_diagonal"), ('ixy="0"', 'ixy="2"', "inertia_not_psd"), ('izz="1"', 'izz="3"', "inertia_triangle_inequality"),
    (_INERTIAL, "", "missing_inertial"), ('<geometry><box size="1 1 1"/></geometry>', "", "missing_geometry"), ('<box size="1 1 1"/>', "", "invalid_geometry_count"), ('<box size="1 1 1"/>', "<cone/>", "unsupported_geometry"),
    ('<box size="1 1 1"/>', '<box size="1 0 1"/>', "nonpositive_dimension"), ('<box size="1 1 1"/>', '<box size="1 1"/>', "wrong_vector_size"), ('<box size="1 1 1"/>', '<cylinder radius="1"/>', "missing_attribute"),
    ('<material name="red"/>', '<material name="blue"/>', "dangling_material"), (_MESH_URI, "", "missing_mesh_filename"), (_MESH_URI, 'filename="package://kit/../x.stl"', "invalid_mesh_uri"), (_MESH_URI, 'filename="package://kit/arm.xyz"', "unknown_mesh_extension missing_mesh_file"),
    (_MESH_URI, 'filename="http://h/arm.stl"', "unresolved_mesh_uri"), (_MESH_URI, 'filename="package://box/arm.stl"', "unresolved_mesh_uri"), (_MESH_URI, 'filename="arm2.stl"', "missing_mesh_file"), (_MESH_URI, 'filename="near.stl"', ""),
    (_MESH_URI, _MESH_URI + ' scale="1 0 1"', "zero_mesh_scale"), (_MESH_URI, _MESH_URI + ' scale="1 -1 1"', "negative_mesh_scale"), ('<joint name="j3"', "<joint", "missing_joint_name"), ('type="fixed"', 'type="ball"', "unsupported_joint_type"),
    ('<axis xyz="0 0 1"/>', "", "implicit_joint_axis"), ('<axis xyz="0 0 1"/>', '<axis xyz="0 0 0"/>', "zero_joint_axis"), ('<axis xyz="0 0 1"/>', '<axis xyz="0 0 2"/>', "non_unit_joint_axis"), ('<child link="foot"/>', "", "missing_joint_parent_child"),
    ('<parent link="base"/><child link="foot"/>', '<parent link="moon"/><child link="foot"/>', "missing_parent_link"), ('<child link="foot"/>', '<child link="moon"/>', "missing_child_link"), ('<child link="foot"/>', '<child link="arm"/>', "multiple_parents"),
    (_J3, "", "not_a_tree"), ('<link name="foot"/>', '<link name="foot"/><link name="a"/><link name="b"/>', "not_a_tree"),
    (_J3, _J3 + '<joint name="x" type="fixed"><parent link="b"/><child link="a"/></joint><joint name="y" type="fixed"><parent link="a"/><child link="b"/></joint><link name="a"/><link name="b"/>', "disconnected_links"),
    ('name="j3"', 'name="j1"', "duplicate_joint_name mimic_of_fixed_joint"), ('name="j3"', 'name="foot"', "joint_link_name_collision"), ("</joint></robot>", "<limit/></joint></robot>", "fixed_joint_limits"),
    ('type="revolute"', 'type="continuous"', "continuous_position_limits"), ('<limit lower="-1" upper="1" effort="1" velocity="1"/>', "", "missing_joint_limit"), ('lower="-1" ', "", "missing_limit_bounds"), ('lower="-1"', 'lower="x"', "invalid_limit_bounds"),
    ('lower="-1"', 'lower="nan"', "nonfinite_limit_bounds"), ('lower="-1"', 'lower="2"', "reversed_limit_bounds"), (' effort="1"', "", "missing_effort"), (' velocity="1"', "", "missing_velocity"), ('effort="1"', 'effort="-1"', "negative_effort"),
    ('velocity="1"', 'velocity="-1"', "negative_velocity"), ('<axis xyz="0 0 1"/>', '<axis xyz="0 0 1"/><dynamics damping="-1"/>', "negative_damping"), ('<axis xyz="0 0 1"/>', '<axis xyz="0 0 1"/><dynamics friction="-1"/>', "negative_friction"),
    ('<mimic joint="j1"/>', "<mimic/>", "missing_mimic_joint"), ('<mimic joint="j1"/>', '<mimic joint="j2"/>', "self_mimic"), ('<mimic joint="j1"/>', '<mimic joint="j9"/>', "missing_mimic_target"), ('<mimic joint="j1"/>', '<mimic joint="j3"/>', "mimic_of_fixed_joint"),
    ('<axis xyz="0 0 1"/>', '<axis xyz="0 0 1"/><mimic joint="j2"/>', "mimic_cycle"), ('<mimic joint="j1"/>', '<mimic joint="j1" offset="x"/>', "invalid_number"), ('<axis xyz="0 0 1"/>', '<axis xyz="0 0 1"/><origin rpy="0 0"/>', "wrong_vector_size"),
]

_GROUP = '<group name="all"><joint name="j1"/><group name="hand"/></group><group name="hand"><link name="foot"/></group>'
_STATE = '<group_state name="home" group="all"><joint name="j1" value="0.5"/></group_state>'
_EFFECT = '<end_effector name="e" group="hand" parent_link="base"/>'
_PAIR = '<disable_collisions link1="base" link2="arm" reason="Adjacent"/>'
_VIRTUAL = '<virtual_joint name="v" type="fixed" parent_frame="w" child_link="base"/>'
SRDF = f'<robot name="NAME">{_GROUP}{_VIRTUAL}{_EFFECT}{_STATE}{_PAIR}</robot>'
SRDF_CASES: list[tuple[str, str, str]] = [
    ("", "", ""), ("</robot>", "", "invalid_xml"), ("robot", "robots", "invalid_root"), ('"NAME"', '""', "missing_robot_name"), ("</robot>", "<grp/></robot>", "unknown_element"), ("</robot>", "<u:urdf xmlns:u='u'/></robot>", "deprecated_urdf_link"),
    ('<link name="foot"/>', '<link name="foot"/><lnk/>', "unknown_element"), ('<group name="hand"><', "<group><", "missing_group_name"), (_GROUP, _GROUP + '<group name="hand"/>', "duplicate_name"), ('<virtual_joint name="v"', "<virtual_joint", "missing_virtual_joint_name"),
    ('type="fixed"', 'type="ball"', "invalid_virtual_joint_type"), (' parent_frame="w"', "", "missing_parent_frame"), (' child_link="base"', "", "missing_child_link"), ("</robot>", "<passive_joint/></robot>", "missing_passive_joint_name"),
    ('<end_effector name="e"', "<end_effector", "missing_end_effector_name"), ('<group_state name="home"', "<group_state", "missing_group_state_identity"), ('<joint name="j1" value', "<joint value", "missing_group_state_joint_name"),
    ('value="0.5"', 'value="x"', "invalid_group_state_value"), ('value="0.5"', 'value="inf"', "nonfinite_group_state_value"), (' link2="arm"', "", "missing_collision_pair_links"), ('link2="arm"', 'link2="base"', "self_collision_pair"),
    (' reason="Adjacent"', "", "missing_collision_pair_reason"), (_STATE, _STATE * 2, "duplicate_name"),
]
PAIR_CASES: list[tuple[str, str, str]] = [
    ("", "", ""), (_GROUP + _VIRTUAL + _EFFECT + _STATE, "", "no_planning_groups"), ('<link name="foot"/>', "", "empty_group"), ('<link name="foot"/>', '<link name="moon"/>', "missing_name_reference end_effector_parent_link_not_adjacent"),
    ('<link name="foot"/>', '<chain base_link="base" tip_link="moon"/>', "missing_chain_link end_effector_parent_link_not_adjacent"), ('<link name="foot"/>', '<link name="foot"/><chain base_link="arm" tip_link="foot"/>', "chain_not_a_path"),
    ('child_link="base"', 'child_link="moon"', "missing_virtual_joint_child"), ('<virtual_joint name="v"', '<virtual_joint name="j1"', "virtual_joint_name_collision"), ("</robot>", '<passive_joint name="j9"/></robot>', "missing_passive_joint"),
    ('parent_link="base"', 'parent_link="moon"', "missing_end_effector_parent_link end_effector_parent_link_not_adjacent"), ('group="hand" parent', 'group="fist" parent', "missing_end_effector_group"), (_EFFECT, _EFFECT.replace("/>", ' parent_group="fist"/>'), "missing_end_effector_parent_group"),
    (_EFFECT, _EFFECT.replace("/>", ' parent_group="all"/>'), "end_effector_group_overlap end_effector_parent_link_outside_parent_group"), ('parent_link="base"', 'parent_link="tip"', "end_effector_parent_link_not_adjacent"),
    ('name="home" group="all"', 'name="home" group="none"', "missing_group_state_group"), ('<joint name="j1" value', '<joint name="j9" value', "missing_group_state_joint incomplete_group_state"), ("</robot>", '<passive_joint name="j1"/></robot>', "group_state_sets_passive_joint"),
    ('value="0.5"/>', 'value="0.5"/><joint name="j3" value="0"/>', "group_state_sets_fixed_joint"), ('value="0.5"/>', 'value="0.5"/><joint name="j2" value="0"/>', "group_state_sets_mimic_joint"), ('name="home" group="all"', 'name="home" group="hand"', "group_state_joint_not_in_group"),
    ('value="0.5"', 'value="1.5"', "group_state_above_limit"), ('value="0.5"', 'value="-1.5"', "group_state_below_limit"), ('link1="base" link2="arm"', 'link1="base" link2="tip"', "adjacent_reason_mismatch"),
    ('<link name="foot"/>', '<link name="foot"/><group name="all"/>', "subgroup_cycle"), (_PAIR, "".join(f'<disable_collisions link1="base" link2="n{i}" reason="Manual: {i}"/>' for i in range(25)), "many_manual_disabled_pairs missing_name_reference"),
    ('"NAME"', '"NAME lost"', "no_paired_urdf"), ('"NAME"', '"NAME twin"', "ambiguous_paired_urdf"), ('"NAME"', '"NAME bad"', "invalid_paired_urdf"), ('"NAME"', '"NAME wood"', "paired_urdf_not_a_tree end_effector_parent_link_not_adjacent"),
]


def _cases(spark, sf_dir, base: str, cases: list[tuple[str, str, str]], suffix: str) -> DataFrame:
    rows = [(i, base.replace(a, b, 1) if a and a != "robot" else base.replace("<robot ", "<robots ").replace("</robot>", "</robots>") if a else base) for i, (a, b, _) in enumerate(cases)]
    texts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("xml")) for i, x in rows])
    each = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(texts).alias("t"))
    return each.select(F.concat(F.lit("/robots/"), "n_nationkey", F.lit("/"), "t.i", F.lit(suffix)).alias("doc"), F.replace("t.xml", F.lit("NAME"), F.concat(F.lit("R"), "n_nationkey")).alias("xml"))


def _expected(cases: list[tuple[str, str, str]], suffix: str) -> str:
    rows = ", ".join(f"({i}, '{code}')" for i, (_, _, codes) in enumerate(cases) for code in codes.split())
    return f"SELECT '/robots/' || n_nationkey || '/' || i || '{suffix}' AS doc, code FROM nation, (VALUES {rows}) t(i, code)"


@query(_expected(URDF_CASES, ".urdf"))
def urdf_rules(spark, sf_dir):
    """Codes found on each broken robot; none on the sound ones."""
    docs = _cases(spark, sf_dir, URDF, URDF_CASES, ".urdf")
    files = ["/kit/arm.stl", *[f"/robots/{r.k}/near.stl" for r in table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).collect()]]  # the 25 nations
    return rf.urdf_findings(docs, files, {"kit": "/kit"}).select("doc", "code").distinct()


@query(_expected(SRDF_CASES, ".srdf"))
def srdf_rules(spark, sf_dir):
    return rf.srdf_findings(_cases(spark, sf_dir, SRDF, SRDF_CASES, ".srdf")).select("doc", "code").distinct()


@query(_expected(PAIR_CASES, ".srdf"))
def srdf_against_urdf(spark, sf_dir):
    k = F.concat(F.lit("R"), "n_nationkey")
    models = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("xml")) for n, x in (
        ("a", URDF), ("b", URDF.replace("NAME", "NAME twin")), ("c", URDF.replace("NAME", "NAME twin")), ("d", URDF.replace("NAME", "NAME bad").replace("</robot>", "")), ("e", URDF.replace("NAME", "NAME wood").replace(_J3, "")),
    )])
    each = table(spark, sf_dir, "nation").select("n_nationkey", k.alias("k"), F.explode(models).alias("m"))
    urdf = each.select(F.concat("k", F.lit("/"), "m.n", F.lit(".urdf")).alias("doc"), F.replace("m.xml", F.lit("NAME"), F.col("k")).alias("xml"))
    return rf.paired_findings(_cases(spark, sf_dir, SRDF, PAIR_CASES, ".srdf"), urdf).select("doc", "code").distinct()


@query(f"WITH f AS (SELECT i, codes, codes IN ({', '.join(repr(w) for w in ('dangling_material', 'implicit_joint_axis', 'missing_inertial'))}) AS warn FROM (VALUES {', '.join(f'({i}, {c!r})' for i, (_, _, c) in enumerate(URDF_CASES) if c in ('', 'dangling_material', 'implicit_joint_axis', 'missing_inertial', 'missing_mass'))}) t(i, codes)) SELECT '/robots/' || n_nationkey || '/' || i || '.urdf' AS doc, (codes = 'missing_mass')::BIGINT AS errors, warn::BIGINT AS warnings, codes = '' AS ok FROM nation, f")
def strict_verdicts(spark, sf_dir):
    """Files that pass if warnings count as failures."""
    keep = [i for i, (_, _, c) in enumerate(URDF_CASES) if c in ("", "dangling_material", "implicit_joint_axis", "missing_inertial", "missing_mass")]
    docs = _cases(spark, sf_dir, URDF, URDF_CASES, ".urdf").filter(F.regexp_extract("doc", r"/([0-9]+)\.urdf$", 1).cast("int").isin(keep))
    return rf.verdicts(docs, rf.urdf_findings(docs, None, {"kit": "/kit"}), strict=True)


_FRAMES = '<frame name="f"/><frame name="g" attached_to="f"/>'
_BODY = "<inertial><mass>1</mass><inertia><ixx>1</ixx><iyy>1</iyy><izz>1</izz><ixy>0</ixy><ixz>0</ixz><iyz>0</iyz></inertia></inertial>"
_SHAPE = '<visual name="v"><geometry><mesh><uri>arm.stl</uri></mesh></geometry></visual><collision name="c"><geometry><box><size>1 1 1</size></box></geometry></collision>'
_SENSOR = '<sensor name="s" type="imu"><update_rate>5</update_rate></sensor>'
_AXIS = "<axis><xyz>0 0 1</xyz><limit><lower>-1</lower><upper>1</upper><effort>-1</effort></limit><dynamics><damping>0</damping></dynamics></axis>"
_JOINT = f'<joint name="j" type="revolute"><parent>base</parent><child>arm</child>{_AXIS}</joint>'
SDF = f'<sdf version="1.9"><model name="NAME"><pose>0 0 0 0 0 0</pose><static>false</static>{_FRAMES}<link name="base"/><link name="arm">{_BODY}{_SHAPE}{_SENSOR}</link>{_JOINT}<plugin name="p" filename="p.so"/></model></sdf>'
_POSE = "<pose>0 0 0 0 0 0</pose>"
_BOX_SIZE = "<box><size>1 1 1</size></box>"
SDF_CASES: list[tuple[str, str, str]] = [
    ("", "", ""), ("</sdf>", "", "invalid_xml"), (SDF, "<sd/>", "invalid_root"), (' version="1.9"', "", "missing_version"), ("1.9", "v1", "unusual_version"), ("1.9", "2.9", "unknown_sdf_version"), (SDF, '<sdf version="1.9"/>', "empty_document"),
    ("</sdf>", '<model name="NAME"><include><uri>u</uri></include></model></sdf>', "duplicate_names"), (' name="NAME"', "", "missing_name"), ("</sdf>", '<model name="m2"/></sdf>', "empty_model"), ("</model>", "<lnk/></model>", "unknown_element"),
    ("</model>", "<x:y xmlns:x='u'/><!-- c --></model>", ""), ('name="g"', 'name="arm"', "cross_type_name_collision"), ("false", "maybe", "invalid_boolean"), ("<static>false</static>", "<static>true</static>", ""), (_BODY, "", "missing_inertial"),
    ('<frame name="f"/>', '<frame name="f" attached_to="g"/>', "frame_cycle"), ('attached_to="f"', 'attached_to="q"', "unresolved_reference"), ('attached_to="f"', 'attached_to="a::b"', "scoped_reference_unchecked"), ('attached_to="f"', 'attached_to="a::"', "invalid_scoped_reference"),
    (_POSE, "<pose>1 0 0 0 0 0</pose>", "pose_missing_relative_to"), (_POSE, '<pose relative_to="f">1 0 0 0 0 0</pose>', ""), (_POSE, "<pose>0 0 0</pose>", "invalid_numeric_vector"), (_POSE, "<pose>0 0 0 x 0 0</pose>", "invalid_number"), (_POSE, "<pose>0 0 0 inf 0 0</pose>", "invalid_number"),
    (_POSE, '<pose rotation_format="axis">0</pose>', "unsupported_rotation_format"), (_POSE, '<pose rotation_format="quat_xyzw" relative_to="f">0 0 0 0 0 0 0</pose>', "zero_quaternion"), (_POSE, '<pose rotation_format="quat_xyzw" relative_to="f">0 0 0 0 0 0 2</pose>', "non_unit_quaternion"),
    (_POSE, '<pose degrees="maybe">0 0 0 0 0 0</pose>', "invalid_pose_degrees"), (_POSE, '<pose degrees="true">0 0 0 0 0 0</pose>', "pose_uses_degrees"), (' type="revolute"', "", "missing_joint_type"), ('type="revolute"', 'type="hinge"', "unknown_joint_type"), (_AXIS, "", "missing_joint_axis"),
    (_AXIS, _AXIS + _AXIS.replace("axis>", "axis2>"), "unsupported_axis2"), ("<xyz>0 0 1</xyz>", "", "missing_axis_xyz"), ("<xyz>0 0 1</xyz>", "<xyz>0 0 0</xyz>", "zero_axis"), ("<xyz>0 0 1</xyz>", "<xyz>0 0 2</xyz>", "non_unit_axis"), ("<xyz>0 0 1</xyz>", '<xyz expressed_in="q">0 0 1</xyz>', "unresolved_reference"),
    ("<lower>-1<", "<lower>2<", "invalid_joint_limit"), ("<lower>-1<", "<lower>-inf<", ""), ("<lower>-1<", "<lower>nan<", "invalid_number"), ("<effort>-1<", "<effort>-2<", "negative_effort"), ("<effort>-1</effort>", "<velocity>-3</velocity>", "negative_velocity"), ("<effort>-1</effort>", "<stiffness>-1</stiffness>", "negative_stiffness"),
    ("<effort>-1</effort>", "<dissipation>-1</dissipation>", "negative_dissipation"), ("<damping>0<", "<damping>-1<", "negative_damping"), ("<damping>0</damping>", "<friction>-1</friction>", "negative_friction"), ('type="revolute"', 'type="continuous"', "continuous_joint_limits"),
    ("<geometry><mesh><uri>arm.stl</uri></mesh></geometry>", "", "invalid_geometry_count"), (_BOX_SIZE, "<cone/>", "invalid_geometry_shape"), (_BOX_SIZE, "<box/>", "missing_numeric_vector"), (_BOX_SIZE, "<box><size>1 0 1</size></box>", "invalid_dimension"), (_BOX_SIZE, "<sphere/>", "missing_number"),
    (_BOX_SIZE, "<sphere><radius>0</radius></sphere>", "invalid_dimension"), (_BOX_SIZE, "<mesh><uri>arm.stl</uri></mesh>", "collision_reuses_visual_mesh"), ("<uri>arm.stl</uri>", "", "missing_child_text"), ("arm.stl", "gone.stl", "missing_mesh_file"), ("arm.stl", "ftp://h/arm.stl", "unresolved_mesh_uri_scheme"),
    ("arm.stl", "model://arm.stl", ""), ("</uri></mesh>", "</uri><scale>1 0 1</scale></mesh>", "zero_mesh_scale"), ("</uri></mesh>", "</uri><scale>1 -1 1</scale></mesh>", "negative_mesh_scale"), ("<mass>1<", "<mass>0<", "invalid_mass"), (_BODY, "<inertial><mass>1</mass></inertial>", "missing_inertia_matrix"),
    ("<ixy>0<", "<ixy>2<", "invalid_inertia_matrix"), ("<izz>1<", "<izz>3<", "inertia_triangle_inequality"), (' type="imu"', "", "missing_sensor_type"), ('type="imu"', 'type="imuu"', "unknown_sensor_type"), ("<update_rate>5<", "<update_rate>-5<", "invalid_sensor_update_rate"),
    (' filename="p.so"', "", "missing_plugin_filename"), ('<plugin name="p"', "<plugin", "missing_plugin_name"), ("<child>arm<", "<child>moon<", "missing_link_reference"), ("<child>arm<", "<child>world<", "invalid_joint_child"), ("<parent>base<", "<parent>world<", ""), ("<parent>base<", "<parent>a::b<", "scoped_link_reference_unchecked"),
    ("</sdf>", '<world name="w"><light name="l" type="sun"/><frame name="a"/></world></sdf>', "unknown_light_type"), ("</sdf>", '<world name="w"><light name="l"/></world></sdf>', "missing_light_type"), ("</sdf>", "<include/></sdf>", "missing_child_text"),
]


@query(_expected(SDF_CASES, ".sdf"))
def sdf_rules(spark, sf_dir):
    files = [f"/robots/{r.k}/arm.stl" for r in table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).collect()]  # the 25 nations
    return wf.sdf_findings(_cases(spark, sf_dir, SDF, SDF_CASES, ".sdf"), files).select("doc", "code").distinct()
