"""Queries over feature contracts: each region lends a sound one, and one for each way to break it."""

from __future__ import annotations

import copy
import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contract as ct
from ..registry import query, table

GONE = object()
_hash = lambda c: c * 64
_box = lambda frame, lo, hi: {"frame": frame, "min": [lo] * 3, "max": [hi] * 3}
_file = lambda c, kind="ply": {"sha256": _hash(c), "byte_count": 100, "format": kind}


def _defined(definition: dict) -> dict:
    text = json.dumps(definition, sort_keys=True, separators=(",", ":"))
    return {"definition": definition, "definition_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _sample(role: str, c: str, n: int, method: str, **parameters: object) -> dict:
    return {
        "role": role, "artifact": _file(c), "canonical_points_sha256": _hash("a"), "source_sha256": _hash("1"), "source_point_count": 50, "point_count": n, "frame": "scan", "bounds": _box("scan", -1, 4), "method": method,
        "algorithm_version": "v1", "seed": 3, "parameters": parameters,
    }


def sound() -> dict:
    frame = lambda name: {"id": name, "handedness": "right", "x_axis": "right", "y_axis": "back", "z_axis": "up"}
    move = lambda d: [1, 0, 0, d, 0, 1, 0, d, 0, 0, 1, d, 0, 0, 0, 1]
    mask = lambda name, role, definition, **more: {"id": name, "role": role, "component_id": "lid", "frame": "cad", **_defined(definition), **more}
    return {
        "schema_version": "1.0.0", "contract_id": "lid-contract", "units": {"linear": "mm", "angular": "deg"}, "frames": [frame("scan"), frame("cad"), frame("far")],
        "transforms": [{
            "id": "move", "from_frame": "scan", "to_frame": "cad", "layout": "row-major", "vector_convention": "column-vector", "translation_units": "contract-linear-units", "transform_type": "rigid", "matrix": move(5), "inverse_matrix": move(-5),
            "reflection_allowed": False, "held_out_count": 4, "round_trip_max": 0, "round_trip_tolerance": 1e-6, "conditioning": {"norm": "infinity", "condition_number": 1, "reciprocal_condition": 1, "evidence": "norms"},
        }],
        "source": {"artifact": _file("1"), "canonical_points_sha256": _hash("a"), "point_count": 50, "point_record": "xyz", "frame": "scan", "bounds": _box("scan", -1, 4), "units_status": "verified", "units_evidence": "gauge"},
        "samples": {"measurement": _sample("measurement", "2", 50, "full"), "display": _sample("display", "3", 20, "hash-rank", target_count=20)},
        "authority": {
            "kind": "step_brep", "artifact": _file("4", "step"), "producer": {"tool": "maker", "tool_version": "2", "kernel": "OCCT 7"}, "replay_source_sha256": _hash("6"),
            "validation_sample": {"artifact": _file("5"), "point_count": 9, "frame": "cad", "bounds": _box("cad", 4, 9), "derivation": {"method": "mesh-vertices", "source_authority_sha256": _hash("4"), "algorithm_version": "v1", "parameters_sha256": _hash("8")}},
            "independent_reopen": {"passed": True, "tool": "other", "tool_version": "1", "kernel": "opencascade", "validation_tier": "alternate-importer"}, "brep_validation": {"valid_solid": True, "solid_count": 1, "volume": 3.5, "unsupported_freeform_surface_count": 0},
        },
        "components": [{"id": "lid", "frame": "cad", "authority_sha256": _hash("4"), "primitive_chain": ["extrude"], "included_features": ["rim"], "excluded_features": ["tab"]}],
        "parameters": [{"id": "width", "component_id": "lid", "unit": "mm", "raw_fit": 2.02, "regularized": 2, "fit_uncertainty": 0.1, "regularization_reason": "as drawn", "evidence_mask_ids": ["rim-mask"]}],
        "masks": [mask("whole", "global", {"type": "aabb", "min": [0, 0, 0], "max": [9, 9, 9]}), mask("rim-mask", "critical-feature", {"type": "sphere", "center": [1, 1, 1], "radius": 2}, feature_id="rim"), mask("seen", "observed-surface", {"type": "external", "artifact_sha256": _hash("7")})],
        "exclusions": [{"id": "clamp", "mask_id": "seen", "reason": "fixture", "rationale": "a clamp", "approved": True}],
        "uncertainty": {
            "unit": "mm", "model": "rss-independent", "confidence_level": 0.95, "combined_standard_uncertainty": math.hypot(0.03, 0.04), "coverage_factor": 2, "expanded_uncertainty": 2 * math.hypot(0.03, 0.04),
            "components": [{"id": "one", "kind": "scanner", "standard_uncertainty": 0.03, "evidence": "sheet"}, {"id": "two", "kind": "fit", "standard_uncertainty": 0.04, "evidence": "residual"}],
        },
        "validation": {},
    }


_S, _A, _V, _U, _T = "samples/measurement", "authority", "authority/validation_sample", "uncertainty", "transforms/0"
_MESH = {"triangle_count": 4, "degenerate_triangle_count": 0, "boundary_edge_count": 0, "non_manifold_edge_count": 0, "consistent_winding": True}
_FUSION = {"fresh_source_rebuild": True, "edit_restore_probe": True, "source_outputs_fresh": True, "feature_count": 1, "body_count": 1, "build_warning_count": 0}
_BLEND = {"fresh_process_reopen": True, "native_object_count": 1, "evaluation_canary": True}
_CHAIN = {"operation_chain_sha256": _hash("9"), "deterministic_replay": True, "replay_count": 2}


def _as(kind: str, form: str, key: str, gate: dict, **change: object) -> dict:
    return {f"{_A}/kind": kind, f"{_A}/artifact/format": form, f"{_A}/{key}": gate | change}


def _masked(n: int, eligible: int, target: int) -> dict:
    return {"samples/display/method": "masked-hash-rank", "samples/display/point_count": n, "samples/display/parameters": {"target_count": target, "eligible_count": eligible, "mask_sha256": _hash("b")}}


_ALIKE = _defined({"type": "aabb", "min": [0, 0, 0.0], "max": [9, 9, 9]})
#: Members that are set, and the findings that follow.
CASES: list[tuple[dict, str]] = [
    ({}, ""), ({"more": 1}, "structure.additional_property"), ({"exclusions": GONE}, "structure.required structure.array"), ({"schema_version": "2"}, "schema.version"), ({"contract_id": "Lid"}, "structure.id"), ({"units/linear": "ft"}, "units.linear uncertainty.unit parameter.unit_conversion"),
    ({"units/angular": "turn"}, "units.angular"), ({"units": 3}, "structure.object units.linear units.angular uncertainty.unit parameter.unit_conversion"), ({"frames/0/handedness": "both"}, "frame.handedness"), ({"frames/1/x_axis": " "}, "frame.axis"), ({"frames/2/id": "cad"}, "reference.duplicate_id"),
    ({"source/artifact/format": "stl"}, "source.format"), ({"source/artifact/format": "!"}, "source.format structure.format"), ({"source/artifact/media_type": "text"}, "structure.media_type"), ({"source/artifact/byte_count": 0}, "structure.minimum"), ({"source/artifact/byte_count": 1.5}, "structure.integer"),
    ({"source/artifact/sha256": "x"}, "structure.sha256 lineage.source_hash"), ({"source/point_record": "rgb"}, "source.point_record"), ({"source/frame": "moon"}, "reference.frame reference.bounds_frame reference.transform_path sampling.full_frame"), ({"source/bounds/frame": "cad"}, "reference.bounds_frame"),
    ({"source/bounds/max/1": -2}, "geometry.bounds_order sampling.bounds_containment sampling.full_bounds"), ({"source/bounds/max/1": "x"}, "structure.number sampling.full_bounds"), ({"source/bounds/max": [1]}, "structure.vector3 sampling.full_bounds"), ({"source/units_status": "sure"}, "source.units_status"), ({"source/units_evidence": ""}, "source.units_evidence"),
    ({f"{_S}/role": "display"}, "sampling.role"), ({f"{_S}/artifact/format": "stl"}, "sampling.format"), ({f"{_S}/source_sha256": _hash("0")}, "lineage.source_hash"), ({f"{_S}/source_point_count": 49}, "lineage.source_count sampling.count sampling.full_count"), ({f"{_S}/point_count": 49}, "sampling.full_count"),
    ({f"{_S}/frame": "cad", f"{_S}/bounds/frame": "cad"}, "sampling.full_frame"), ({f"{_S}/frame": "far", f"{_S}/bounds/frame": "far"}, "sampling.full_frame reference.transform_path"), ({f"{_S}/bounds/min/0": -3}, "sampling.bounds_containment sampling.full_bounds"), ({f"{_S}/method": "dice"}, "sampling.method"),
    ({f"{_S}/algorithm_version": "V 1"}, "sampling.algorithm_version"), ({f"{_S}/seed": -1}, "structure.minimum"), ({f"{_S}/canonical_points_sha256": _hash("b")}, "sampling.full_order"), ({f"{_S}/parameters": {"target_count": 50}}, "sampling.full_parameters"), ({f"{_S}/method": "voxel-first"}, "structure.number"),
    ({f"{_S}/method": "voxel-first", f"{_S}/parameters": {"voxel_size": 0.5}}, ""), ({f"{_S}/method": "hash-rank", f"{_S}/parameters": {"target_count": 60}}, "sampling.full_method"), ({"samples/display/parameters/target_count": 19}, "sampling.target_count sampling.algorithm_count"), ({"samples/display/parameters/target_count": 30}, "sampling.algorithm_count"),
    (_masked(20, 30, 20), ""), (_masked(20, 10, 20), "sampling.eligible_count sampling.algorithm_count"), (_masked(20, 60, 20), "sampling.eligible_count"), ({"samples/display/parameters/eligible_count": 30}, "sampling.mask_method"), ({"samples/display/artifact/sha256": _hash("2")}, "sampling.role_identity"),
    ({f"{_A}/kind": "clay"}, "authority.kind"), ({f"{_A}/artifact/format": "dwg"}, "authority.format"), ({f"{_V}/artifact/format": "stl"}, "authority.sample_format"), ({f"{_V}/frame": "scan"}, "reference.bounds_frame"), ({f"{_V}/derivation/method": "guess"}, "authority.sample_method"),
    ({f"{_V}/derivation/algorithm_version": ""}, "authority.algorithm_version"), ({f"{_V}/derivation/source_authority_sha256": _hash("0")}, "lineage.authority_sample"), ({f"{_A}/independent_reopen/passed": False}, "authority.reopen"), ({f"{_A}/independent_reopen/validation_tier": "none"}, "authority.validation_tier"),
    ({f"{_A}/producer/kernel": "own"}, "authority.kernel_identity"), ({f"{_A}/producer/kernel": "Parasolid 35"}, "authority.kernel_lineage"), ({f"{_A}/independent_reopen/tool": "Maker"}, "authority.importer_lineage"), ({f"{_A}/independent_reopen/validation_tier": "cross-kernel"}, "authority.kernel_lineage"),
    ({f"{_A}/independent_reopen/validation_tier": "cross-kernel", f"{_A}/producer/kernel": "Spatial ACIS"}, ""), ({f"{_A}/independent_reopen/validation_tier": "same-kernel-fresh-process"}, "authority.same_kernel_only"), ({f"{_A}/brep_validation/valid_solid": False}, "authority.valid_solid"), ({f"{_A}/brep_validation/volume": 0}, "structure.minimum"),
    (_as("fusion_f3d", "f3d", "fusion_validation", _FUSION), ""), (_as("fusion_f3d", "f3d", "fusion_validation", _FUSION, edit_restore_probe=False), "authority.fusion_gate"), (_as("fusion_f3d", "f3d", "fusion_validation", _FUSION, build_warning_count=2), "authority.fusion_warnings"),
    (_as("blend_scene", "blend", "blend_validation", _BLEND), ""), (_as("blend_scene", "blend", "blend_validation", _BLEND, evaluation_canary=False), "authority.blend_gate"), (_as("occt_operation_chain", "json", "operation_chain_validation", _CHAIN), ""),
    (_as("occt_operation_chain", "json", "operation_chain_validation", _CHAIN, deterministic_replay=False), "authority.replay"), (_as("occt_operation_chain", "json", "operation_chain_validation", _CHAIN, replay_count=1), "structure.minimum"), (_as("procedural_mesh", "stl", "mesh_validation", _MESH), ""),
    (_as("procedural_mesh", "stl", "mesh_validation", _MESH, boundary_edge_count=2), "authority.mesh_structure"), (_as("procedural_mesh", "stl", "mesh_validation", _MESH, consistent_winding=False), "authority.mesh_winding"),
    ({"components": []}, "structure.min_items component.contract_scope reference.component"), ({"components/0/frame": "far"}, "reference.transform_path"), ({"components/0/authority_sha256": _hash("0")}, "lineage.authority_hash"), ({"components/0/primitive_chain/0": ""}, "component.primitive"), ({"components/0/excluded_features": ["rim"]}, "component.feature_overlap"),
    ({"masks/2/role": "art"}, "mask.role"), ({"masks/2/frame": "moon"}, "reference.frame"), ({"masks/2/component_id": "cup"}, "reference.component"), ({"masks/0/component_id": None}, "mask.component"), ({"masks/1/feature_id": "nose"}, "reference.feature"), ({"masks/2/feature_id": "rim"}, "mask.feature_scope"),
    ({"masks/0/definition/min/0": 10}, "geometry.bounds_order lineage.mask_hash"), ({"masks/1/definition/radius": 3}, "lineage.mask_hash"), ({"masks/1/definition/type": "cone"}, "mask.definition lineage.mask_hash"), ({"masks/1/definition": _ALIKE["definition"], "masks/1/definition_sha256": _ALIKE["definition_sha256"]}, "mask.critical_scope"),
    ({"parameters/0/component_id": "cup"}, "reference.component lineage.parameter_mask_component"), ({"parameters/0/unit": "ft"}, "parameter.unit"), ({"parameters/0/unit": "cm"}, "parameter.unit_conversion"), ({"parameters/0/unit": "rad"}, "parameter.unit_conversion"), ({"parameters/0/raw_fit": "2"}, "parameter.value"),
    ({"parameters/0/regularization_reason": ""}, "parameter.regularization_reason"), ({"parameters/0/raw_fit": [1, 2], "parameters/0/regularized": [1, 2.0], "parameters/0/regularization_reason": GONE}, ""), ({"parameters/0/evidence_mask_ids": ["none"]}, "reference.mask"), ({"parameters/0/fit_uncertainty": -1}, "structure.minimum"),
    ({"exclusions/0/mask_id": "none"}, "reference.mask"), ({"exclusions/0/reason": "dull"}, "exclusion.reason"), ({"exclusions/0/rationale": " "}, "exclusion.rationale"), ({"exclusions/0/approved": "yes"}, "exclusion.approval"), ({f"{_U}/unit": "m"}, "uncertainty.unit"), ({f"{_U}/model": "hope"}, "uncertainty.model uncertainty.combination"),
    ({f"{_U}/model": "worst-case"}, "uncertainty.combination"), ({f"{_U}/model": "reported-only"}, ""), ({f"{_U}/confidence_level": 2}, "uncertainty.confidence"), ({f"{_U}/components/0/kind": "luck"}, "uncertainty.kind"), ({f"{_U}/components/0/evidence": ""}, "uncertainty.evidence"), ({f"{_U}/components/0/standard_uncertainty": 1}, "uncertainty.combination"),
    ({f"{_U}/expanded_uncertainty": 1}, "uncertainty.expansion"), ({f"{_U}/coverage_factor": 0.5}, "structure.minimum"), ({f"{_T}/layout": "column-major"}, "transform.layout"), ({f"{_T}/to_frame": "moon"}, "reference.frame reference.transform_path"), ({f"{_T}/inverse_matrix/3": 9}, "transform.inverse transform.cycle"),
    ({f"{_T}/round_trip_max": 1}, "transform.round_trip"), ({f"{_T}/conditioning/condition_number": 2}, "transform.conditioning"), ({f"{_T}/matrix/0": 1.0000000001}, "transform.not_rigid"), ({"source/units_evidence": "see /home/me/x"}, "privacy.absolute_path"), ({"validation": {"token": "x", "api_key": "x"}}, "privacy.secret_field"),
]


def _changed(changes: dict) -> str:
    doc = copy.deepcopy(sound())
    for path, value in changes.items():
        *way, last = path.split("/")
        at = doc
        for part in way:
            at = at[int(part)] if isinstance(at, list) else at[part]
        if value is GONE:
            del at[last]
        else:
            at[int(last) if isinstance(at, list) else last] = value
    return json.dumps(doc)


def documents(spark, sf_dir) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_changed(c)).alias("text")) for i, (c, _) in enumerate(CASES)])
    return table(spark, sf_dir, "region").select("r_regionkey", F.explode(each).alias("t")).select(F.concat("r_regionkey", F.lit("/"), "t.i").alias("doc"), "t.text")


_ROWS = ", ".join(f"({i}, '{c}')" for i, (_, codes) in enumerate(CASES) for c in codes.split())


@query(f"SELECT r_regionkey || '/' || i AS doc, code FROM region, (VALUES {_ROWS}) t(i, code)")
def contract_rules(spark, sf_dir):
    """Codes found on each broken contract; none on the sound ones."""
    return ct.contract_findings(documents(spark, sf_dir)).select("doc", "code").distinct()
