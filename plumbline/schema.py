"""Catalogues of the evidence engine: states, severities, rule codes and dtypes."""

from __future__ import annotations

import hashlib
import json

PRESENT, ABSENT, UNKNOWN = "PRESENT", "ABSENT", "UNKNOWN"

# Severities in ascending order, and codes by severity
SEVERITIES = ("info", "low", "medium", "high")
PYRAMID_CODES = {
    "high": "MULTISCALE_EMPTY LEVEL_MISSING LEVEL_NO_CHUNKS SEPARATOR_DRIFT DTYPE_DRIFT SCALE_SHAPE_MISMATCH DEGENERATE_LEVEL NDIM_DRIFT HEADERLESS_CHUNK_STORE METADATA_UNREADABLE PHYSICAL_SCALE_CONTRADICTION".split(),
    "medium": "LEVEL_UNDECLARED SCALE_NONMONOTONIC FILL_DRIFT MIXED_ROUNDING".split(),
    "low": "COMPRESSOR_DRIFT AXES_MISMATCH CONTAINER_NO_GROUP_HEADER ROOT_ABSENT EMPTY_ZARR_DIR TRANSFORM_SCALE_COUNT TRANSFORM_ARITY AXES_INVALID DIMENSION_NAMES_MISMATCH".split(),
    "info": "NOT_A_ZARR_GROUP NOT_MULTISCALE BARE_ARRAY CHUNK_EXCEEDS_SHAPE ACCESS_UNKNOWN PHYSICAL_SCALE_UNKNOWN OME_VERSION_UNMODELLED".split(),
}
CHUNK_CODES = {
    "info": "CHUNK_SAMPLE_POPULATED CHUNK_SAMPLE_EMPTY CHUNK_SAMPLE_MISSING CHUNK_SAMPLE_ABSENT CHUNK_LEVEL_NO_CHUNKS CHUNK_LEVEL_NO_SAMPLES".split(),
    "low": "CHUNK_UNDECODEABLE CHUNK_FETCH_ERROR".split(),
    "medium": "SHARD_INDEX_CHECKSUM_MISMATCH CHUNK_SAMPLE_ALL_EMPTY".split(),
}
SURFACE_CODES = {
    "low": "TIFXYZ_ABSENT TIFXYZ_META_INCOMPLETE TIFXYZ_SAMPLE_FORMAT TIFXYZ_INVALID_MASK_MISMATCH TIFXYZ_NONFINITE TIFXYZ_NEGATIVE_COORDINATE TIFXYZ_BBOX_MISMATCH TIFXYZ_TARGET_VOLUME_OVERRUN".split(),
    "medium": "TIFXYZ_META_MISSING TIFXYZ_META_UNREADABLE TIFXYZ_CHANNEL_MISSING TIFXYZ_TIFF_UNREADABLE TIFXYZ_CHANNEL_SHAPE_MISMATCH TIFXYZ_EMPTY".split(),
    "info": "TIFXYZ_CONTENT_UNDECODED ACCESS_UNKNOWN".split(),
}
GATE_CODES = {"high": "GATE_UNREADABLE GATE_ROOT_ABSENT AUDIT_ERROR GATE_VOXEL_SIZE_UNKNOWN GATE_VOXEL_SIZE_MISMATCH".split()}
#: Codes after which there is nothing to audit, so a root can't pass.
NOTHING_TO_AUDIT = ("ROOT_ABSENT", "EMPTY_ZARR_DIR", "TIFXYZ_ABSENT")
VERDICTS = {"FAIL": "DO NOT TRAIN", "UNKNOWN": "DO NOT TRAIN", "WARN": "CAUTION", "PASS": "DEFER_TO_QUALITY"}
#: dtype name: (kind, bytes)
DTYPES = {"|u1": ("u", 1), "|i1": ("i", 1), "<u2": ("u", 2), "<i2": ("i", 2), "<u4": ("u", 4), "<i4": ("i", 4), "<f4": ("f", 4), "<f8": ("f", 8), ">u2": ("u", 2), ">f4": ("f", 4), "uint8": ("u", 1), "int8": ("i", 1), "uint16": ("u", 2), "int16": ("i", 2), "uint32": ("u", 4), "int32": ("i", 4), "float32": ("f", 4), "float64": ("f", 8)}
# Micrometres per unit, for the names that are known
UNITS = (
    dict.fromkeys("um µm μm micron microns micrometer micrometers micrometre micrometres".split(), 1.0)
    | dict.fromkeys("nm nanometer nanometers nanometre nanometres".split(), 1e-3)
    | dict.fromkeys("mm millimeter millimeters millimetre millimetres".split(), 1e3)
    | dict.fromkeys("m meter meters metre metres".split(), 1e6)
)

SEVERITY = {code: severity for group in (PYRAMID_CODES, CHUNK_CODES, SURFACE_CODES, GATE_CODES) for severity, codes in group.items() for code in codes}
#: Severity of codes that are in no catalogue.
DEFAULT_SEVERITY = "medium"
#: Structure of a root's report.
REPORT = {
    "type": "object",
    "required": ["root", "integrity", "max_severity", "verdict", "coverage", "findings"],
    "additionalProperties": False,
    "properties": {
        "root": {"type": "string"},
        "integrity": {"enum": ["FAIL", "UNKNOWN", "WARN", "PASS"]},
        "max_severity": {"enum": ["none", *SEVERITIES]},
        "verdict": {"enum": sorted(set(VERDICTS.values()))},
        "coverage": {"type": "object", "additionalProperties": {"type": "integer"}},
        "findings": {"type": "array", "items": {"$ref": "#/$defs/finding"}},
    },
    "$defs": {
        "finding": {
            "type": "object",
            "required": ["level", "code", "severity", "evidence_state"],
            "additionalProperties": False,
            "properties": {"level": {"type": "string"}, "code": {"type": "string"}, "severity": {"enum": list(SEVERITIES)}, "evidence_state": {"enum": [PRESENT, ABSENT, UNKNOWN]}},
        }
    },
}


def fingerprint() -> str:
    """A short digest of codes, severities and verdicts, to notice changes of the contract."""
    text = json.dumps({"codes": SEVERITY, "order": SEVERITIES, "verdicts": VERDICTS}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:12]
