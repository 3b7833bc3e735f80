"""Header scan: the documents of each root, read on executors, as the relations of the rules.

One task reads some roots; a root takes a handful of small reads, each a row of evidence whether it
succeeds or not, and never any chunk data. A failure is evidence, not an exception, so a scan
doesn't end because a store does.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transport import observe, open_store

PYRAMID = "state string, reason string, error string, has_multiscales boolean, is_group boolean, multiscales_key boolean, node_kind string, version string, has_transforms boolean, axes array<string>, axis_types array<string>, axis_units array<string>, unit string, marker string, dirs_beyond array<int>"
LEVEL = (
    "idx int, path string, present boolean, state string, reason string, shape array<bigint>, chunks array<bigint>, dtype string, fill_value string, compressor_id string, separator string, "
    "declared_scale array<double>, has_chunks boolean, chunk_state string, zarr_format int, dimension_names array<string>, transforms array<struct<kind:string,len:int>>"
)
#: What a root is before anything of it is known.
EMPTY = {"state": "PRESENT", "reason": None, "error": None, "has_multiscales": False, "is_group": False, "multiscales_key": False, "node_kind": "unknown", "has_transforms": False}
#: Names that are no chunks, and the headers among them.
METADATA = (".zarray", ".zattrs", ".zgroup", ".zmetadata", "zarr.json")
CHUNK = re.compile(r"\d+(\.\d+)+")
#: Level directories looked for beyond the declared ones; listings larger than this are not asked for.
BEYOND, MOST_FLAT_KEYS = 3, 250_000


class Reader:
    """Documents of one store by path; each is read once."""

    def __init__(self, store):
        self.store, self.seen = store, {}

    def json(self, path: str) -> tuple[dict | list | None, str, str | None]:
        """(document, state, reason)"""
        if path not in self.seen:
            row = observe(self.store, "json", path)
            ok = row["state"] == "PRESENT" and row["reason"] is None
            self.seen[path] = (json.loads(row["body"]) if ok else None, row["state"], row["reason"] or (row["error"] if row["state"] == "UNKNOWN" else None))
        return self.seen[path]

    def entries(self, path: str) -> tuple[list[str] | None, str]:
        row = observe(self.store, "list", path)
        return row["entries"], row["state"]


def _numbers(value, kind) -> list | None:
    try:
        return [kind(v) for v in value] if isinstance(value, list) else None
    except (TypeError, ValueError):
        return None


def _compressor(header: dict) -> str:
    if "codecs" in header:
        return ",".join(str(c.get("name", "?")) for c in header["codecs"] or [] if isinstance(c, dict)) or "none"
    c = header.get("compressor")
    if not c:
        return "none"
    level = c.get("clevel", c.get("level"))
    return ":".join([str(c.get("id", "?")), *([c["cname"]] if c.get("cname") else []), *([f"l{level}"] if level is not None else [])])


def _array(header: dict) -> dict:
    """Level columns of an array header of either format."""
    v3 = header.get("zarr_format") == 3
    grid = (header.get("chunk_grid") or {}).get("configuration", {}).get("chunk_shape") if v3 else header.get("chunks")
    encoding = (header.get("chunk_key_encoding") or {}).get("configuration", {}) if v3 else {}
    fill = header.get("fill_value")
    return {
        "zarr_format": 3 if v3 else 2,
        "shape": _numbers(header.get("shape"), int),
        "chunks": _numbers(grid, int),
        "dtype": header.get("data_type" if v3 else "dtype"),
        "fill_value": None if fill is None else fill if isinstance(fill, str) else json.dumps(fill),
        "compressor_id": _compressor(header),
        "separator": encoding.get("separator", "/") if v3 else header.get("dimension_separator", "."),
        "dimension_names": header.get("dimension_names"),
    }


def _header(read: Reader, path: str) -> tuple[dict | None, str, str | None]:
    """The array header at a path: the older format first, the newer one only where that is absent."""
    doc, state, reason = read.json(f"{path}/.zarray")
    return (doc, state, reason) if state != "ABSENT" else read.json(f"{path}/zarr.json")


def _chunks(read: Reader, path: str, level: dict) -> tuple[bool | None, str]:
    """Whether a level's folder holds chunks; unknown unless a listing that shows the header proves it."""
    shape, chunks = level["shape"] or [], level["chunks"] or []
    if len(shape) == len(chunks) and all(c > 0 for c in chunks) and level["separator"] == "." and level["zarr_format"] == 2 and math.prod(max(1, -(-s // c)) for s, c in zip(shape, chunks)) > MOST_FLAT_KEYS:
        return None, "UNKNOWN"
    names, state = read.entries(path)
    if state != "PRESENT" or not {".zarray", "zarr.json"} & set(names):
        return None, "UNKNOWN"
    return (True, "PRESENT") if [n for n in names if n not in METADATA] else (False, "ABSENT")


def _level(read: Reader, root: str, idx: int, dataset: dict) -> dict:
    path = str(dataset.get("path", idx))
    given = dataset.get("coordinateTransformations")
    transforms = [(t["type"], t.get(t["type"])) for t in given if isinstance(t, dict) and t.get("type") in ("scale", "translation")] if isinstance(given, list) else []
    doc, state, reason = _header(read, f"{root}/{path}")
    out = {"idx": idx, "path": path, "present": doc is not None, "state": state, "reason": reason, "chunk_state": "UNKNOWN"}
    out["transforms"] = [{"kind": kind, "len": len(payload) if isinstance(payload, list) else None} for kind, payload in transforms]
    out["declared_scale"] = next((s for kind, v in transforms if kind == "scale" and (s := _numbers(v, float))), None)
    if isinstance(doc, dict):
        out |= _array(doc)
        out["has_chunks"], out["chunk_state"] = _chunks(read, f"{root}/{path}", out)
    return out


def _kind(read: Reader, root: str) -> tuple[str, str]:
    """(node kind, state) of a root that is no group."""
    names, listed = read.entries(root)
    if listed == "UNKNOWN":
        return "unknown", "UNKNOWN"
    if listed == "ABSENT":
        return "absent", "ABSENT"
    if not names:
        return "empty", "ABSENT"
    if any(CHUNK.fullmatch(n) for n in names) and not set(METADATA) & set(names):
        return "headerless_chunks", "PRESENT"
    folders = [n.rstrip("/") for n in names if n.endswith("/")][:4]
    if any(_header(read, f"{root}/{n}")[0] is not None or read.json(f"{root}/{n}/.zgroup")[0] is not None for n in folders):
        return "container", "PRESENT"
    return "unknown", "PRESENT"


def scan_root(store, root: str) -> dict:
    """{pyramid, levels} of one root."""
    read, root = Reader(store), root.rstrip("/")
    group, g_state, g_reason = read.json(f"{root}/.zgroup")
    attrs, a_state, a_reason = read.json(f"{root}/.zattrs") if g_state == "PRESENT" else (None, "ABSENT", None)
    newer, n_state, n_reason = read.json(f"{root}/zarr.json") if g_state == "ABSENT" else (None, "ABSENT", None)
    array, r_state, _ = read.json(f"{root}/.zarray") if g_state == n_state == "ABSENT" else (None, "ABSENT", None)
    out = EMPTY | {"axes": [], "axis_types": [], "axis_units": [], "dirs_beyond": []}
    states = [g_state, a_state, n_state, r_state]
    if "METADATA_UNREADABLE" in (g_reason, a_reason, n_reason):
        return {"pyramid": out | {"reason": "METADATA_UNREADABLE"}, "levels": []}
    if "UNKNOWN" in states:
        return {"pyramid": out | {"state": "UNKNOWN", "reason": next((r for r in (g_reason, a_reason, n_reason) if r), "TRANSPORT_ERROR")}, "levels": []}
    if isinstance(newer, dict) and newer.get("node_type") == "array" or array is not None:
        return {"pyramid": out | {"node_kind": "array"}, "levels": []}
    if group is None and newer is None:
        kind, state = _kind(read, root)
        return {"pyramid": out | {"node_kind": kind, "state": state, "reason": "TRANSPORT_ERROR" if state == "UNKNOWN" else None}, "levels": []}
    attrs = (newer.get("attributes") or {}) if isinstance(newer, dict) else attrs or {}
    ome = attrs.get("ome") if isinstance(attrs.get("ome"), dict) else {}
    blocks = attrs.get("multiscales", ome.get("multiscales"))
    out |= {"is_group": True, "multiscales_key": blocks is not None}
    ms = blocks[0] if isinstance(blocks, list) and blocks and isinstance(blocks[0], dict) else {}
    datasets = [d for d in ms.get("datasets") or [] if isinstance(d, dict)]
    if not datasets:
        return {"pyramid": out, "levels": []}
    axes = [a if isinstance(a, dict) else {"name": str(a)} for a in ms.get("axes") or []]
    units = [a["unit"] for a in axes if (a.get("type") == "space" or str(a.get("name")).lower() in ("x", "y", "z")) and str(a.get("unit") or "").strip()]
    version = ome.get("version", ms.get("version", "coordinateSystems" if "coordinateSystems" in ms else None))
    out["has_transforms"] = any("coordinateTransformations" in d for d in datasets)
    out |= {"has_multiscales": True, "version": None if version is None else str(version), "axes": [str(a.get("name", "?")) for a in axes], "axis_types": [a.get("type") for a in axes], "axis_units": [u if isinstance(u := a.get("unit"), str) else None for a in axes], "unit": units[0] if units else None}
    out["marker"] = (ms.get("metadata") or {}).get("physical_size") if isinstance(ms.get("metadata"), dict) else None
    levels = [_level(read, root, i, d) for i, d in enumerate(datasets)]
    if all(lv["path"].isdigit() for lv in levels):
        for j in range(1, BEYOND + 1):
            if _header(read, f"{root}/{max(int(lv['path']) for lv in levels) + j}")[0] is None:
                break
            out["dirs_beyond"].append(j)
    return {"pyramid": out, "levels": levels}


def scan(roots: DataFrame, base: str, root_col: str = "root", replay: str | None = None, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pyramids, levels) of the roots in a store: relations for ``rules.audit``.

    The observations are stored once, as reading them again could find another state.
    """
    from . import store_table

    def run(batches):
        import pandas as pd

        store = open_store(base, replay)
        for b in batches:
            docs = []
            for root in b["root"]:
                try:
                    docs.append(json.dumps(scan_root(store, root)))
                except Exception as e:  # a root that breaks the scan is a finding of its own
                    docs.append(json.dumps({"pyramid": EMPTY | {"reason": "AUDIT_ERROR", "error": repr(e)[:200]}, "levels": []}))
            yield pd.DataFrame({"root": b["root"], "doc": docs})

    rows = roots.select(F.col(root_col).alias("root")).distinct()
    rows = rows.repartition(tasks) if tasks else rows
    found = store_table(rows.mapInPandas(run, "root string, doc string"))
    doc = found.select("root", F.from_json("doc", f"pyramid struct<{_fields(PYRAMID)}>, levels array<struct<{_fields(LEVEL)}>>").alias("d"))
    return doc.select("root", "d.pyramid.*"), doc.select("root", F.inline("d.levels"))


def _fields(ddl: str) -> str:
    return re.sub(r"(\w+) (\w)", r"\1: \2", ddl)
