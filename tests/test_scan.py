"""Header scans of random pyramids: sound ones give no finding, and breaking one rule at a random
place gives exactly what that rule says."""

import json
import random

import pytest

from plumbline import schema
from plumbline.plans import rules
from plumbline.sources import scan

RANDOM = 12  # pyramids by way of breaking


class Pyramid:
    """A sound pyramid of random rank, depth, extents and layout."""

    def __init__(self, rnd):
        self.rnd, self.newer = rnd, rnd.random() < 0.5
        rank, depth = rnd.randint(3, 4), rnd.randint(3, 5)
        self.axes = [{"name": n, "type": "space"} for n in rnd.sample("zyxw", 3)]
        if rank == 4:
            self.axes.insert(0, {"name": "c", "type": "channel"})
        self.version = "0.5" if self.newer else rnd.choice(["0.4", "0.4.1"])
        self.marker, self.extra = None, []
        base = [rnd.randrange(60, 400) for _ in range(rank)]
        self.levels = [
            {
                "shape": [-(-n // 2**k) for n in base],
                "chunks": [rnd.randrange(1, 4) for _ in range(rank)],
                "dtype": "uint8" if self.newer else "|u1",
                "fill": 0,
                "codec": "gzip",
                "separator": "/",
                "transforms": [{"type": "scale", "scale": [2.0**k] * rank}],
                "names": True,
                "chunky": True,
                "route": None,
            }
            for k in range(depth)
        ]

    @property
    def rank(self):
        return len(self.levels[0]["shape"])

    def pick(self, first=0):
        return self.rnd.randrange(first, len(self.levels))

    def header(self, lv):
        if not self.newer:
            return {"zarr_format": 2, "shape": lv["shape"], "chunks": lv["chunks"], "dtype": lv["dtype"], "fill_value": lv["fill"], "compressor": {"id": lv["codec"]}, "order": "C", "filters": None, "dimension_separator": lv["separator"]}
        names = {"dimension_names": [a["name"] for a in self.axes]} if lv["names"] is True else {"dimension_names": lv["names"]} if lv["names"] else {}
        encoding = {"name": "default", "configuration": {"separator": lv["separator"]}}
        grid = {"name": "regular", "configuration": {"chunk_shape": lv["chunks"]}}
        return {"zarr_format": 3, "node_type": "array", "shape": lv["shape"], "data_type": lv["dtype"], "chunk_grid": grid, "chunk_key_encoding": encoding, "fill_value": lv["fill"], "codecs": [{"name": lv["codec"]}]} | names

    def routes(self, root):
        file = "zarr.json" if self.newer else ".zarray"
        datasets = [{"path": str(k)} | ({} if lv["transforms"] is None else {"coordinateTransformations": lv["transforms"]}) for k, lv in enumerate(self.levels)]
        ms = {"axes": self.axes, "datasets": datasets} | ({"metadata": {"physical_size": self.marker}} if self.marker else {})
        version = {} if self.version is None else {"version": self.version}
        out = {}
        if self.newer:
            out[f"{root}/zarr.json"] = {"json": {"zarr_format": 3, "node_type": "group", "attributes": {"ome": version | {"multiscales": [ms]}}}}
        else:
            out[f"{root}/.zgroup"] = {"json": {"zarr_format": 2}}
            out[f"{root}/.zattrs"] = {"json": {"multiscales": [ms | version]}}
        for k, lv in enumerate(self.levels):
            out[f"{root}/{k}/{file}"] = lv["route"] or {"json": self.header(lv)}
            out[f"{root}/{k}"] = {"text": f'<a href="{file}">h</a>' + '<a href="0/">0</a>' * lv["chunky"]}
        for k in self.extra:
            out[f"{root}/{len(self.levels) - 1 + k}/{file}"] = {"json": self.header(self.levels[-1])}
        return out


def sound(p):
    return set()


def on_level(code, first=0, more=(), **change):
    """A rule that one level breaks by itself."""

    def broken(p):
        k = p.pick(first)
        p.levels[k] |= {name: make(p, p.levels[k]) if callable(make) else make for name, make in change.items()}
        return {(c, str(k)) for c in (code, *more)}

    return broken


def on_root(code, first=0, **change):
    def broken(p):
        p.levels[p.pick(first)] |= change
        return {(code, "")}

    return broken


def beyond(*places):
    def broken(p):
        p.extra = list(places)
        last, found = len(p.levels) - 1, [j for j in places if set(range(1, j + 1)) <= set(places)]
        return {("LEVEL_UNDECLARED", str(last + j)) for j in found}

    return broken


def fewer_axes(p):
    p.levels[-1]["shape"], p.levels[-1]["chunks"] = p.levels[-1]["shape"][1:], p.levels[-1]["chunks"][1:]
    return {("NDIM_DRIFT", "")}


def stalled(p):
    last, before = p.levels[-1], p.levels[-2]
    last |= {"shape": before["shape"], "transforms": before["transforms"]}
    return {("SCALE_NONMONOTONIC", str(len(p.levels) - 1))}


def both_roundings(p):
    for k, lv in enumerate(p.levels):
        lv["shape"] = [81 if k == 1 else 161 // 2**k] * p.rank  # up at the first halving, down after it
    return {("MIXED_ROUNDING", "")}


def renamed(p):
    p.axes[-1] = p.axes[-1] | {"name": p.axes[-2]["name"]}
    return {("AXES_INVALID", "")}


def axis_left_out(p):
    p.axes = p.axes[1:] if p.rank == 4 else p.axes[:2]
    return {("AXES_MISMATCH", "0")}


def unordered(p):
    p.axes = [*p.axes, {"name": "t", "type": "time"}]  # time comes first in the model
    for lv in p.levels:
        lv["shape"], lv["chunks"] = [*lv["shape"], 5], [*lv["chunks"], 1]
        lv["transforms"] = [{"type": "scale", "scale": [*lv["transforms"][0]["scale"], 1.0]}]
    return {("AXES_INVALID", "")}


def newer_version(p):
    p.version, p.levels[1]["transforms"] = p.rnd.choice(["0.6", "0.11", "2.0"]), []
    return {("OME_VERSION_UNMODELLED", "")}


def names_differ(p):
    if not p.newer:
        return set()
    k = p.pick()
    p.levels[k]["names"] = p.rnd.choice([None, [a["name"] for a in reversed(p.axes)]])
    return {("DIMENSION_NAMES_MISMATCH", str(k))}


def no_transforms_by(version):
    """Nothing asks for transforms: an old version, or none in a pyramid that has none anywhere."""

    def broken(p):
        p.newer, p.version = False, version
        for lv in p.levels:
            lv |= {"transforms": None, "dtype": "|u1"}
        return set()

    return broken


def transforms_somewhere(p):
    p.newer, p.version, k = False, None, p.pick()
    for j, lv in enumerate(p.levels):
        lv |= {"dtype": "|u1"} | ({} if j == k else {"transforms": None})
    return {("TRANSFORM_SCALE_COUNT", str(j)) for j in range(len(p.levels)) if j != k}


def scales(n):
    return lambda p, lv: [*([lv["transforms"][0]] * n), {"type": "translation", "translation": [0.5] * p.rank}]


def also(kind, payload):
    return lambda p, lv: [*lv["transforms"], {"type": kind, kind: payload(p) if callable(payload) else payload}]


def unknown_size(unit=None, axis=None, scale=None):
    def broken(p):
        p.marker, contradiction = "unknown", False
        if unit is not None:
            at = p.rnd.randrange(len(p.axes) - 3, len(p.axes))
            p.axes[at] = p.axes[at] | {"unit": unit} | (axis or {})
            if axis:  # told by names alone
                p.axes = [{**a, "type": None} for a in p.axes]
            contradiction = bool(unit.strip()) and p.axes[at].get("type") == "space"
        if scale is not None:
            for lv in p.levels:
                lv["transforms"] = [{"type": "scale", "scale": [s * scale for s in lv["transforms"][0]["scale"]]}]
            contradiction = scale != 1
        if axis:
            p.newer, p.version = False, "0.3"
            for lv in p.levels:
                lv["dtype"] = "|u1"
        return {("PHYSICAL_SCALE_CONTRADICTION" if contradiction else "PHYSICAL_SCALE_UNKNOWN", "0")}

    return broken


def unreadable_axes(p):
    p.axes = 7
    for lv in p.levels:
        lv["names"] = None
    return {("AUDIT_ERROR", "")}


WAYS = {
    "sound": sound,
    "missing": on_level("LEVEL_MISSING", route={"status": 404}),
    "refused": on_level("ACCESS_UNKNOWN", route={"status": 503}),
    "cut_short": on_level("METADATA_UNREADABLE", route={"text": '{"zarr'}),
    "nothing_in_it": on_level("DEGENERATE_LEVEL", 1, ("SCALE_SHAPE_MISMATCH",), shape=lambda p, lv: [0, *lv["shape"][1:]]),
    "header_alone": on_level("LEVEL_NO_CHUNKS", chunky=False),
    "one_beyond": beyond(1),
    "gap_beyond": beyond(1, 3),
    "only_after_a_gap": beyond(2),
    "rank": fewer_axes,
    "dtype": on_root("DTYPE_DRIFT", dtype="<u2"),
    "fill": on_root("FILL_DRIFT", fill=9),
    "codec": on_root("COMPRESSOR_DRIFT", codec="zstd"),
    "separator": on_root("SEPARATOR_DRIFT", separator="."),
    "stalled": stalled,
    "extent": on_level("SCALE_SHAPE_MISMATCH", 1, shape=lambda p, lv: [n + 3 for n in lv["shape"]]),
    "roundings": both_roundings,
    "wide_chunks": on_level("CHUNK_EXCEEDS_SHAPE", chunks=lambda p, lv: [2 * n for n in lv["shape"]]),
    "two_axes_of_a_name": renamed,
    "axis_left_out": axis_left_out,
    "time_last": unordered,
    "newer_version": newer_version,
    "names_differ": names_differ,
    "old_without_transforms": no_transforms_by("0.3"),
    "undeclared_without_transforms": no_transforms_by(None),
    "undeclared_with_some": transforms_somewhere,
    "no_scale": on_level("TRANSFORM_SCALE_COUNT", transforms=scales(0)),
    "scales": on_level("TRANSFORM_SCALE_COUNT", transforms=scales(2)),
    "short_move": on_level("TRANSFORM_ARITY", transforms=also("translation", lambda p: [1.0] * (p.rank - 1))),
    "move_by_a_number": on_level("TRANSFORM_ARITY", transforms=also("translation", 3.0)),
    "scale_by_a_number": on_level("TRANSFORM_ARITY", transforms=[{"type": "scale", "scale": 2.0}]),
    "size_unknown": unknown_size(),
    "size_unknown_but_unit": unknown_size("micrometer"),
    "size_unknown_blank_unit": unknown_size("  "),
    "unit_on_other_axis": unknown_size("second", {"name": "xy", "type": None}),
    "size_unknown_but_scaled": unknown_size(scale=2.5),
    "scan_breaks": unreadable_axes,
}


def integrity_of(found):
    severities = {schema.SEVERITY[code] for code, _ in found}
    return "FAIL" if "high" in severities else "UNKNOWN" if "ACCESS_UNKNOWN" in {c for c, _ in found} else "WARN" if "medium" in severities else "PASS"


def judged(spark, routes, roots):
    pyramids, levels = scan.scan(spark.createDataFrame([(r,) for r in roots], "root string"), "http://store", replay=json.dumps(routes), tasks=8)
    found = rules.audit(pyramids, levels)
    by = {r: set() for r in roots}
    for r in found.collect():
        by[r.root].add((r.code, r.level))
    return by, {r.root: r.integrity for r in rules.integrity(pyramids, found).collect()}


@pytest.fixture(scope="module")
def everything(spark):
    rnd, routes, wanted = random.Random(20), {}, {}
    for way, broken in WAYS.items():
        for i in range(RANDOM):
            p, root = Pyramid(rnd), f"{way}-{i}"
            wanted[root] = broken(p)
            routes |= p.routes(root)
    return wanted, *judged(spark, routes, list(wanted))


@pytest.mark.parametrize("way", WAYS)
def test_what_one_fault_gives(everything, way):
    wanted, found, integrity = everything
    for root in (f"{way}-{i}" for i in range(RANDOM)):
        assert found[root] == wanted[root], root
        assert integrity[root] == integrity_of(wanted[root]), root


def test_each_rule_alone_gives_its_part(spark):
    rnd, routes, roots = random.Random(4), {}, []
    for way in ("stalled", "dtype", "short_move", "one_beyond", "missing"):
        p = Pyramid(rnd)
        WAYS[way](p)
        routes |= p.routes(way)
        roots.append(way)
    pyramids, levels = scan.scan(spark.createDataFrame([(r,) for r in roots], "root string"), "http://store", replay=json.dumps(routes))
    every = {tuple(r) for r in rules.audit(pyramids, levels).collect()}
    assert every == {tuple(r) for code in {r[2] for r in every} for r in rules.audit(pyramids, levels, only=code).collect()}


def listing(*names):
    return {"text": "".join(f'<a href="{n}">{n}</a>' for n in names)}


def test_roots_that_are_no_pyramids(spark):
    group, array = {"json": {"zarr_format": 2}}, {"json": {"zarr_format": 2, "shape": [3], "chunks": [1], "dtype": "|u1"}}
    cases = {
        "plain_group": ({".zgroup": group, ".zattrs": {"json": {}}}, "NOT_MULTISCALE", "PASS"),
        "no_datasets": ({".zgroup": group, ".zattrs": {"json": {"multiscales": [{"datasets": []}]}}}, "MULTISCALE_EMPTY", "FAIL"),
        "array": ({".zarray": array}, "BARE_ARRAY", "PASS"),
        "new_array": ({"zarr.json": {"json": {"zarr_format": 3, "node_type": "array"}}}, "BARE_ARRAY", "PASS"),
        "chunks_alone": ({"": listing("3.1", "3.2")}, "HEADERLESS_CHUNK_STORE", "FAIL"),
        "groups_inside": ({"": listing("a/", "b/"), "b/.zgroup": group}, "CONTAINER_NO_GROUP_HEADER", "PASS"),
        "other_files": ({"": listing("notes.md")}, "NOT_A_ZARR_GROUP", "PASS"),
        "gone": ({}, "ROOT_ABSENT", "UNKNOWN"),
        "nothing_listed": ({"": listing()}, "EMPTY_ZARR_DIR", "UNKNOWN"),
        "bad_header": ({".zgroup": {"text": "?"}}, "METADATA_UNREADABLE", "FAIL"),
        "bad_attributes": ({".zgroup": group, ".zattrs": {"text": "[1,"}}, "METADATA_UNREADABLE", "FAIL"),
        "down": ({".zgroup": {"status": 500}}, "ACCESS_UNKNOWN", "UNKNOWN"),
        "timeout": ({".zgroup": {"raise": "timeout"}}, "ACCESS_UNKNOWN", "UNKNOWN"),
    }
    routes = {f"{root}/{path}".rstrip("/"): r for root, (own, _, _) in cases.items() for path, r in own.items()}
    found, integrity = judged(spark, routes, list(cases))
    assert found == {root: {(code, "")} for root, (_, code, _) in cases.items()}
    assert integrity == {root: state for root, (_, _, state) in cases.items()}
