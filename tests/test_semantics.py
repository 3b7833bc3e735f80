"""Truth tables, vectors and traps of the evidence engine."""

import itertools
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import functions as fn
from plumbline import schema
from plumbline.functions import binary, json_schema
from plumbline.operators import sampling
from plumbline.plans import rules
from plumbline.sources import datasource, sinks, transport

FINDING = "root string, level string, code string, severity string, evidence_state string, actionable boolean"


def expected_integrity(items):
    severities = {s for s, _ in items}
    if "high" in severities:
        return "FAIL"
    if any(state == "UNKNOWN" for _, state in items):
        return "UNKNOWN"
    return "WARN" if "medium" in severities else "PASS"


def test_integrity_of_all_combinations(spark):
    """Unknown evidence never passes, whatever it comes with; roots without findings pass."""
    cells = [(s, e) for s in schema.SEVERITIES for e in ("PRESENT", "ABSENT", "UNKNOWN")]
    cases = [()] + [c for n in (1, 2, 3) for c in itertools.combinations(cells, n)]
    rows = [(f"r{i}", "", "LEVEL_MISSING", s, e, s != "info") for i, case in enumerate(cases) for s, e in case]
    roots = spark.createDataFrame([(f"r{i}",) for i in range(len(cases))], "root string")
    got = {r.root: r.integrity for r in rules.integrity(roots, spark.createDataFrame(rows, FINDING)).collect()}
    assert got == {f"r{i}": expected_integrity(case) for i, case in enumerate(cases)}


@pytest.mark.parametrize(
    "codes, outcome, fail",
    [([], "pass", False), (["ACCESS_UNKNOWN"], "unreadable", True), (["ROOT_ABSENT"], "absent", True), (["LEVEL_MISSING"], "fail", True), (["FILL_DRIFT"], "pass", False), (["ACCESS_UNKNOWN", "LEVEL_MISSING"], "unreadable", True)],
)
def test_gate(spark, codes, outcome, fail):
    rows = [("r", "", c, schema.SEVERITY[c], "UNKNOWN" if c == "ACCESS_UNKNOWN" else "PRESENT", schema.SEVERITY[c] != "info") for c in codes]
    rolled = rules.integrity(spark.createDataFrame([("r",)], "root string"), spark.createDataFrame(rows, FINDING))
    assert rules.gate(rolled).select("outcome", "fail").first() == (outcome, fail)


def test_contract():
    assert len(schema.PYRAMID_CODES["high"] + schema.PYRAMID_CODES["medium"] + schema.PYRAMID_CODES["low"] + schema.PYRAMID_CODES["info"]) == 31
    assert schema.fingerprint() == schema.fingerprint() and len(schema.fingerprint()) == 12


@pytest.mark.parametrize("raw, modelled", [(None, True), ("0.4", True), ("0.5", True), ("0.5.2", True), ("0.6", False), ("0.10", False), ("1.0", False), ("junk", False), ("", False)])
def test_versions(spark, raw, modelled):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(fn.ome_version("v").modelled).first()[0] is modelled


RANGES = [
    (("range", 2, 3), 206, "bytes 2-4/10", b"234", b"234"),
    (("range", 2, 3), 200, None, b"0123456789", b"234"),
    (("range", 2, 3), 206, "bytes 2-4/*", b"234", b"234"),
    (("range", 2, 3), 206, "bytes 2-4/10", b"23", "short ranged GET"),
    (("range", 2, 3), 206, None, b"234", "invalid Content-Range"),
    (("range", 2, 3), 206, "bytes 3-5/10", b"345", "invalid Content-Range"),
    (("range", 2, 3), 206, "bytes 2-4/4", b"234", "invalid Content-Range"),
    (("range", 2, 3), 206, "items 2-4", b"234", "invalid Content-Range"),
    (("range", 8, 4), 200, None, b"0123456789", "short ranged GET"),
    (("range", 20, 4), 416, None, b"", "HTTP 416"),
    (("range", 0, 4), 404, None, b"", "404 Not Found"),
    (("range", 0, 4), 503, None, b"", "HTTP 503"),
    (("suffix", 0, 3), 206, "bytes 7-9/10", b"789", b"789"),
    (("suffix", 0, 3), 200, None, b"0123456789", b"789"),
    (("suffix", 0, 3), 206, "bytes 7-9/*", b"789", "invalid Content-Range"),
    (("suffix", 0, 3), 206, "bytes 4-6/10", b"456", "invalid Content-Range"),
    (("suffix", 0, 3), 206, None, b"789", "invalid Content-Range"),
    (("suffix", 0, 16), 200, None, b"0123456789", "short suffix GET"),
    (("suffix", 0, 3), 404, None, b"", "404 Not Found"),
]


@pytest.mark.parametrize("call, status, header, body, want", RANGES)
def test_byte_ranges(call, status, header, body, want):
    op, start, length = call
    store = transport.ReplayStore({"o": {"status": status, "hex": body.hex(), "headers": {"Content-Range": header} if header else {}}})
    row = transport.observe(store, op, "o", start, length)
    assert (row["body"] if isinstance(want, bytes) else row["error"]) == want


def test_local_store_sees_hidden_files(spark, tmp_path):
    """Spark's file readers hide dotfiles; the store must not, as that would be a false absence."""
    (tmp_path / "a.zarr").mkdir()
    (tmp_path / "a.zarr/.zarray").write_text('{"shape": [1]}')
    (tmp_path / "a.zarr/.zattrs").write_text('{"shape"')
    found = {r.path: r for r in datasource.scan(spark, str(tmp_path), "json", ["a.zarr/.zarray", "a.zarr/.zattrs", "a.zarr/.zgroup"], batch=2).collect()}
    assert [(found[f"a.zarr/{n}"].state, found[f"a.zarr/{n}"].reason) for n in (".zarray", ".zattrs", ".zgroup")] == [("PRESENT", None), ("PRESENT", "METADATA_UNREADABLE"), ("ABSENT", "NOT_FOUND")]
    listed = datasource.scan(spark, str(tmp_path), "list", [".", "a.zarr"]).collect()
    assert listed[0].entries == ["a.zarr/"] and listed[1].entries == [".zarray", ".zattrs"]
    with pytest.raises(transport.StoreError):
        transport.LocalStore(str(tmp_path)).place("../x")


def test_replayed_statuses(spark):
    routes = json.dumps({"a": {"status": 503}, "b": {"raise": "read timed out"}, "c": {"status": 403}, "d": {"json": {"x": 1}}, "e": {"text": "<html>"}, "f": {"status": 429}})
    got = {r.path: (r.state, r.reason) for r in datasource.scan(spark, "", "json", list("abcdefg"), replay=routes).collect()}
    assert got == {"a": ("UNKNOWN", "SERVER_ERROR"), "b": ("UNKNOWN", "TIMEOUT"), "c": ("UNKNOWN", "FORBIDDEN"), "d": ("PRESENT", None), "e": ("PRESENT", "METADATA_UNREADABLE"), "f": ("UNKNOWN", "RATE_LIMITED"), "g": ("ABSENT", "NOT_FOUND")}
    rows = datasource.observed(spark.createDataFrame([("d",), ("g",)], "path string"), "", "head", replay=routes).collect()
    assert sorted((r.path, r.state) for r in rows) == [("d", "PRESENT"), ("g", "ABSENT")]


def test_retry_delay():
    assert transport.delay(0, retry_after="7") == 7 and transport.delay(0, retry_after="900", cap=30) == 30
    assert transport.delay(0, retry_after="Thu, 01 Jan 1970 00:00:20 GMT", now=5.0) == 15
    assert all(0 <= transport.delay(n) <= 30 for n in range(12))


def test_crc32c_vectors():
    assert binary.crc32c_of([b"123456789", b"", b"\0" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA]


def test_index_and_checksum():
    pairs = np.array([[0, 10], [binary.MISSING, binary.MISSING]], "<u8").tobytes()
    assert binary.unpack(pairs, 2, False) == [{"off": 0, "len": 10}, {"off": -1, "len": -1}]
    assert binary.unpack(pairs, 3, False) is None and binary.unpack(None, 1, True) is None


def test_tiff_round_trip():
    grid = np.arange(12, dtype=np.float32).reshape(3, 4)
    raw = binary.build_tiff(grid)
    header = binary.tiff_header(raw)
    assert (header["width"], header["height"]) == ([4], [3]) and (binary.tiff_grid(raw, header) == grid).all()
    assert binary.tiff_header(b"not a tiff") is None and binary.tiff_header(raw[:20]) is None


@pytest.mark.parametrize(
    "raw, dtype, codec, fill, want",
    [
        (b"\0" * 8, "|u1", "none", "0", "empty"),
        (b"\0" * 8, "|u1", "none", None, "empty"),
        (b"\0" * 8, "|u1", "none", "255", "populated"),
        (b"\0\1" * 4, "|u1", "none", "0", "populated"),
        (np.full(4, np.nan, "<f4").tobytes(), "<f4", "none", '"NaN"', "empty"),
        (zlib.compress(b"\0" * 8), "|u1", "zlib:l1", "0", "empty"),
        (b"xx", "|u1", "zlib:l1", "0", "undecodable"),
        (b"xx", "|u1", "blosc:lz4", "0", "undecodable"),
        (None, "|u1", "none", "0", "absent"),
    ],
)
def test_chunk_status(raw, dtype, codec, fill, want):
    assert binary.chunk_status(raw, dtype, codec, fill) == want


def test_csv_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ('say "x", y\nz', "1")], "c string, d string")
    sinks.write_csv(df, f"file://{tmp_path}/out")
    assert sorted(map(tuple, sinks.read_csv(spark, f"file://{tmp_path}/out", ["c", "d"]).collect())) == sorted([("a", ""), ('say "x", y\nz', "1")])
    with pytest.raises(Exception):
        sinks.write_csv(df, f"file://{tmp_path}/out")


def test_half_even_and_tiles(spark):
    one = spark.range(1)
    assert one.select(fn.spread_positions(F.lit(6), 3)).first()[0] == [0, 2, 5]  # 2.5 goes to 2
    assert one.select(sampling.tile_starts(F.lit(100), 20, 3)).first()[0] == [0, 40, 80]
    assert one.select(sampling.tile_starts(F.lit(10), 20, 3)).first()[0] == [0]
    assert one.select(fn.is_close(F.lit(float("nan")), F.lit(float("nan"))), fn.is_close(F.lit(float("inf")), F.lit(float("inf")))).first() == (False, True)


def test_missing_value_is_a_value_of_its_own(spark):
    from plumbline.operators import rollup

    df = spark.createDataFrame([("r", None), ("r", "0"), ("s", None), ("s", None)], "root string, v string")
    assert [(r.root, r.observed) for r in rollup.drift(df, "root", F.col("v"), "X").collect()] == [("r", "0,None")]


# ------------------------------------------------------------------ voxel sizes
ROOTS = "root string, has_multiscales boolean, marker string, axes array<string>, axis_types array<string>, axis_units array<string>"
SIZES = "root string, idx int, present boolean, shape array<bigint>, declared_scale array<double>"
VOXEL_CASES = {
    "match": (["z", "y", "x"], [None] * 3, ["um", " Micrometer ", "µm"], [2.0] * 3, None, "match"),
    "nanometres": (["y", "x"], ["space"] * 2, ["nm", "nm"], [2000.0] * 2, None, "match"),
    "within": (["x"], [None], ["micron"], [2.0009], None, "match"),
    "mismatch": (["z", "y", "x"], [None] * 3, ["um"] * 3, [2.0, 2.0, 2.5], None, "mismatch"),
    "other_axis_free": (["c", "y", "x"], ["channel", "space", "space"], [None, "um", "um"], [1.0, 2.0, 2.0], None, "match"),
    "no_unit": (["y", "x"], [None] * 2, ["um", None], [2.0] * 2, None, "unknown"),
    "strange_unit": (["x"], [None], ["furlong"], [2.0], None, "unknown"),
    "short_scale": (["y", "x"], [None] * 2, ["um"] * 2, [2.0], None, "unknown"),
    "no_scale": (["x"], [None], ["um"], None, None, "unknown"),
    "not_positive": (["x"], [None], ["um"], [0.0], None, "unknown"),
    "not_finite": (["x"], [None], ["um"], [float("inf")], None, "unknown"),
    "marked_unknown": (["x"], [None], ["um"], [2.0], "unknown", "unknown"),
    "no_spatial_axis": (["c"], ["channel"], ["um"], [2.0], None, "unknown"),
}


def test_voxel_sizes_and_the_gate(spark):
    roots = [(r, True, m, a, t, u) for r, (a, t, u, _, m, _) in VOXEL_CASES.items()] + [("plain", False, None, [], [], []), ("no_level", True, None, ["x"], [None], ["um"])]
    # the base is the first level that is present; later scales don't matter
    levels = [row for r, (a, _, _, s, _, _) in VOXEL_CASES.items() for row in ((r, 0, False, None, [9.0] * 3), (r, 1, True, [4] * len(a), s), (r, 2, True, [2] * len(a), [7.0] * 3))]
    got = rules.voxel_sizes(spark.createDataFrame(roots, ROOTS), spark.createDataFrame(levels, SIZES), 2.0)
    want = {r: c[5] for r, c in VOXEL_CASES.items()} | {"plain": "unknown", "no_level": "unknown"}
    assert {r.root: r.voxel_size for r in got.collect()} == want
    rows = [("match", "DTYPE_DRIFT", "high", "PRESENT", True), ("no_unit", "ROOT_ABSENT", "low", "ABSENT", True), ("mismatch", "ACCESS_UNKNOWN", "info", "UNKNOWN", False)]
    rolled = rules.integrity(spark.createDataFrame([(r,) for r in want], "root string"), spark.createDataFrame([(r, "", c, s, e, a) for r, c, s, e, a in rows], FINDING))
    gated = {r.root: (r.outcome, r.fail, r.code) for r in rules.gate(rolled, voxels=got).collect()}
    assert gated["match"] == ("fail", True, None) and gated["within"] == ("pass", False, None)
    assert gated["no_unit"] == ("absent", True, "GATE_ROOT_ABSENT") and gated["mismatch"] == ("unreadable", True, "GATE_UNREADABLE")
    assert gated["short_scale"] == ("fail", True, "GATE_VOXEL_SIZE_UNKNOWN") and gated["other_axis_free"][0] == "pass"
    assert {r.code for r in rules.gate(rolled).collect()} == {None, "GATE_ROOT_ABSENT", "GATE_UNREADABLE"}


# ------------------------------------------------------------------ servers that refuse
def asked(op, **answers):
    store = transport.ReplayStore({"k": answers.get("route", answers)})
    row = transport.observe(store, op, "k", 0, 4)
    return row["state"], row["size"], row["body"], row["error"]


WHOLE = {"text": "0123456789"}
ONE_BYTE = {"bytes=0-0": {"status": 206, "text": "0", "headers": {"Content-Range": "bytes 0-0/10"}}}
LAST = {"bytes=6-9": {"status": 206, "text": "6789", "headers": {"Content-Range": "bytes 6-9/10"}}}


@pytest.mark.parametrize(
    "answers, want",
    [
        ({"HEAD": WHOLE}, ("PRESENT", 10, None, None)),
        ({"HEAD": {"status": 405}, "GET": ONE_BYTE}, ("PRESENT", 10, None, None)),
        ({"HEAD": {"status": 405}, "GET": {"status": 404}}, ("ABSENT", None, None, "404 Not Found")),
        ({"HEAD": {"status": 405}, "GET": {"status": 503}}, ("UNKNOWN", None, None, "HTTP 503")),
        ({"HEAD": {"status": 404}}, ("ABSENT", None, None, "404 Not Found")),
        ({"HEAD": {"status": 500}}, ("UNKNOWN", None, None, "HTTP 500")),
    ],
)
def test_size_probes(answers, want):
    assert asked("head", route=answers) == want


@pytest.mark.parametrize("refusal", [400, 405, 501])
def test_suffix_falls_back_on_the_size(refusal):
    refused = {"bytes=-4": {"status": refusal}}
    assert asked("suffix", HEAD=WHOLE, GET=refused | LAST) == ("PRESENT", None, b"6789", None)
    assert asked("suffix", HEAD={"status": 405}, GET=refused | ONE_BYTE | LAST) == ("PRESENT", None, b"6789", None)
    assert asked("suffix", HEAD={"status": 404}, GET=refused)[0::3] == ("ABSENT", "404 Not Found")
    assert asked("suffix", HEAD={"text": "abc"}, GET=refused)[0::3] == ("UNKNOWN", "object smaller than its index")
    assert asked("suffix", HEAD={"status": 502}, GET=refused)[0::3] == ("UNKNOWN", "HTTP 502")


def test_suffix_of_a_small_or_absent_object():
    assert asked("suffix", GET={"bytes=-4": {"status": 416}})[0::3] == ("UNKNOWN", "object smaller than its index")
    assert asked("suffix", GET={"bytes=-4": {"status": 404}})[0::3] == ("ABSENT", "404 Not Found")
    assert asked("suffix", GET={"bytes=-4": {"status": 503}})[0::3] == ("UNKNOWN", "HTTP 503")


# ------------------------------------------------------------------ documents and their schema
TREE = {
    "type": "object",
    "required": ["name"],
    "additionalProperties": {"type": ["integer", "null"]},
    "properties": {"name": {"type": "string"}, "kind": {"const": "t"}, "sub": {"type": "array", "items": {"$ref": "#/$defs/t"}}},
    "$defs": {"t": {"type": "object", "required": ["name"], "additionalProperties": False, "properties": {"name": {"enum": ["a", "b"]}, "x": {"type": "number"}}}},
}


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"name": "n", "kind": "t", "sub": [{"name": "a", "x": 1.5}], "other": 3, "more": null}', []),
        ('{"kind": "u", "name": 3}', ["$.kind: const", "$.name: type"]),
        ("[]", ["$: type"]),
        ('{"name": "n", "other": true, "rest": 1.5}', ["$.other: type", "$.rest: type"]),
        ('{"name": "n", "sub": [{"x": false}, 4, {"name": "c", "y": 0}]}', ["$.sub[1]: type", "$.sub[0].name: required", "$.sub[0].x: type", "$.sub[2].y: additionalProperties", "$.sub[2].name: enum"]),
        ('{"name"', ["$: json"]),
        (None, None),
    ],
)
def test_schema_faults(spark, text, want):
    got = spark.createDataFrame([(text,)], "doc string").select(json_schema.schema_faults("doc", TREE).alias("f")).first().f
    assert (got if got is None else sorted(got)) == (want if want is None else sorted(want))
