"""Surfaces audited from files: layouts of TIFF, reads, guards and gaps."""

import json
import random
import struct
import zlib

import numpy as np
import pytest

from plumbline.operators import surfaces
from plumbline.sources import arrays, surface_scan
from plumbline.sources.transport import PlantedStore


def tiff(grid, rnd, *, big=None, order=None, packed=None, rows=None, predictor=1, kind=3, first=None):
    """A TIFF with its parts in any order."""
    big, e = rnd.random() < 0.5 if big is None else big, order or rnd.choice("<>")
    packed, h, w = rnd.random() < 0.5 if packed is None else packed, *grid.shape
    rows = rows or rnd.randrange(1, h + 1)
    first = rnd.random() < 0.5 if first is None else first
    strips = [grid[i : i + rows].astype(grid.dtype.newbyteorder(e)).tobytes() for i in range(0, h, rows)]
    strips = [zlib.compress(s) if packed else s for s in strips]
    tags = {256: (4, [w]), 257: (3, [h]), 258: (3, [grid.dtype.itemsize * 8]), 259: (3, [rnd.choice((8, 32946)) if packed else 1]), 273: (16 if big else 4, [0] * len(strips)), 277: (3, [1]), 278: (4, [rows]), 279: (4, [len(s) for s in strips]), 317: (3, [predictor]), 339: (3, [kind]), 305: (2, list(b"any text\0"))}
    codes = {2: "B", 3: "H", 4: "I", 16: "Q"}
    begin, step, inline = (16, 20, 8) if big else (8, 12, 4)
    size = (8 if big else 2) + step * len(tags) + (8 if big else 4)
    place = begin + rnd.randrange(0, 9) if first else None
    body, at = b"", begin if not first else place + size
    for i, s in enumerate(strips):
        tags[273][1][i] = at + len(body)
        body += s
    if not first:
        place = at + len(body)
        elsewhere = place + size
    else:
        elsewhere = at + len(body)
    tail, entries = b"", b""
    for tag in sorted(tags):
        typ, values = tags[tag]
        data = struct.pack(f"{e}{len(values)}{codes[typ]}", *values)
        if len(data) > inline:
            pointer = elsewhere + len(tail)
            tail += data
            data = struct.pack(e + ("Q" if big else "I"), pointer)
        entries += struct.pack(e + ("HHQ" if big else "HHI"), tag, typ, len(values)) + data.ljust(inline, b"\0")
    directory = struct.pack(e + ("Q" if big else "H"), len(tags)) + entries + bytes(8 if big else 4)
    mark = b"II" if e == "<" else b"MM"
    start = struct.pack(e + "2sHHHQ", mark, 43, 8, 0, place) if big else struct.pack(e + "2sHI", mark, 42, place)
    start = start.ljust(begin, b"\0")
    return start.ljust(place, b"\0") + directory + body + tail if first else start + body + directory + tail


def store_of(x, y, z, meta=None, **options):
    rnd = random.Random(1)
    files = {f"s/{a}.tif": tiff(g, rnd, **options) if isinstance(g, np.ndarray) else g for a, g in zip("xyz", (x, y, z))}
    return files | {"s/meta.json": json.dumps(meta or {"format": "tifxyz", "scale": [1, 1], "bbox": [[0, 0, 0], [9, 9, 9]]}).encode()}


@pytest.mark.parametrize("seed", range(40))
def test_layouts(seed):
    rnd = random.Random(seed)
    h, w = rnd.randrange(1, 9), rnd.randrange(1, 9)
    kind = rnd.choice(("f4", "f8"))
    grids = [np.random.default_rng(seed + c).normal(size=(h, w)).astype(kind) for c in range(3)]
    store = PlantedStore({f"s/{a}.tif": tiff(g, rnd) for a, g in zip("xyz", grids)})
    row = surface_scan.header_row(arrays.Counted(store), "s")
    assert row["meta_state"] == "ABSENT" and all(c["readable"] and (c["height"], c["width"]) == (h, w) and c["format"] == "float" for c in row["channels"])
    blocks = list(surface_scan.content_blocks(store, "s", row["channels"]))
    for a, g in zip("xyz", grids):
        assert (np.concatenate([b[a] for b in blocks]).reshape(h, w) == g).all()
    assert [b["first"] for b in blocks] == [sum(len(b["x"]) // w for b in blocks[:i]) for i in range(len(blocks))]


@pytest.mark.parametrize("seed", range(200))
def test_broken_bytes_are_never_an_end(seed):
    rnd = random.Random(seed)
    body = bytearray(tiff(np.ones((4, 5), "f4"), rnd))
    for _ in range(rnd.randrange(1, 6)):
        body[rnd.randrange(len(body) if rnd.random() < 0.3 else 40)] = rnd.randrange(256)
    if rnd.random() < 0.3:
        del body[rnd.randrange(len(body)) :]
    store = PlantedStore({f"s/{a}.tif": bytes(body) for a in "xyz"})
    row = surface_scan.header_row(arrays.Counted(store), "s")
    if all(c["readable"] for c in row["channels"]) and row["channels"][0]["height"] < 10_000:
        list(surface_scan.content_blocks(store, "s", row["channels"]))


def test_headers_are_read_without_the_content():
    big = np.zeros((400, 500), "f4")
    store = PlantedStore({f"s/{a}.tif": tiff(big, random.Random(3), big=False, packed=False, rows=4, first=False) for a in "xyz"})
    row = surface_scan.header_row(arrays.Counted(store), "s")
    # of each file: its start, the number of entries, the entries, and two arrays of 100 values; a size each
    assert row["bytes"] == 3 * (16 + 2 + 11 * 12 + 2 * 400) and row["calls"] == 1 + 3 * 6


def audited(spark, objects, faults=None, **options):
    rows = spark.createDataFrame([("s", objects, faults or {})], "surface string, objects map<string, binary>, faults map<string, int>")
    found, said, stats = surfaces.audit(rows, **options)
    return found, {(r.level, r.code, r.evidence_state): r.detail for r in said.collect()}, stats


def codes(found):
    return sorted((level, code) for level, code, _ in found)


def test_content_faults_and_boxes(spark):
    x = np.array([[0, 9], [-1, 4]], "f4")
    y, z = x.copy(), x.copy()
    assert codes(audited(spark, store_of(x, y, z))[1]) == []
    z[1, 0] = 3
    assert codes(audited(spark, store_of(x, y, z))[1]) == [("", "TIFXYZ_INVALID_MASK_MISMATCH")]
    z[1, 0] = -1
    z[0, 0] = np.inf
    assert codes(audited(spark, store_of(x, y, z))[1]) == [("", "TIFXYZ_NONFINITE"), ("meta.json", "TIFXYZ_BBOX_MISMATCH")]
    z[0, 0] = -2
    found = audited(spark, store_of(x, y, z))[1]
    assert codes(found) == [("", "TIFXYZ_NEGATIVE_COORDINATE"), ("meta.json", "TIFXYZ_BBOX_MISMATCH")]
    assert found["meta.json", "TIFXYZ_BBOX_MISMATCH", "PRESENT"] == "1 points outside"
    z[0, 0] = 5
    assert audited(spark, store_of(x, y, z))[1]["meta.json", "TIFXYZ_BBOX_MISMATCH", "PRESENT"] == "looser than the data"
    z[0, 0] = 0
    assert codes(audited(spark, store_of(x, y, z), shape_zyx=(10, 10, 9))[1]) == [("", "TIFXYZ_TARGET_VOLUME_OVERRUN")]
    none = np.full((2, 2), -1, "f4")
    assert codes(audited(spark, store_of(none, none, none), shape_zyx=(1, 1, 1))[1]) == [("", "TIFXYZ_EMPTY")]


def test_gaps_of_coverage(spark):
    x = np.arange(6, dtype="f4").reshape(2, 3)
    files = store_of(x, x, x)
    assert codes(audited(spark, files, most_bytes=10)[1]) == [("x.tif", "TIFXYZ_CONTENT_UNDECODED")]
    packed = store_of(x, x, x, predictor=2)
    assert codes(audited(spark, packed)[1]) == [("x.tif", "TIFXYZ_CONTENT_UNDECODED")]
    assert codes(audited(spark, packed, content=False)[1]) == []
    ints = store_of(x, x, x.astype("u2"), kind=1)
    assert ("z.tif", "TIFXYZ_SAMPLE_FORMAT") in codes(audited(spark, ints)[1])
    damaged = store_of(x, x, x, packed=True, rows=1, first=True, big=False, order="<")
    body = bytearray(damaged["s/y.tif"])
    row = surface_scan.header_row(arrays.Counted(PlantedStore(damaged)), "s")
    at = row["channels"][1]["offsets"][1]
    body[at : at + 4] = b"????"
    found, said, stats = audited(spark, damaged | {"s/y.tif": bytes(body)})
    # rows before the damage were read, and none of them counts
    assert codes(said) == [("y.tif", "TIFXYZ_CONTENT_UNDECODED")] and stats.count() == 0
    assert codes(audited(spark, {})[1]) == [("", "TIFXYZ_ABSENT")]
    denied = audited(spark, files, {"s/x.tif": 403, "s/meta.json": 500})
    assert codes(denied[1]) == [("meta.json", "ACCESS_UNKNOWN"), ("x.tif", "ACCESS_UNKNOWN")]
    verdict = surfaces.verdicts(denied[0], spark.createDataFrame([("s", "x.tif", "ACCESS_UNKNOWN", "UNKNOWN", "info")], "surface string, level string, code string, evidence_state string, severity string")).first()
    assert (verdict.evidence_state, verdict.integrity, verdict.max_severity) == ("UNKNOWN", "UNKNOWN", "info")


@pytest.mark.parametrize("meta, bad", [({"format": "tifxyz", "scale": [1, 1], "bbox": [[0] * 3, [1] * 3]}, 0), ({"format": "x", "scale": [True, 1], "bbox": [[0] * 2, [1] * 3]}, 3), ({"format": "tifxyz", "scale": [1, 0], "bbox": [["0", 1, 2], [1] * 3]}, 1), ({"format": "tifxyz", "scale": "1,1", "bbox": None}, 2)])
def test_documents(meta, bad):
    assert len(surface_scan.meta_problems(meta)) == bad


def test_files_in_a_folder_and_the_guard(spark, tmp_path):
    x = np.arange(6, dtype="f4").reshape(2, 3)
    for name, target in (("a", "vol/v1.zarr"), ("b", "v1"), ("c", "v2")):
        (tmp_path / name).mkdir()
        for path, body in store_of(x, x, x, {"format": "tifxyz", "scale": [1, 1], "bbox": [[0] * 3, [5] * 3], "target_volume": target}).items():
            (tmp_path / name / path[2:]).write_bytes(body)
    rows = spark.createDataFrame([("a",), ("b/",), ("c",), ("d",), ("c",)], "surface string")
    found, said, stats = surfaces.audit(rows, base=str(tmp_path))
    assert sorted((r.surface, r.code) for r in said.collect()) == [("d", "TIFXYZ_ABSENT")]
    assert sorted((r.surface, r.n, r.n_valid) for r in stats.collect()) == [("a", 6, 6), ("b", 6, 6), ("c", 6, 6)]
    assert sorted(r.surface for r in surfaces.target_failures(found, "s3://x/v1.zarr").collect()) == ["c", "d"]
    assert surfaces.guarded(found.filter("surface in ('a', 'b')"), "v1").count() == 2
    with pytest.raises(ValueError, match="2 surfaces"):
        surfaces.guarded(found, "v1")
    with pytest.raises(ValueError):
        surfaces.target_failures(found, " / ")


def test_nonfinite_points_are_found_in_channels_of_any_size(spark):
    from plumbline.plans import registry

    surfaces_of = lambda name: {r.surface for r in registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    # the other queries of content keep the cap of their SQL and list what is over it as not decoded
    assert surfaces_of("t11_nonfinite") & surfaces_of("t15_content_undecoded")


@pytest.mark.parametrize("packed", [False, True])
def test_a_large_strip_is_read_piece_by_piece(monkeypatch, packed):
    monkeypatch.setattr(surface_scan, "PIECE_BYTES", 101)
    monkeypatch.setattr(surface_scan, "BLOCK_CELLS", 30)
    grids = [np.random.default_rng(c).normal(size=(6, 50)).astype("f4") for c in range(3)]
    store = PlantedStore(store_of(*grids, packed=packed, rows=6))
    row = surface_scan.header_row(arrays.Counted(store), "s")
    asked, request = [], store.request
    monkeypatch.setattr(store, "request", lambda method, path, headers=None, query=None: asked.append(headers["Range"]) or request(method, path, headers, query))
    blocks = list(surface_scan.content_blocks(store, "s", row["channels"]))
    spans = [[int(v) for v in a.removeprefix("bytes=").split("-")] for a in asked]
    assert max(b - a + 1 for a, b in spans) == 101 and max(len(b["x"]) for b in blocks) <= 30
    assert sum(b - a + 1 for a, b in spans) == sum(sum(c["counts"]) for c in row["channels"])
    for a, g in zip("xyz", grids):
        for b in blocks:
            at = b["first"] * 50 + b["skip"]
            assert (b[a] == g.reshape(-1)[at : at + len(b[a])]).all()
    assert sum(len(b["x"]) for b in blocks) == 300


@pytest.mark.parametrize("piece", [1, 24, 100])
@pytest.mark.parametrize("harm", ["checksum", "cut", "short", "rest"])
def test_a_strip_is_read_to_its_end(monkeypatch, piece, harm):
    x = np.arange(6, dtype="f4").reshape(2, 3)
    files = store_of(x, x, x, packed=True, rows=2, order="<")
    channels = surface_scan.header_row(arrays.Counted(PlantedStore(files)), "s")["channels"]
    z = channels[2]
    body, (at,), (length,) = bytearray(files["s/z.tif"]), z["offsets"], z["counts"]
    if harm == "checksum":
        body[at + length - 1] ^= 1
    elif harm == "cut":
        z["counts"] = [length - 1]
    else:
        strip = zlib.compress(x.tobytes()[:-1]) if harm == "short" else zlib.compress(x.tobytes() + b"more") + b"rest"
        z["offsets"], z["counts"], z["bytes"] = [len(body)], [len(strip)], len(body) + len(strip)
        body += strip
    monkeypatch.setattr(surface_scan, "PIECE_BYTES", piece)
    blocks = list(surface_scan.content_blocks(PlantedStore(files | {"s/z.tif": bytes(body)}), "s", channels))
    assert [b["channel"] for b in blocks if "channel" in b] == ([] if harm == "rest" else ["z.tif"])
    assert harm != "rest" or np.concatenate([b["z"] for b in blocks]).tolist() == list(range(6))


def test_content_has_no_cap_unless_one_is_given():
    import inspect

    assert inspect.signature(surfaces.audit).parameters["most_bytes"].default is None


def test_blocks_of_a_large_surface_are_read_back_in_little_memory(spark):
    rows = int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
    assert rows * surface_scan.BLOCK_CELLS * 3 * 8 <= 64 << 20


def test_rows_wider_than_a_block(spark):
    x = np.arange(200_000, dtype="f4").reshape(2, 100_000)
    y = x.copy()
    y[1, 99_999] = np.nan
    files = store_of(x, y, x, rows=2)
    found, said, stats = audited(spark, files)
    assert said["", "TIFXYZ_NONFINITE", "PRESENT"] == "1" and (stats.first().n, stats.first().n_valid) == (200_000, 199_999)
    rows = spark.createDataFrame([("s", files, {})], "surface string, objects map<string, binary>, faults map<string, int>")
    cells = surface_scan.cells(surface_scan.content(found.join(rows, "surface")))
    assert cells.filter("x = row * 100000 + col and col < 100000").select("row", "col").distinct().count() == 200_000
