"""Arrays, shards and probes over stores, against numpy and against what was planted."""

import itertools
import json
import math
import random
import struct
import zlib

import numpy as np
import pytest

from plumbline.functions import binary
from plumbline.operators import probe
from plumbline.sources import array_source, arrays
from plumbline.sources.transport import LocalStore, PlantedStore, StoreError


def crc(data):
    c = 0xFFFFFFFF
    for byte in data:
        c ^= byte
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def plant(rnd, ndim, sharded, dtype="<i2", fill=7, packed=False, holes=0.3):
    """(header document, objects, whole array as it reads)"""
    inner = [rnd.randrange(1, 4) for _ in range(ndim)]
    outer = [i * rnd.randrange(1, 4) for i in inner] if sharded else inner
    shape = [rnd.randrange(1, 12) for _ in range(ndim)]
    grid = [-(-s // o) for s, o in zip(shape, outer)]
    values = np.random.default_rng(rnd.randrange(10**6)).integers(0, 50, [g * o for g, o in zip(grid, outer)]).astype(dtype)
    seen = values.copy()
    pack = zlib.compress if packed else bytes
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + [{"name": "zlib"}] * packed
    objects = {}
    for place in itertools.product(*map(range, grid)):
        whole = tuple(slice(p * o, (p + 1) * o) for p, o in zip(place, outer))
        if rnd.random() < holes:
            seen[whole] = fill
            continue
        if not sharded:
            objects["a/c/" + "/".join(map(str, place))] = pack(values[whole].tobytes())
            continue
        body, index = b"", b""
        for at in itertools.product(*(range(o // i) for o, i in zip(outer, inner))):
            part = tuple(slice(p * o + k * i, p * o + (k + 1) * i) for p, o, k, i in zip(place, outer, at, inner))
            if rnd.random() < holes:
                seen[part] = fill
                index += b"\xff" * 16
                continue
            body += bytes(rnd.choice((0, 3, 5000)))  # gaps between payloads
            payload = pack(values[part].tobytes())
            index += struct.pack("<QQ", len(body), len(payload))
            body += payload
        objects["a/c/" + "/".join(map(str, place))] = body + index + struct.pack("<I", crc(index))
    if sharded:
        codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": inner, "codecs": codecs, "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}]}}]
    doc = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": np.dtype(dtype).name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": outer}}, "fill_value": fill, "codecs": codecs}
    objects["a/zarr.json"] = json.dumps(doc).encode()
    return doc, objects, seen[tuple(slice(0, s) for s in shape)]


@pytest.mark.parametrize("seed", range(40))
def test_boxes_read_as_numpy_reads_them(seed):
    rnd = random.Random(seed)
    ndim, sharded = rnd.choice((1, 2, 3, 4)), seed % 2 == 0
    doc, objects, want = plant(rnd, ndim, sharded, packed=seed % 3 == 0)
    header = arrays.header_of(PlantedStore(objects), "a")
    for _ in range(5):
        start = tuple(rnd.randrange(s) for s in want.shape)
        stop = tuple(rnd.randrange(a, s + 1) for a, s in zip(start, want.shape))
        box = tuple(slice(a, b) for a, b in zip(start, stop))
        touched = {tuple(i // c for i, c in zip(at, header.chunks)) for at in itertools.product(*(range(a, b) for a, b in zip(start, stop)))}
        # everything else is refused: it must not be asked for
        faults = {p: 500 for p in objects if p != "a/zarr.json" and tuple(map(int, p.split("/")[2:])) not in touched}
        store = arrays.Counted(PlantedStore(objects, faults, suffixes=rnd.random() < 0.5))
        assert (arrays.read_box(store, "a", header, start, stop) == want[box]).all()
        # pieces of the numbered chunks cover the box once
        units = arrays.Units(header, start, stop)
        cover = np.zeros(want.shape, int)
        cuts = sorted({0, len(units), *(rnd.randrange(len(units) + 1) for _ in range(3))})
        for a, b in zip(cuts, cuts[1:]):
            for low, high, _ in arrays.blocks(PlantedStore(objects), "a", units, a, b, at_once=2):
                cover[tuple(slice(x, y) for x, y in zip(low, high))] += 1
        assert cover.sum() == math.prod(b - a for a, b in zip(start, stop)) and (cover[box] == 1).all()


def test_neighbours_are_fetched_together():
    spans = [(100, 10, 1), (0, 50, 0), (5000, 5, 2), (9200, 5, 3)]
    assert [(a, b, [m[2] for m in ms]) for a, b, ms in arrays.coalesced(spans, gap=4192)] == [(0, 110, [0, 1]), (5000, 5005, [2]), (9200, 9205, [3])]
    got = list(arrays.coalesced(spans, gap=60))
    assert [(a, b) for a, b, _ in got] == [(0, 110), (5000, 5005), (9200, 9205)]
    assert list(arrays.coalesced([])) == []


@pytest.mark.parametrize(
    "change, why",
    [
        ({"chunk_grid": {"configuration": {"chunk_shape": [0]}}}, "don't fit"),
        ({"chunk_grid": {"configuration": {"chunk_shape": [2, 2]}}}, "don't fit"),
        ({"data_type": "nonsense"}, "header"),
        ({"codecs": [{"name": "transpose"}, {"name": "bytes"}]}, "transpose"),
        ({"codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [3], "codecs": [], "index_codecs": []}}]}, "don't fit"),
        ({"codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2], "codecs": [], "index_location": "start"}}]}, "index_location"),
        ({"codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2], "codecs": [], "index_codecs": [{"name": "gzip"}]}}]}, "index codec"),
        ({"chunk_key_encoding": {"name": "other"}}, "chunk keys"),
    ],
)
def test_headers_outside_what_is_understood(change, why):
    doc = {"zarr_format": 3, "shape": [8], "data_type": "uint8", "chunk_grid": {"configuration": {"chunk_shape": [4]}}, "fill_value": 0, "codecs": [{"name": "bytes"}]}
    assert arrays.parsed(doc).grid == (2,)
    with pytest.raises(arrays.Undecodable, match=why):
        arrays.parsed(doc | change)


def test_local_ranges(tmp_path):
    (tmp_path / "x").write_bytes(bytes(range(100)))
    store = LocalStore(str(tmp_path))
    assert arrays.fetched(store, "x", 10, 5) == bytes(range(10, 15))
    assert len(arrays.fetched(store, "x")) == 100
    with pytest.raises(StoreError):
        arrays.fetched(store, "x", 98, 5)
    with pytest.raises(arrays.Absent):
        arrays.fetched(store, "y")


# ------------------------------------------------------------------ probes
LEVELS = "root string, path string, present boolean, shape array<bigint>, chunks array<bigint>, dtype string, fill_value string, compressor_id string, separator string, zarr_format int, filters boolean, objects map<string, binary>, faults map<string, int>"


def level(root, objects, faults=None, shape=(4, 4), chunks=(1, 1), dtype="|u1", fill="0", codec="none", filters=None, present=True):
    objects = {f"{root}/0/{k}": v for k, v in objects.items()}
    return (root, "0", present, list(shape), list(chunks), dtype, fill, codec, ".", 2, filters, objects, {f"{root}/0/{k}": v for k, v in (faults or {}).items()})


def probed(spark, rows, **options):
    found = probe.samples(spark.createDataFrame(rows, LEVELS), **options).collect()
    by = {}
    for r in found:
        by.setdefault(r.root, []).append(r)
    return by


def test_reads_stop_at_the_first_k_present(spark):
    # candidates of 16 chunks: 9 places, of which the 1st, 3rd, 5th and last are there
    places = [round(i * 15 / 8) for i in range(9)]
    key = lambda n: f"{n // 4}.{n % 4}"
    late = bytes(5000) + b"\1"
    rows = [
        level("a", {key(places[i]): b"\1" * 10 for i in (0, 2, 4, 8)}),
        level("late", {key(places[0]): late}),
        level("zero", {key(places[0]): bytes(5000)}),
        level("short", {key(places[0]): bytes(3)}),
        level("float", {key(places[0]): struct.pack("<2f", -0.0, 0.0)}, dtype="<f4"),
        level("nan", {key(places[0]): struct.pack("<2f", math.nan, math.nan), key(places[1]): struct.pack("<2f", math.nan, 1)}, dtype="<f4", fill="NaN"),
        level("fill", {key(places[0]): b"\xff" * 9, key(places[1]): bytes(9)}, fill="255"),
        level("odd", {key(places[0]): b"\0"}, dtype="<u2"),
        level("codec", {key(places[0]): b"?"}, codec="blosc:lz4"),
        level("filters", {key(places[0]): b"?"}, filters=True),
        level("fault", {key(places[3]): b"\1"}, {key(places[0]): 500, key(places[1]): 403}),
        level("bytes", {key(places[0]): b"\1\0"}, dtype=">u2", codec="bytes"),
        level("none", {}),
        level("gone", {key(places[0]): b"\1"}, present=False),
        level("flat", {"0": b"\1"}, shape=(), chunks=()),
        level("badfill", {key(places[0]): bytes(2)}, fill='"x"'),
    ]
    got = probed(spark, rows)
    said = {root: [(r.status, r.calls, r.bytes) for r in found] for root, found in got.items()}
    assert said["a"] == [("populated", 2, 10), ("populated", 3, 10), ("populated", 3, 10)]  # the last is never asked for
    rest = ("absent", 8, 0)
    assert said["late"] == [("populated", 3, 4096 + 5001), rest]
    assert said["zero"] == [("empty", 3, 4096 + 5000), rest]
    assert said["short"] == [("empty", 2, 3), rest]
    assert said["float"] == [("empty", 2, 8), rest]
    assert said["nan"][:2] == [("empty", 2, 8), ("populated", 2, 8)]
    assert said["fill"][:2] == [("empty", 2, 9), ("populated", 2, 9)]
    assert said["odd"] == [("undecodable", 2, 1), rest]
    assert said["codec"] == [("undecodable", 2, 1), rest]
    assert said["filters"] == [("undecodable", 0, 0)]
    assert said["fault"] == [("fetch_error", 1, 0), ("fetch_error", 1, 0), ("populated", 3, 1)]
    assert said["bytes"][0][0] == "populated" and said["badfill"][0][0] == "undecodable"
    assert said["none"] == [("absent", 9, 0)]
    assert "gone" not in said and "flat" not in said


def test_registered_codecs_reach_tasks(spark):
    def decode(raw):
        return raw[::-1]

    binary.register_codec("mirrored", decode)
    try:
        got = probed(spark, [level("m", {"0.0": bytes(4)}, codec="mirrored")])
        assert got["m"][0].status == "empty"
        raw = spark.createDataFrame([(bytes(4),)], "raw binary")
        from pyspark.sql import functions as F

        assert raw.select(binary.decoded_status("raw", F.lit("|u1"), F.lit("mirrored"), F.lit("0"))).first()[0] == "empty"
    finally:
        del binary.CODECS["mirrored"]


@pytest.mark.parametrize("seed", range(6))
def test_shard_samples_against_numpy(spark, seed):
    rnd = random.Random(100 + seed)
    doc, objects, want = plant(rnd, rnd.choice((1, 2, 3)), True, fill=0, packed=seed % 2 == 1)
    objects = {f"r/0/{k[2:]}": v for k, v in objects.items()}
    row = ("r", "0", True, None, None, None, None, "sharding_indexed", None, 3, None, objects, {})
    header = arrays.parsed(doc)
    found = [r for r in probed(spark, [row], k=4, inner=5)["r"] if r.path]
    assert found
    for r in found:
        if "#" not in r.path:
            assert r.status == "missing" and r.path not in objects
            continue
        cells = want[tuple(slice(c * i, (c + 1) * i) for c, i in zip(r.chunk, header.inner))]
        assert cells.size and (r.status == "populated") == bool((cells != 0).any()) and r.index_crc == "verified"
    store, seen = arrays.Counted(PlantedStore(objects)), 0
    for s in probe.shard_samples(store, "r/0", header, 4, 5):
        seen += s["bytes"]
    assert sum(r.bytes for r in found) == seen + len(objects["r/0/zarr.json"])


def test_shard_faults(spark):
    doc, objects, _ = plant(random.Random(5), 1, True, holes=0)
    doc = doc | {"shape": [4], "chunk_grid": {"configuration": {"chunk_shape": [4]}}}
    doc["codecs"][0]["configuration"]["chunk_shape"] = [2]
    index = struct.pack("<4Q", 0, 4, 4, 4)
    good = b"\1\0\0\0\7\0\7\0" + index + struct.pack("<I", crc(index))
    doc["fill_value"] = 7
    cases = {"good": good, "small": b"abc", "crc": good[:-1] + bytes([good[-1] ^ 1]), "beyond": b"" + struct.pack("<4Q", 0, 4, 9000, 4) + struct.pack("<I", crc(struct.pack("<4Q", 0, 4, 9000, 4)))}
    rows = []
    for root, body in cases.items():
        rows.append((root, "0", True, None, None, None, None, "sharding_indexed", None, 3, None, {f"{root}/0/zarr.json": json.dumps(doc).encode(), f"{root}/0/c/0": body}, {}))
    rows.append(("absent", "0", True, None, None, None, None, "sharding_indexed", None, 3, None, {"absent/0/zarr.json": json.dumps(doc).encode()}, {}))
    rows.append(("denied", "0", True, None, None, None, None, "sharding_indexed", None, 3, None, {"denied/0/zarr.json": json.dumps(doc).encode()}, {"denied/0/c/0": 403}))
    rows.append(("headless", "0", True, None, None, None, None, "sharding_indexed", None, 3, None, {}, {}))
    got = {root: [r.status for r in found] for root, found in probed(spark, rows).items()}
    assert got == {"good": ["populated", "empty"], "small": ["undecodable"], "crc": ["checksum_mismatch"], "beyond": ["populated", "fetch_error"], "absent": ["missing"], "denied": ["fetch_error"], "headless": ["fetch_error"]}
    windows = {root: [r.status for r in found] for root, found in probed(spark, rows, windows=True, k=1).items()}
    assert windows == {"good": ["populated"], "small": ["fetch_error"], "crc": ["fetch_error"], "beyond": ["fetch_error"], "absent": ["empty"], "denied": ["fetch_error"], "headless": ["fetch_error"]}


# ------------------------------------------------------------------ arrays as relations
def write(base, objects):
    for path, body in objects.items():
        file = base / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(body)


@pytest.mark.parametrize("sharded", [False, True])
def test_cells_of_a_box(spark, tmp_path, sharded):
    rnd = random.Random(11)
    doc, objects, want = plant(rnd, 3, sharded)
    header = arrays.parsed(doc)
    z, y = want.shape[0] // 2, want.shape[1] // 3
    # an object that doesn't meet the box is a folder: opening it would end the job as undecodable or absent
    for path in list(objects):
        if path != "a/zarr.json":
            place = tuple(map(int, path.split("/")[2:]))
            if (place[0] + 1) * header.chunks[0] <= z or place[1] * header.chunks[1] > y:
                objects[path] = b"!"
    write(tmp_path, objects)
    cells = array_source.cells(spark, str(tmp_path), "a", task_bytes=8)
    assert cells.columns == ["z", "y", "x", "value"]
    got = {(r.z, r.y, r.x): r.value for r in cells.filter(f"z >= {z} and y <= {y} and x <> 0").collect()}
    assert got == {(i, j, k): float(want[i, j, k]) for i in range(z, want.shape[0]) for j in range(y + 1) for k in range(1, want.shape[2])}
    assert cells.filter("z < 0").count() == 0
    one = cells.filter(f"z = {z} and y in (0, {y})").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in one} == {j: want.shape[2] for j in {0, y}}
    assert array_source.cells(spark, str(tmp_path), "a", axes="a,b,c").columns == ["a", "b", "c", "value"]
