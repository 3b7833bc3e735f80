"""Census from listings against what was planted; table functions."""

import json
import math
import random
import zlib

import pytest

from plumbline.functions import table_functions
from plumbline.operators import census

LEVELS = "root string, path string, present boolean, shape array<bigint>, chunks array<bigint>, dtype string, compressor_id string, separator string, zarr_format int, objects map<string, binary>, faults map<string, int>"


def plant(rnd, root):
    ndim = rnd.choice((1, 2, 3))
    v3, sep = rnd.random() < 0.4, rnd.choice("./")
    grid = [rnd.randrange(1, 6) for _ in range(ndim)]
    plain, full = rnd.random() < 0.6, 4 * 2**ndim
    objects, sizes = {}, []
    places = [p for p in __import__("itertools").product(*map(range, grid)) if rnd.random() < 0.6]
    for p in places:
        key = "c/" + "/".join(map(str, p)) if v3 else sep.join(map(str, p))
        body = bytes(full) if plain and rnd.random() < 0.9 else b"z" * rnd.randrange(1, 40)
        objects[f"{root}/0/{key}"] = body
        sizes.append((p, key, len(body), body))
    objects[f"{root}/0/.zarray"] = b"{}"
    objects[f"{root}/0/7x/odd"] = b"no chunk"
    row = (root, "0", True, [2 * g for g in grid], [2] * ndim, "<f4", "none" if plain else "blosc", sep, 3 if v3 else 2, objects, {})
    order = sorted(sizes, key=lambda s: [str(i) for i in s[0]] if v3 or sep == "/" else s[1])
    return row, (grid, plain, full, order)


@pytest.mark.parametrize("seed", range(3))
def test_against_what_was_planted(spark, seed):
    rnd = random.Random(seed)
    plants = [plant(rnd, f"r{i}") for i in range(25)]
    rows = census.census(spark.createDataFrame([p for p, _ in plants], LEVELS), head_sample=5, read_sample=3).collect()
    got = {r.root: r for r in rows}
    for row, (grid, plain, full, order) in plants:
        r, n = got[row[0]], len(order)
        assert (r.grid_chunks, r.present_chunks, r.error) == (math.prod(grid), n, None)
        at = lambda k: [order[i] for i in (range(n) if n <= k else [i * n // k for i in range(k)])]
        heads = [s[2] for s in at(5)]
        assert r.head_n == len(heads)
        exact = plain and n > 0 and all(s == full for s in heads)
        assert r.stored_bytes == (n * full if exact else int(sum(heads) / len(heads) * n) if n else 0)
        assert r.basis == ("exact" if exact else "estimated")
        reads = [s[3] for s in at(3)] if plain else []
        ratio = sum(map(len, reads)) / sum(len(zlib.compress(b, 6)) for b in reads) if reads else None
        assert (r.ratio is None) == (ratio is None) and (ratio is None or abs(r.ratio - ratio) < 1e-5)


def test_unknown_listings_are_no_small_numbers(spark):
    base = ("r", "0", True, [8, 8], [2, 2], "<f4", "none", "/", 2)
    objects = {f"r/0/{i}/{j}": bytes(16) for i in range(4) for j in range(3)}
    one = lambda faults, o=objects: census.census(spark.createDataFrame([(*base, o, faults)], LEVELS)).first()
    assert (one({}).present_chunks, one({}).stored_bytes, one({}).basis) == (12, 192, "exact")
    for path in ("r/0", "r/0/2"):
        r = one({path: 503})
        assert r.present_chunks is None and r.present_fraction is None and r.basis is None and r.error == "HTTP 503"
    empty = one({}, {})
    assert (empty.present_chunks, empty.stored_bytes, empty.error) == (0, 0, None)
    refused = one({k: 403 for k in objects})  # listed, but nothing can be weighed
    assert refused.present_chunks == 12 and refused.head_n == 0 and refused.stored_bytes is None


def test_table_functions(spark):
    table_functions.register(spark)
    good = {"zarr_format": 3, "shape": [8], "data_type": "int16", "chunk_grid": {"configuration": {"chunk_shape": [4]}}, "fill_value": "NaN", "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2], "codecs": [{"name": "bytes"}, {"name": "zlib"}], "index_codecs": []}}]}
    spark.createDataFrame([(1, json.dumps(good)), (2, "{"), (3, None), (4, "[]")], "k int, raw string").createOrReplaceTempView("headers_of_test")
    rows = {r.k: r for r in spark.sql("select h.k, t.* from headers_of_test h, lateral array_header(h.raw) t").collect()}
    assert sorted(rows) == [1, 2, 4] and rows[2].error and rows[4].error
    assert (rows[1].zarr_format, rows[1].inner_chunks, rows[1].dtype, rows[1].codecs, rows[1].fill_value) == (3, [2], "int16", ["zlib"], "NaN")
    doc = {"ome": {"version": "0.5", "multiscales": [{"axes": [{"name": "y"}, "x"], "datasets": [{"path": "a", "coordinateTransformations": [{"type": "scale", "scale": [1, 2]}]}, {}]}]}}
    spark.createDataFrame([(json.dumps({"attributes": doc}),), ("{}",)], "raw string").createOrReplaceTempView("groups_of_test")
    rows = spark.sql("select t.* from groups_of_test g, lateral pyramid_levels(g.raw) t order by idx nulls last").collect()
    assert [(r.idx, r.path, r.scale, r.axes, r.version) for r in rows[:2]] == [(0, "a", [1.0, 2.0], ["y", "x"], "0.5"), (1, "1", None, ["y", "x"], "0.5")] and rows[2].error
    with pytest.raises(Exception, match="text expected"):
        spark.sql("select * from array_header(5)")
    with pytest.raises(Exception, match="a whole number expected"):
        spark.sql("select * from shard_index(cast('' as binary), 'x', true)")
    assert spark.sql("select error from shard_index(cast('abc' as binary), 2, false)").first()[0] == "3 bytes are no index of 2"
