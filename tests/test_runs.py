"""Percentiles by selection, loaders in file order, runs and their manifests."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import binary
from plumbline.operators import selection
from plumbline.sources import loaders, sinks


@pytest.mark.parametrize("parts", [1, 7])
def test_percentiles_against_numpy(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice("abc"), rnd.choice((rnd.gauss(0, 1), float(rnd.randrange(4)), 7.0))) for _ in range(3000)]
    rows += [("hot", 1.0)] * 2000 + [("one", 5.0), ("none", None), ("none", float("nan")), (None, 2.0), (None, 4.0), ("zeros", -0.0), ("zeros", 0.0), ("inf", float("inf")), ("inf", 1.0)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.k: r for r in selection.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.99, "e": 1.0}).collect()}
        whole = selection.percentiles(spark.createDataFrame(rows, "k string, v double"), [], "v", {"m": 0.5}).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    keys = {k for k, _ in rows} - {"none"}
    assert set(got) == keys
    for k in keys - {"inf"}:
        values = [v for key, v in rows if key == k and v is not None and v == v]
        assert np.allclose([got[k][c] for c in "abcde"], np.percentile(values, [0, 1, 50, 99, 100]), atol=1e-12)
    assert got["inf"].e == float("inf") and got["inf"].a == 1.0
    assert whole.m == np.median([v for _, v in rows if v is not None and v == v])


def write_lines(path, lines):
    path.write_text("".join(line + "\n" for line in lines))


@pytest.mark.parametrize("size", ["64", "1000", "128m"])
def test_lines_keep_their_numbers(spark, tmp_path, size):
    rnd = random.Random(3)
    files = {}
    for name in ("a.jsonl", "b.jsonl"):
        lines = []
        for i in range(300):
            root = f"r{rnd.randrange(60)}"
            lines.append(rnd.choice((json.dumps({"root": root, "n": i}), json.dumps({"root": root}), "", '{"root": ', json.dumps({"other": 1}), "[1]", "no json " + root)))
        write_lines(tmp_path / name, lines)
        files[name] = lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        lines = loaders.numbered_lines(spark, str(tmp_path))
        got = {(os.path.basename(r.file), r.line): r.value for r in lines.collect()}
        assert got == {(name, i): line for name, own in files.items() for i, line in enumerate(own, 1)}
        first, counts = loaders.roots(lines)
        want, bad = {}, 0
        for name, own in files.items():
            for i, line in enumerate(own, 1):
                if not line.strip():
                    continue
                try:
                    want.setdefault(json.loads(line)["root"], (name, i))
                except (ValueError, KeyError, TypeError):
                    bad += 1
        assert {r.root: (os.path.basename(r.file), r.line) for r in first.collect()} == want
        c = counts.first()
        assert (c.bad, c.roots) == (bad, len(want)) and c.lines == c.bad + c.roots + c.repeated
        with pytest.raises(Exception, match="no root in"):
            loaders.roots(lines, strict=True)[0].collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_levels_that_are_chosen(spark, tmp_path):
    rows = [{"root": f"v/{i % 20}", "level": str(i // 20), "present": i % 7 != 0, "shape": [4, 4] if i % 5 else [], "chunks": [2, 2], "compressor": "Sharding_Indexed" if i % 3 else None} for i in range(100)]
    write_lines(tmp_path / "l.jsonl", ["", "{broken", *map(json.dumps, rows)])
    lines = loaders.numbered_lines(spark, str(tmp_path / "l.jsonl"))
    good = [r for r in rows if r["present"] and r["shape"]]
    take = lambda df: {(r.root, r.level) for r in df.collect()}
    assert take(loaders.levels(lines)) == {(r["root"], r["level"]) for r in good}
    assert take(loaders.levels(lines, only_sharded=True)) == {(r["root"], r["level"]) for r in good if r["compressor"]}
    named = {(r["root"], r["level"]) for r in good if "1" in r["root"]}
    assert take(loaders.levels(lines, root_parts=("1",))) == named
    more = take(loaders.levels(lines, root_parts=("1",), random_roots=2, seed=5))
    assert named < more and len({r for r, _ in more} - {r for r, _ in named}) == 2
    assert more == take(loaders.levels(lines, root_parts=("1",), random_roots=2, seed=5))
    order = list(dict.fromkeys(r["root"] for r in good))
    assert {r for r, _ in take(loaders.levels(lines, most_roots=3))} == set(order[:3])


def test_a_run_keeps_what_was_there(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.range(10).select(F.col("id"), F.when(F.col("id") > 6, "x").alias("code"))
    with sinks.Run(spark, folder, "tool", ["--a"]) as run:
        run.write(df, "rows", "csv", {"coded": F.count("code")})
        run.write(df.filter("id < 2"), "few", "jsonl", {"coded": F.count("code"), "most": F.max("id")})
        run.count("by hand", 3)
    m = sinks.read_manifest(spark, run.manifest).first()
    assert m.counters == {"coded": 3, "most": 1, "by hand": 3} and m.ok and m.finished and m.argv == ["--a"]
    assert {k: (v.kind, v.rows, v.backup) for k, v in m.outputs.items()} == {"rows": ("csv", 10, None), "few": ("jsonl", 2, None)}
    assert sinks.read_csv(spark, f"{folder}/rows", ["id", "code"]).filter("code = ''").count() == 7

    # a job that dies leaves the old output, no draft, and a manifest that says so
    with pytest.raises(Exception):
        with sinks.Run(spark, folder, "tool") as run:
            run.write(df.select(F.raise_error(F.lit("killed")).alias("id")), "rows", "csv")
    assert sinks.read_csv(spark, f"{folder}/rows", ["id", "code"]).count() == 10
    assert not [n for n in os.listdir(folder) if n.startswith(".rows")]
    m = sinks.read_manifest(spark, run.manifest).first()
    assert m.ok is False and m.error and m.outputs == {}

    # the next run moves it aside, twice within a second too
    for n in (1, 2):
        with sinks.Run(spark, folder, "tool") as run:
            run.write(df.filter(F.col("id") < n), "rows", "csv")
    backups = sorted(n for n in os.listdir(folder) if n.startswith("rows.") and ".bak" in n)
    assert len(backups) == 2 and sorted(sinks.read_csv(spark, f"{folder}/{b}", ["id", "code"]).count() for b in backups) == [1, 10]
    assert len([n for n in os.listdir(folder) if n.startswith("tool.manifest.json.")]) == 3
    with pytest.raises(ValueError, match="mix two runs"):
        run.write(df, "rows", "csv", mode="append")


def test_crc_of_slices():
    def crc(data):
        c = 0xFFFFFFFF
        for byte in data:
            c ^= byte
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    blobs = [os.urandom(n) for n in (0, 1, 2, 3, 4, 5, 255, 256, 257, 511, 512, 513, 2000)]
    assert binary.crc32c_of(blobs).tolist() == [crc(b) for b in blobs]
    assert binary.crc32c_of([]).tolist() == []
