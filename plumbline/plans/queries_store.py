"""Queries over stores: shards, windows, arrays as relations. What the stores hold is made from the tables,
by programs that know nothing of those that read it; the SQL computes from the same rules."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import census, crawl, probe, voxels
from ..sources import array_source, arrays, listing, mounted_path, new_path
from . import queries_content, tables
from .catalogue import Catalogue
from .tables import read

catalogue = Catalogue()
query = catalogue.query

# ------------------------------------------------------------------ shards
#: Each part is a level of six bytes for each unit of its size, in shards of four inner chunks of eight.
SHARD_HEADER = '{"zarr_format":3,"node_type":"array","shape":[%d],"data_type":"uint8","chunk_grid":{"name":"regular","configuration":{"chunk_shape":[32]}},"fill_value":0,"codecs":[{"name":"sharding_indexed","configuration":{"chunk_shape":[8],"codecs":[{"name":"bytes"}],"index_codecs":[{"name":"bytes"},{"name":"crc32c"}]}}]}'


def _bitwise(crc: int) -> int:
    for _ in range(8):
        crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc


BYTES = [_bitwise(n) for n in range(256)]


def _bytewise_crc32c(data: bytes) -> int:
    """One byte after the other; the reader has a program of its own."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = crc >> 8 ^ BYTES[(crc ^ byte) & 255]
    return crc ^ 0xFFFFFFFF


def _digit(*key: int) -> str:
    return hashlib.md5("/".join(map(str, key)).encode()).hexdigest()[0]


def _shard(p: int, s: int, cells: int) -> bytes:
    body, index = b"", b""
    for i in range(4):
        d, at = _digit(p, s, i), 32 * s + 8 * i
        valid = max(0, min(8, cells - at))
        part = {"8": b"\7\7\7", "9": bytes(valid) + b"\x09" * (8 - valid)}.get(d, bytes(8) if d in "4567" else b"\7" * 8)
        if d in "0123":
            index += b"\xff" * 16
            continue
        index += len(body).to_bytes(8, "little") + len(part).to_bytes(8, "little")
        body += part
    crc = _bytewise_crc32c(index) ^ (_digit(p, s) == "3")
    return body + index + crc.to_bytes(4, "little")


def sharded_levels(spark, sf_dir):
    """Levels with their part of a store: shards that are absent, cut short, with a wrong checksum or refused."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrays.slices(batches):
            rows = []
            for p, size in zip(b["p_partkey"].to_pylist(), b["p_size"].to_pylist()):
                base, cells = f"part/{p}/0", size * 6
                objects, faults = {f"{base}/zarr.json": (SHARD_HEADER % cells).encode()}, {}
                for s in range(-(-cells // 32)):
                    d = _digit(p, s)
                    if d == "4":
                        faults[f"{base}/c/{s}"] = 503
                    elif d not in "01":
                        objects[f"{base}/c/{s}"] = b"too short." if d == "2" else _shard(p, s, cells)
                rows.append({"root": f"part/{p}", "path": "0", "present": True, "compressor_id": "sharding_indexed", "objects": list(objects.items()), "faults": list(faults.items())})
            kinds = pa.schema([("root", pa.string()), ("path", pa.string()), ("present", pa.bool_()), ("compressor_id", pa.string()), ("objects", pa.map_(pa.string(), pa.binary())), ("faults", pa.map_(pa.string(), pa.int32()))])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism)
    return parts.mapInArrow(plant, "root string, path string, present boolean, compressor_id string, objects map<string, binary>, faults map<string, int>")


SHARDS = """with p as (select p_partkey p, p_size * 6 z, (p_size * 6 + 31) // 32 ns from part),
every as (select *, substr(md5(p || '/' || s), 1, 1) d from (select *, unnest(range(ns)) s from p)),
inn as (select *, case when e in ('0', '1', '2', '3') then 0 when e = '8' then 3 else 8 end n, greatest(0, least(8, z - 32 * s - 8 * i)) valid from (select *, substr(md5(p || '/' || s || '/' || i), 1, 1) e from (select *, unnest(range(4)) i from every))),
pl as (select *, sum(n) over (partition by p, s order by i) - n off from inn),
sh as (select * from every where s in (0, cast(round_even((ns - 1) / 2.0::double, 0) as bigint), ns - 1)),
seen as (select * from (select *, count(*) filter (d in ('2', '4')) over (partition by p order by s rows between unbounded preceding and 1 preceding) stopped from sh) where stopped = 0),
ch as (select pl.*, least(4, (z - 32 * s + 7) // 8) cps from pl join seen using (p, z, ns, s, d) where d not in ('0', '1', '2', '3', '4')),
pick as (select * from ch where i < cps and (cps < 4 or i <> 1)),
one as (
  select p, 'part/' || p || '/0/c/' || s path, case when d in ('0', '1') then 'missing' when d = '2' then 'undecodable' when d = '3' then 'checksum_mismatch' else 'fetch_error' end status, case when d = '3' then 'mismatch' else '' end index_crc from seen where d in ('0', '1', '2', '3', '4')
  union all
  select p, 'part/' || p || '/0/c/' || s || '#' || i, case when e in ('0', '1', '2', '3') then 'missing' when e = '8' then 'undecodable' when e in ('4', '5', '6', '7', '9') then 'empty' else 'populated' end, 'verified' from pick),
spent as (
  select p, 1 calls, """ + str(len(SHARD_HEADER) - 2) + """ + length(cast(z as varchar)) bytes from p
  union all select p, 1, case when d in ('0', '1', '4') then 0 when d = '2' then 10 else 68 end from seen
  union all select p, 1, max(off + n) - min(off) from pick where n > 0 group by p, s)
"""


@query("s20_shard_samples", SHARDS + "select 'part/' || p root, path, status, index_crc from one")
def shard_samples(spark, sf_dir):
    return probe.samples(sharded_levels(spark, sf_dir)).filter("path is not null").select("root", "path", "status", "index_crc")


@query("s20_shard_cost", SHARDS + "select 'part/' || p root, cast(sum(calls) as bigint) calls, cast(sum(bytes) as bigint) bytes from spent group by p")
def shard_cost(spark, sf_dir):
    return probe.cost(probe.samples(sharded_levels(spark, sf_dir))).drop("level")


@query(
    "s20_windows",
    SHARDS
    + """, w as (select *, least(64, z) n, cast(trunc((z - least(64, z)) * case k when 0 then 0.15::double when 1 then 0.5::double else 0.85::double end) as bigint) a from (select *, unnest(range(3)) k from p)),
hit as (select w.p, k, pl.s, pl.i, case when d in ('0', '1') then null when d in ('2', '3', '4') then 'fetch_error' when e in ('0', '1', '2', '3') then null when e = '8' then 'undecodable' end bad,
    d not in ('0', '1') and e not in ('0', '1', '2', '3', '4', '5', '6', '7', '9') filled
  from w join pl on pl.p = w.p and 32 * pl.s + 8 * pl.i < w.a + w.n and 32 * pl.s + 8 * pl.i + 8 > w.a)
select 'part/' || p root, cast(k as integer) place, coalesce(arg_min(bad, s * 4 + i) filter (bad is not null), case when bool_or(filled) then 'populated' else 'empty' end) status from hit group by p, k""",
)
def shard_windows(spark, sf_dir):
    return probe.samples(sharded_levels(spark, sf_dir), windows=True).select("root", "place", "status")


# ------------------------------------------------------------------ arrays as relations
#: Rows and columns of a chunk of the array of embeddings.
TILE = (256, 16)


def embedding_array(spark, sf_dir) -> str:
    """The base of a store with one array, ``vectors/0``: a row for each vector, four bytes a value; chunks
    whose number is divisible by 7 are left out."""
    base = mounted_path(spark, "arrays")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    height = (rows.agg(F.max("vec_id")).first()[0] or 0) + 1
    os.makedirs(f"{base}/vectors/0/c")
    header = {"zarr_format": 3, "node_type": "array", "shape": [height, 64], "data_type": "float32", "dimension_names": ["vec", "dim"], "fill_value": "NaN", "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}]}
    header |= {"chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(TILE)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "."}}}
    with open(f"{base}/vectors/0/zarr.json", "w") as f:
        json.dump(header, f)

    def write(table: pa.Table) -> pa.Table:
        at = table["vec_id"].to_numpy()
        tile = int(at[0]) // TILE[0]
        whole = np.full((TILE[0], 64), np.nan, "<f4")
        whole[at % TILE[0]] = np.stack(table["embedding"].to_numpy())
        for j in range(64 // TILE[1]):
            if (tile * 4 + j) % 7:
                path = f"{base}/vectors/0/c.{tile}.{j}"
                with open(f"{path}.{os.getpid()}", "wb") as f:  # renamed when whole, as a task can run twice
                    f.write(whole[:, j * TILE[1] : (j + 1) * TILE[1]].tobytes())
                os.replace(f"{path}.{os.getpid()}", path)
        return pa.table({"tile": [tile]})

    rows.groupBy(F.floor(F.col("vec_id") / TILE[0]).alias("tile")).applyInArrow(write, "tile bigint").write.format("noop").mode("overwrite").save()
    return base


CELLS = f"with cell as (select *, (vec // {TILE[0]} * 4 + dim // {TILE[1]}) % 7 = 0 hole from (select vec_id vec, unnest(range(64)) dim, unnest(embedding) v from embeddings)) "


@query("s19_array_box", CELLS + "select dim, count(*) n, count(*) filter (not hole) stored, round(sum(case when not hole then cast(v as double) else 0.0 end), 4) total from cell where vec >= 100 and vec < 700 and dim between 20 and 40 group by 1")
def array_box(spark, sf_dir):
    """A box of an array: chunks outside it are not opened, chunks that are absent read as fill."""
    cells = array_source.cells(spark, embedding_array(spark, sf_dir), "vectors/0").filter("vec >= 100 and vec < 700 and dim between 20 and 40")
    kept = ~F.isnan("value")
    return cells.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(kept).alias("stored"), F.round(F.sum(F.when(kept, F.col("value")).otherwise(0.0)), 4).alias("total"))


@query("j13_array_join", CELLS + "select a.vec, count(*) n, count(*) filter (a.v > 0.1) positives, count(*) filter (a.v > 0.1 and b.v <= 0) phantom from cell a join cell b on a.dim = b.dim and b.vec = a.vec + 1 where not a.hole and not b.hole and a.dim < 32 and b.dim < 32 group by 1")
def array_join(spark, sf_dir):
    """Each row of an array against the next, cell by cell, over its first 32 columns."""
    cells = array_source.cells(spark, embedding_array(spark, sf_dir), "vectors/0", stored=True).filter("dim < 32")
    other = cells.select((F.col("vec") - 1).alias("vec"), "dim", F.col("value").alias("w"))
    rows = cells.join(other, ["vec", "dim"])
    return rows.groupBy("vec").agg(F.count("*").alias("n"), F.count_if(F.col("value") > F.lit(0.1)).alias("positives"), F.count_if((F.col("value") > F.lit(0.1)) & (F.col("w") <= 0)).alias("phantom"))


@query("a19_array_support", CELLS + "select dim z, count(*) filter (v > 0) positives, count(*) filter (v > 0 and v <= 0.05) phantom, round(case when count(*) filter (v > 0) > 0 then count(*) filter (v > 0 and v <= 0.05) / count(*) filter (v > 0) end, 6) phantom_fraction from cell where not hole and vec < 512 group by rollup (dim)")
def array_support(spark, sf_dir):
    cells = array_source.cells(spark, embedding_array(spark, sf_dir), "vectors/0", stored=True).filter("vec < 512")
    return voxels.support(cells.withColumnRenamed("dim", "z"), "z", F.col("value") > 0, F.col("value") > F.lit(0.05))


# ------------------------------------------------------------------ crawl of a store by its listings
#: Folders whose listing fails: by the digits of the MD5 of their path.
REFUSED = "substr(md5(path), 1, 2) in ('00', '3c', '5d', '77', 'a1', 'fe')"
SITE = """with recursive u as (select distinct regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') p from pages),
parts as (select string_split(p, '/') s from u),
nodes as (select distinct array_to_string(s[1:i], '/') path, case when i > 1 then array_to_string(s[1:i - 1], '/') else '' end parent, s[i] as name from parts, lateral (select unnest(range(1, len(s) + 1)) i)),
kind as (select *, """ + REFUSED + """ refused, regexp_full_match(name, '[0-9]+(_[0-9]+)*') number, name like '%.zarr' zarr from nodes),
walk as (select '' path, 0 depth, 'folder' step
  union all select k.path, w.depth + 1, case when zarr then 'root' when number then 'coordinate' when refused then 'unlisted' else 'folder' end from walk w join kind k on k.parent = w.path where w.step = 'folder') """


def recorded_site(spark, sf_dir) -> str:
    """The hosts and folders of the pages' addresses as listings of a server, some of them refused."""
    folder = mounted_path(spark, "site")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/+$", "")
    parts = F.split(path, "/")
    edges = read(spark, sf_dir, "pages").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), F.get(parts, i - 1).alias("name")))).alias("e"))
    whole = F.when(F.col("e.parent") == "", F.col("e.name")).otherwise(F.concat_ws("/", "e.parent", "e.name"))
    folders = edges.select(F.col("e.parent").alias("path"), F.col("e.name").alias("name")).unionByName(edges.select(whole.alias("path"), F.lit(None).cast("string").alias("name")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import quote

        for b in batches:
            for path, names in zip(b["path"].to_pylist(), b["names"].to_pylist()):
                os.makedirs(f"{folder}/{path}", exist_ok=True)
                links = "".join(f'<a href="{quote(n)}/">{n}</a>' for n in ["..", *names])
                with open(f"{folder}/{path}/index.html", "w") as f:
                    f.write(f'<html><a href="?C=M;O=A">by date</a><a href="https://example.org/">home</a>{links}<a href="notes.txt">notes</a></html>')
                if hashlib.md5(path.encode()).hexdigest()[:2] in ("00", "3c", "5d", "77", "a1", "fe"):
                    with open(f"{folder}/{path}/.status", "w") as f:
                        f.write("503")
            yield b.select(["path"])

    folders.groupBy("path").agg(F.collect_set("name").alias("names")).mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return f"recorded:{folder}"


@query("w08_store_crawl", SITE + "select path, depth, step, case step when 'unlisted' then 'UNKNOWN' else 'PRESENT' end state, case step when 'unlisted' then 'SERVER_ERROR' end reason from walk")
def store_crawl(spark, sf_dir):
    """A store is crawled by its listings, depth after depth; what can't be listed stays unknown."""
    found = crawl.crawl_store(spark, recorded_site(spark, sf_dir), new_path(spark, "crawl"), max_depth=40)
    return found.select("path", "depth", "step", "state", "reason")


# ------------------------------------------------------------------ keys of an object store, page by page
@query(
    "s11_paged_keys",
    """with k as (select distinct l_suppkey s, l_suppkey % 29 = 0 denied, l_returnflag || '/' || l_linenumber || case when l_partkey % 3 = 0 then '/' || l_partkey else '-' || l_partkey % 50 end key from lineitem)
select 'bucket/' || s as store, key, cast(s % 7 as bigint) size, null error from k where not denied or key not like 'N/%' union all select distinct 'bucket/' || s, null, null, 'HTTP 403' from k where denied and key like 'N/%'""",
)
def paged_keys(spark, sf_dir):
    """Each supplier's bucket in pages of three keys, split where keys branch; of some a branch is refused."""
    name = F.concat(F.col("l_returnflag"), F.lit("/"), F.col("l_linenumber").cast("string"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("/"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("-"), (F.col("l_partkey") % 50).cast("string"))))
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", name.alias("name")).distinct()
    body = F.substring(F.encode(F.lit("x" * 6), "utf-8"), F.lit(1), (F.col("l_suppkey") % 7).cast("int"))
    buckets = rows.groupBy("l_suppkey").agg(F.collect_list("name").alias("names"))
    # a prefix of its own for each branch, as the first round would split them
    buckets = buckets.select(
        F.concat(F.lit("bucket/"), F.col("l_suppkey").cast("string")).alias("store"),
        F.map_from_entries(F.transform("names", lambda n: F.struct(n, body))).alias("objects"),
        F.when(F.col("l_suppkey") % 29 == 0, F.create_map(F.lit("N"), F.lit(403))).alias("faults"),
        F.explode(F.array_distinct(F.transform("names", lambda n: F.substring_index(n, "/", 1)))).alias("top"),
    )
    found = listing.all_keys(buckets.select("store", F.concat("top", F.lit("/")).alias("key"), "objects", "faults"), size=3, pages=2)
    return found.select("store", F.when(F.col("kind") == "key", F.col("key")).alias("key"), "size", "error")


# ------------------------------------------------------------------ census of planted levels, costs, foreground
#: Keys in the order of the listings: of nested levels axis by axis.
STORED = queries_content.PROBE.rstrip().rstrip(")").rpartition("ps as (")[0].rstrip().rstrip(",") + """,
ky as (select *, case when zarr_format = 3 or separator = '/' then list_transform(pl, lambda i: cast(i as varchar)) else [array_to_string(pl, '.')] end o from sz where d > '3'),
pk as (select *, row_number() over (partition by root, path order by o) - 1 place, count(*) over (partition by root, path) m from ky),
hd as (select root, path, count(*) head_n, avg(n) mean, bool_and(compressor_id = 'none' and n = list_product(chunks) * w) whole from pk where m <= 4 or place in (0, m // 4, 2 * m // 4, 3 * m // 4) group by 1, 2),
cs as (select t.root, t.path as level, t.total grid_chunks, coalesce(k.m, 0) present_chunks, round(coalesce(k.m, 0) / t.total, 6) present_fraction, coalesce(h.head_n, 0) head_n, coalesce(cast(floor(h.mean * k.m) as bigint), 0) stored_bytes, case when h.whole then 'exact' else 'estimated' end basis
  from tot t left join (select root, path, count(*) m from ky group by 1, 2) k using (root, path) left join hd h using (root, path) where len(t.shape) > 0)
"""


@query("a12_listing_census", STORED + "select * from cs")
def listing_census(spark, sf_dir):
    """Chunks of the planted levels, counted from listings and weighed by four HEADs a level."""
    found = census.census(queries_content.planted(spark, sf_dir), head_sample=4, read_sample=2)
    return found.select("root", "level", "grid_chunks", "present_chunks", "present_fraction", "head_n", "stored_bytes", "basis")


@query("a25_cost_counters", queries_content.PROBE + "select compressor_id category, count(distinct (c.root, c.path)) levels, cast(sum(calls) as bigint) calls, cast(sum(bytes) as bigint) bytes from (select root, level as path, sum(calls) calls, sum(bytes) bytes from ps group by 1, 2) c join lv using (root, path) group by 1")
def cost_counters(spark, sf_dir):
    """What the probe of a store's chunks took, by codec."""
    cost = probe.cost(queries_content.probed(spark, sf_dir))
    rows = cost.join(tables.levels(spark, sf_dir).select("root", F.col("path").alias("level"), F.col("compressor_id").alias("category")), ["root", "level"])
    return rows.groupBy("category").agg(F.count("*").alias("levels"), F.sum("calls").alias("calls"), F.sum("bytes").alias("bytes"))


@query("f17_foreground", CELLS + "select vec, count(*) n, count(*) filter (v > 0.1) foreground from cell where not hole and vec < 640 group by 1")
def foreground(spark, sf_dir):
    """Cells of an array above the threshold, row by row."""
    cells = array_source.cells(spark, embedding_array(spark, sf_dir), "vectors/0", stored=True).filter("vec < 640")
    return cells.groupBy("vec").agg(F.count("*").alias("n"), F.count_if(F.col("value") > F.lit(0.1)).alias("foreground"))
