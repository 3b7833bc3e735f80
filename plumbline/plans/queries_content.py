"""Queries of the content tier: chunk samples, census, surfaces, voxels."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import binary
from ..operators import chunks, probe, sampling, surfaces, voxels
from ..sources import store_table
from .catalogue import Catalogue
from . import tables
from .oracle import LEVELS
from .tables import read

catalogue = Catalogue()
query = catalogue.query

# ------------------------------------------------------------------ chunk samples
STATUS = "case when k % 10 < 4 then 'populated' when k % 10 < 7 then 'empty' when k % 10 = 7 then 'missing' when k % 10 = 8 then 'absent' when k % 20 = 9 then 'undecodable' when k = 19 then 'checksum_mismatch' else 'http_error' end"
SAMPLES = f"""with s as (select user_id, event_type, event_id, ts, {STATUS} status, value from (select *, cast(props->>'$.k' as int) k from events)),
ranked as (select *, row_number() over w k, sum(case when status <> 'absent' then 1 else 0 end) over (w rows unbounded preceding) hits from s window w as (partition by user_id, event_type order by ts, event_id)),
chosen as (select * from ranked where k <= 9 and status <> 'absent' and hits <= 3),
lv as (select user_id, event_type, case when user_id % 5 = 0 then false when user_id % 7 <> 0 then true end has_chunks from (select distinct user_id from events), (select distinct event_type from events)) """


def samples(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.expr(STATUS)
    return read(spark, sf_dir, "events").withColumn("k", k).select("user_id", "event_type", "event_id", "ts", status.alias("status"), "value")


def chosen(spark, sf_dir):
    return sampling.first_hits(samples(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"], F.col("status") != "absent", 3, 9)


#: Event types that one row carries where each user meets each of them.
TYPES_A_ROW = 1000


def sample_levels(spark, sf_dir):
    """Each user with each event type: types are packed, and the packs joined with the users."""
    e = read(spark, sf_dir, "events")
    types = store_table(e.select("event_type").distinct())
    packs = max(1, -(-types.count() // TYPES_A_ROW))
    types = types.groupBy(F.pmod(F.xxhash64("event_type"), F.lit(packs)).alias("pack")).agg(F.collect_list("event_type").alias("types"))
    users = e.select("user_id").distinct().withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)).cast("array<bigint>")))
    users = users.join(F.broadcast(types) if packs <= 1000 else types, "pack")
    return users.select("user_id", F.explode("types").alias("event_type"), F.when(F.col("user_id") % 5 == 0, False).when(F.col("user_id") % 7 != 0, True).alias("has_chunks"))


@query("w04_first_k", SAMPLES + "select user_id, event_type, event_id, status from chosen")
def first_k(spark, sf_dir):
    return chosen(spark, sf_dir).select("user_id", "event_type", "event_id", "status")


# ------------------------------------------------------------------ chunk probe
#: What a store holds at a chunk's path is decided by the first digit of the path's MD5: nothing, an error
#: of the server, other values than the fill, the fill alone (of some of these, sevens after 4,100 bytes of
#: it), or three bytes of sevens whatever the type. Plain zlib is stored, so its size is known.
PROBE = "with " + LEVELS + """,
ok as (select *, list_transform(range(1, len(shape) + 1), lambda i: greatest(1, cast(ceil(shape[i] / chunks[i]) as bigint))) g from lv where present),
tot as (select *, cast(list_product(g) as bigint) total from ok),
pos as (select *, unnest(list_sort(list_distinct(list_transform(range(9), lambda i: cast(round_even(i * (total - 1) / 8.0::double, 0) as bigint))))) flat from tot),
ix as (select *, case when len(g) = 2 then [flat // g[2], flat % g[2]] else [flat // (g[2] * g[3]), (flat // g[3]) % g[2], flat % g[3]] end pl from pos),
ob as (select *, root || '/' || path || '/' || case when zarr_format = 3 then 'c/' || array_to_string(pl, '/') when separator = '/' then array_to_string(pl, '/') else array_to_string(pl, '.') end obj from ix),
fd as (select *, substr(md5(obj), 1, 1) d, md5(obj) like 'd0%' late, case dtype when '|u1' then 1 when '<u2' then 2 else 4 end w from ob),
sz as (select *, d in ('0', '1', '2') gone, compressor_id = 'none' and dtype <> '<f4' early, case when d in ('e', 'f') then 3 when late then 4100 + 8 * w else 8 * w end + case when compressor_id = 'zlib:l1' then 11 else 0 end n from fd),
rk as (select *, count(*) filter (not gone) over (partition by root, path order by flat) hits from sz),
ps as (select root, path as level, obj as path, gone, hits, 1 + case when gone or d = '3' then 0 when early and late then 2 else 1 end calls, case when gone or d = '3' then 0 when early and late then 4096 + n else n end bytes, case
    when d = '3' then 'fetch_error' when compressor_id not in ('none', 'zlib:l1') then 'undecodable'
    when d in ('e', 'f') and dtype = '<f4' then 'undecodable'
    when d in ('a', 'b', 'c', 'd') and not late then 'empty' else 'populated' end status from rk where hits <= 3 and not (hits = 3 and gone))
"""


def bodies(kind: str, dtype: str, codec: str) -> bytes:
    """What a chunk holds: ``late`` sevens after 4,100 bytes of the fill, ``fill``, three bytes, or other ``values``."""
    width = binary.WIDTHS[dtype]
    raw = {"late": bytes(4100) + b"\7" * (8 * width), "fill": bytes(8 * width), "three": b"\7" * 3, "values": b"\7" * (8 * width)}[kind]
    return zlib.compress(raw, 0) if codec.startswith("zlib") else raw


#: Types and codecs of the levels, and every body that a chunk of them can have.
DTYPES, CODECS, KINDS = ("|u1", "<u2", "<f4"), ("none", "zlib:l1", "blosc:lz4:l5"), ("late", "fill", "three", "values")


def planted(spark, sf_dir):
    """Levels with their part of a store: ``objects`` and ``faults``. Both are made inside the row of a level."""
    levels = tables.levels(spark, sf_dir)
    grid = F.transform(fn.grid("shape", "chunks"), lambda n: F.greatest(F.lit(1).cast("bigint"), n))
    own = {k: F.create_map(*(x for d in DTYPES for c in CODECS for x in (F.lit(f"{d} {c}"), F.lit(bodies(k, d, c)))))[F.concat_ws(" ", "dtype", "compressor_id")] for k in KINDS}
    rows = levels.withColumns({"grid": F.when(probe.good_level(), grid), **{f"__{k}": body for k, body in own.items()}})
    # grids have two or three axes; of two, the first plane is all
    rows = rows.withColumns({"across": F.element_at("grid", -1), "down": F.element_at("grid", -2), "deep": F.size("grid") == 3})
    rows = rows.withColumns({
        "plane": F.col("across") * F.col("down"),
        "total": F.col("across") * F.col("down") * F.when(F.col("deep"), F.col("grid")[0]).otherwise(1),
        "base": F.concat("root", F.lit("/"), "path", F.when(F.col("zarr_format") == 3, "/c/").otherwise("/")),
        "mark": F.when((F.col("zarr_format") == 3) | (F.col("separator") == "/"), "/").otherwise("."),
    })
    whole = lambda n, by: ((n - n % by) / by).cast("bigint")
    flat = lambda n: F.concat(whole(n, F.col("across")) % F.col("down"), F.col("mark"), n % F.col("across"))
    place = lambda n: F.when(F.col("deep"), F.concat("base", whole(n, F.col("plane")), "mark", flat(n))).otherwise(F.concat("base", flat(n)))
    path = F.transform(fn.spread_positions(F.col("total"), 9), place)
    rows = rows.withColumn("places", F.transform(path, lambda p: F.struct(p.alias("path"), F.md5(p.cast("binary")).alias("md5"))))
    digit = lambda p: F.substring(p.md5, 1, 1)
    body = lambda p: F.when(p.md5.startswith("d0"), F.col("__late")).when(digit(p).between("a", "d"), F.col("__fill")).when(digit(p).isin("e", "f"), F.col("__three")).otherwise(F.col("__values"))
    there = F.transform(F.filter("places", lambda p: digit(p) > "3"), lambda p: F.struct(p.path, body(p)))
    refused = F.transform(F.filter("places", lambda p: digit(p) == "3"), lambda p: F.struct(p.path, F.lit(503)))
    return rows.select(*levels.columns, F.map_from_entries(there).alias("objects"), F.map_from_entries(refused).alias("faults"))


def probed(spark, sf_dir):
    return probe.samples(planted(spark, sf_dir))


@query("k00_chunk_probe", PROBE + "select root, level, path, status from ps where not gone")
def chunk_probe(spark, sf_dir):
    return probe.statuses(probed(spark, sf_dir))


@query("k00_probe_cost", PROBE + "select root, level, cast(sum(calls) as bigint) calls, cast(sum(bytes) as bigint) bytes from ps group by 1, 2")
def probe_cost(spark, sf_dir):
    """What was asked of the store for each level: no body of a chunk that isn't chosen."""
    return probe.cost(probed(spark, sf_dir))


PROBED = "select root, level, count(*) n, count(*) filter (status in ('populated', 'empty')) decodable, count(*) filter (status = 'empty') as empty from ps where not gone group by 1, 2"


@query("k00_level_codes", PROBE + f"""select lv.root, lv.path as level, case when x.n is null then case when has_chunks = false then 'CHUNK_LEVEL_NO_CHUNKS' else 'CHUNK_LEVEL_NO_SAMPLES' end else 'CHUNK_SAMPLE_ALL_EMPTY' end code,
    case when x.n is null then 'info' else 'medium' end severity from lv left join ({PROBED}) x on lv.root = x.root and lv.path = x.level where x.n is null or (decodable > 0 and decodable = empty)""")
def probed_level_codes(spark, sf_dir):
    levels = tables.levels(spark, sf_dir).select("root", F.col("path").alias("level"), "has_chunks")
    return chunks.level_codes(levels, probe.statuses(probed(spark, sf_dir)), ["root", "level"])


CODE = "case status when 'populated' then 'CHUNK_SAMPLE_POPULATED' when 'empty' then 'CHUNK_SAMPLE_EMPTY' when 'missing' then 'CHUNK_SAMPLE_MISSING' when 'absent' then 'CHUNK_SAMPLE_ABSENT' when 'undecodable' then 'CHUNK_UNDECODEABLE' when 'checksum_mismatch' then 'SHARD_INDEX_CHECKSUM_MISMATCH' else 'CHUNK_FETCH_ERROR' end"


@query("j11_sample_codes", SAMPLES + f"select event_id, {CODE} code, case when status in ('undecodable', 'http_error') then 'low' when status = 'checksum_mismatch' then 'medium' else 'info' end severity from s")
def sample_codes(spark, sf_dir):
    return chunks.sample_codes(samples(spark, sf_dir)).select("event_id", "code", "severity")


for _i, _code in enumerate("CHUNK_SAMPLE_POPULATED CHUNK_SAMPLE_EMPTY CHUNK_SAMPLE_MISSING CHUNK_SAMPLE_ABSENT".split(), 1):

    @query(f"k{_i:02d}_{_code.lower()}", SAMPLES + f"select user_id, event_type, count(*) n from s where {CODE} = '{_code}' group by 1, 2")
    def sample_code(spark, sf_dir, code=_code):
        return chunks.sample_codes(samples(spark, sf_dir)).filter(F.col("code") == code).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


for _i, _code in ((7, "CHUNK_UNDECODEABLE"), (8, "CHUNK_FETCH_ERROR"), (9, "SHARD_INDEX_CHECKSUM_MISMATCH")):

    @query(f"k{_i:02d}_{_code.lower()}", SAMPLES + f"select user_id, event_type, count(*) n from s where {CODE} = '{_code}' group by 1, 2")
    def failed_code(spark, sf_dir, code=_code):
        return chunks.sample_codes(samples(spark, sf_dir)).filter(F.col("code") == code).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


LEVEL_CODES = (
    SAMPLES
    + """, sums as (select user_id, event_type, count(*) n, count(*) filter (status in ('populated', 'empty')) decodable, count(*) filter (status = 'empty') emptied from chosen group by 1, 2),
codes as (select lv.*, case when n is null then case when has_chunks = false then 'CHUNK_LEVEL_NO_CHUNKS' else 'CHUNK_LEVEL_NO_SAMPLES' end when decodable > 0 and decodable = emptied then 'CHUNK_SAMPLE_ALL_EMPTY' end code
  from lv left join sums using (user_id, event_type)) """
)


def level_codes(spark, sf_dir):
    return chunks.level_codes(sample_levels(spark, sf_dir), chosen(spark, sf_dir), ["user_id", "event_type"])


@query("a09_level_codes", LEVEL_CODES + "select user_id, event_type, code, case when code = 'CHUNK_SAMPLE_ALL_EMPTY' then 'medium' else 'info' end severity from codes where code is not null")
def all_level_codes(spark, sf_dir):
    return level_codes(spark, sf_dir)


for _id, _code in (("k05_no_chunks", "CHUNK_LEVEL_NO_CHUNKS"), ("k06_no_samples", "CHUNK_LEVEL_NO_SAMPLES"), ("k10_all_empty", "CHUNK_SAMPLE_ALL_EMPTY")):

    @query(_id, LEVEL_CODES + f"select user_id, event_type from codes where code = '{_code}'")
    def one_level_code(spark, sf_dir, code=_code):
        return level_codes(spark, sf_dir).filter(F.col("code") == code).select("user_id", "event_type")


@query("a10_no_samples", LEVEL_CODES + "select code, count(*) n from codes where code like 'CHUNK_LEVEL%' group by 1")
def no_samples(spark, sf_dir):
    return level_codes(spark, sf_dir).filter(F.col("code").startswith("CHUNK_LEVEL")).groupBy("code").agg(F.count("*").alias("n"))


@query("a11_scan_totals", SAMPLES + f"select {CODE} code, count(*) n, count(distinct user_id) roots, count(distinct (user_id, event_type)) levels, cast(sum(cast(value * 100 as bigint)) as bigint) bytes from s group by 1")
def scan_totals(spark, sf_dir):
    rows = chunks.sample_codes(samples(spark, sf_dir))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("roots"), F.count_distinct("user_id", "event_type").alias("levels"), F.sum(F.rint(F.col("value") * 100).cast("bigint")).alias("bytes"))


# ------------------------------------------------------------------ census
CENSUS = """with g as (select l_suppkey root, l_linenumber as level, count(*) present_chunks, bool_and(l_linestatus = 'O' and l_quantity = 50) exact, avg(l_quantity) mean, sum(l_quantity) encoded, 50.0 * count(*) as raw from lineitem group by 1, 2),
c as (select root, level, present_chunks, round(present_chunks / 600, 6) present_fraction, cast(trunc(case when exact then encoded else mean * present_chunks end) as bigint) stored_bytes, round(raw / encoded, 6) compression_ratio,
  encoded, raw, case when exact then 'exact' else 'estimated' end basis from g),
d as (select *, cast(trunc(greatest(0.0, 1 - encoded / raw) * stored_bytes) as bigint) recoverable_bytes from c) """


def census(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("root"), F.col("l_linenumber").alias("level"), "l_quantity", F.lit(50.0).alias("full"), (F.col("l_linestatus") == "O").alias("plain"))
    return chunks.census(rows, ["root", "level"], "l_quantity", "full", "plain", 600)


@query("a13_census", CENSUS + "select root, level, present_chunks, present_fraction, stored_bytes, compression_ratio, recoverable_bytes, basis from d")
def level_census(spark, sf_dir):
    return census(spark, sf_dir)


@query("a12_present_chunks", CENSUS + "select root, level, present_chunks, present_fraction from d")
def present_chunks(spark, sf_dir):
    return census(spark, sf_dir).select("root", "level", "present_chunks", "present_fraction")


@query("a14_compression", CENSUS + "select root, level, compression_ratio, recoverable_bytes from d")
def compression(spark, sf_dir):
    return census(spark, sf_dir).select("root", "level", "compression_ratio", "recoverable_bytes")


@query("a15_census_totals", CENSUS + "select root, count(*) levels, cast(sum(present_chunks) as bigint) present_chunks, cast(sum(stored_bytes) as bigint) stored_bytes, cast(sum(recoverable_bytes) as bigint) recoverable_bytes, array_to_string(list_sort(list(distinct basis)), '+') basis from d group by rollup (root)")
def census_totals(spark, sf_dir):
    return chunks.census_totals(census(spark, sf_dir), "root")


@query("f14_level_selection", CENSUS + "select root, level, stored_bytes from d where level <> 1")
def level_selection(spark, sf_dir):
    return census(spark, sf_dir).filter("level <> 1").select("root", "level", "stored_bytes")


# ------------------------------------------------------------------ surfaces
POINTS = """with e as (select vec_id, label, i - 1 pos, round(cast(embedding[i] as double) * 100, 3) v from embeddings, lateral (select unnest(range(1, 65)) i)),
g as (select vec_id, pos // 3 as row, max(v) filter (pos % 3 = 0) x, max(v) filter (pos % 3 = 1) y, max(v) filter (pos % 3 = 2) z from e group by 1, 2),
pt as (select vec_id, row, case when (vec_id + row) % 17 = 0 or vec_id % 50 = 0 then -1.0 else x end x, case when vec_id % 50 = 0 then -1.0 else y end y,
  case when vec_id % 50 = 0 then -1.0 when (vec_id + row) % 23 = 0 then 'nan'::double else z end z from g where x is not null and y is not null and z is not null),
mk as (select *, x = -1 or y = -1 or z = -1 marked, x = -1 and y = -1 and z = -1 allm, not isnan(z) finite from pt),
m as (select *, marked and not allm partial, not marked and finite valid from mk) """


def points(spark, sf_dir):
    """Vectors as grids: every third value is one channel; incomplete cells don't join."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    rows = rows.select("vec_id", F.floor(F.col("pos") / 3).alias("row"), (F.col("pos") % 3).alias("axis"), F.round(F.col("v").cast("double") * 100, 3).alias("v"))
    pick = lambda i, name: F.max(F.when(F.col("axis") == i, F.col("v"))).alias(name)
    cells = rows.groupBy("vec_id", "row").agg(pick(0, "x"), pick(1, "y"), pick(2, "z")).dropna()
    hole = F.col("vec_id") % 50 == 0
    place = F.col("vec_id") + F.col("row")
    return cells.select("vec_id", "row", F.when(hole | (place % 17 == 0), -1.0).otherwise(F.col("x")).alias("x"), F.when(hole, -1.0).otherwise(F.col("y")).alias("y"), F.when(hole, -1.0).when(place % 23 == 0, float("nan")).otherwise(F.col("z")).alias("z"))


@query("j12_channels", POINTS + "select vec_id, row, x, y, coalesce(case when isnan(z) then null else z end, -999) z from pt")
def channels(spark, sf_dir):
    return points(spark, sf_dir).withColumn("z", F.when(F.isnan("z"), F.lit(-999.0)).otherwise(F.col("z")))


@query("f18_valid_cells", POINTS + "select vec_id, row, valid, partial from m")
def valid_cells(spark, sf_dir):
    return surfaces.masked(points(spark, sf_dir)).select("vec_id", "row", "valid", "partial")


STATS = POINTS + """, st as (select vec_id, count(*) n, count(*) filter (valid) n_valid, round_even(count(*) filter (valid) / count(*), 6) valid_fraction, count(*) filter (partial) n_partial, count(*) filter (not finite) n_nonfinite,
    count(*) filter (valid and (x < 0 or y < 0 or z < 0)) n_negative, min(x) filter (valid) min_x, max(x) filter (valid) max_x, min(y) filter (valid) min_y, max(y) filter (valid) max_y, min(z) filter (valid) min_z, max(z) filter (valid) max_z,
    count(*) filter (valid and (x < -20.01 or x > 20.01 or y < -20.01 or y > 20.01 or z < -20.01 or z > 20.01)) n_outside, count(*) filter (valid and (z >= 30 or y >= 25 or x >= 20)) n_overrun from m group by 1) """


@query("a16_surface", STATS + "select vec_id, n, n_valid, valid_fraction, n_partial, n_nonfinite, n_negative from st")
def surface(spark, sf_dir):
    return surfaces.statistics(points(spark, sf_dir), "vec_id").select("vec_id", "n", "n_valid", "valid_fraction", "n_partial", "n_nonfinite", "n_negative")


@query("a17_extent", STATS + "select vec_id, min_x, max_x, min_y, max_y, min_z, max_z from st")
def extent(spark, sf_dir):
    return surfaces.statistics(points(spark, sf_dir), "vec_id").select("vec_id", *(f"{m}_{a}" for a in "xyz" for m in ("min", "max")))


@query("a18_outside", STATS + "select vec_id, n_outside from st")
def outside(spark, sf_dir):
    return surfaces.outside(points(spark, sf_dir), "vec_id", -20, 20)


# ------------------------------------------------------------------ voxels and depths
@query("a19_support", "select z, count(*) filter (p) positives, count(*) filter (p and not c) phantom, round(case when count(*) filter (p) > 0 then count(*) filter (p and not c) / count(*) filter (p) end, 6) phantom_fraction from (select month(l_shipdate) z, l_quantity > 25 p, l_discount > 0 c from lineitem) group by rollup (z)")
def support(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.month("l_shipdate").alias("z"), "l_quantity", "l_discount")
    return voxels.support(rows, "z", F.col("l_quantity") > 25, F.col("l_discount") > 0)


@query("j13_voxel_join", "select a.vec_id, count(*) n, count(*) filter (a.v > 0.1) positives, count(*) filter (a.v > 0.1 and b.v <= 0) phantom from (select vec_id, unnest(range(64)) i, unnest(embedding) v from embeddings) a join (select vec_id, unnest(range(64)) i, unnest(embedding) v from embeddings) b on a.i = b.i and b.vec_id = a.vec_id + 1 group by 1")
def voxel_join(spark, sf_dir):
    """Each vector against the next one, cell by cell."""
    cells = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    other = cells.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("v").alias("w"))
    return cells.join(other, ["vec_id", "i"]).groupBy("vec_id").agg(F.count("*").alias("n"), F.count_if(F.col("v").cast("double") > F.lit(0.1)).alias("positives"), F.count_if((F.col("v").cast("double") > F.lit(0.1)) & (F.col("w") <= 0)).alias("phantom"))


DEPTHS = "with e as (select label, vec_id, unnest(range(64)) pos, round(cast(unnest(embedding) as double), 4) v from embeddings) "


def depths(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.round(F.col("v").cast("double"), 4))


@query("a20_depth_stats", DEPTHS + "select label, count(*) n, 1.0 finite_fraction, round(count(*) filter (v <> 0) / count(*), 6) nonzero_fraction, round(avg(v), 6) + 0.0 mean, round(sqrt(greatest(0, avg(v * v) - avg(v) * avg(v))), 6) std from e group by 1")
def depth_stats(spark, sf_dir):
    return voxels.depth_statistics(depths(spark, sf_dir), "label", "v").drop("p01", "p50", "p99")


@query("a21_percentiles", DEPTHS + "select label, round(quantile_cont(v, 0.01), 6) p01, round(quantile_cont(v, 0.5), 6) p50, round(quantile_cont(v, 0.99), 6) p99 from e group by 1")
def percentiles(spark, sf_dir):
    return voxels.depth_statistics(depths(spark, sf_dir), "label", "v").select("label", "p01", "p50", "p99")


@query("a22_gradient", DEPTHS + "select label, round(avg(abs(v - w)), 6) gradient_energy from (select *, lag(v) over (partition by label, vec_id order by pos) w from e) where w is not null group by 1")
def gradient(spark, sf_dir):
    return voxels.gradient(depths(spark, sf_dir), "label", "vec_id", "pos", "v")


@query("w11_neighbours", DEPTHS + "select label, vec_id, count(*) steps, round(max(abs(v - w)), 6) largest from (select *, lag(v) over (partition by label, vec_id order by pos) w from e) where w is not null group by 1, 2")
def neighbours(spark, sf_dir):
    from pyspark.sql import Window

    step = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("label", "vec_id").orderBy("pos")))
    return depths(spark, sf_dir).withColumn("step", step).filter("step is not null").groupBy("label", "vec_id").agg(F.count("*").alias("steps"), F.round(F.max("step"), 6).alias("largest"))


@query("a23_duplicates", "select sha256(text) digest, count(*) n, min(doc_id) as first from documents group by 1 having count(*) > 1")
def duplicates(spark, sf_dir):
    return voxels.duplicates(read(spark, sf_dir, "documents"), "doc_id", F.sha2("text", 256))


@query("a24_peak", "with q as (select l_linenumber d, cast(sum(l_quantity) as bigint) v from lineitem group by 1) select (select d from q order by v desc, d limit 1) peak, (select d from q order by v desc, d limit 1) - (min(d) + max(d)) / 2.0 as offset from q")
def peak(spark, sf_dir):
    stats = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("d")).agg(F.sum("l_quantity").cast("bigint").alias("v"))
    return voxels.peak(stats, "d", "v")


@query("w09_slabs", "select p_partkey, start from (select p_partkey, unnest(range(0, p_size, 12)) start from part)")
def slabs(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(sampling.slab_starts(F.col("p_size"), 4, 3).cast("array<bigint>")).alias("start"))


@query("w10_tiles", "select p_partkey, array_to_string(list_sort(list_distinct([0, cast(round_even(greatest(0, p_size - 16) / 2.0::double, 0) as bigint), greatest(0, p_size - 16)])), ',') starts, cast(greatest(0, p_size - 16) // 2 as bigint) single from part")
def tiles(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(sampling.tile_starts(F.col("p_size"), 16, 3)).cast("array<string>"), ",").alias("starts"), F.get(sampling.tile_starts(F.col("p_size"), 16, 1), F.lit(0)).alias("single"))


@query("a07_label_coverage", "select lang, count(*) declared, count(*) filter (l.doc_id is not null) present, count(*) filter (l.doc_id is null) absent from documents d left join (select distinct doc_id from labels) l using (doc_id) group by 1")
def label_coverage(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    return docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("declared"), F.count("labelled").alias("present"), F.count_if(F.col("labelled").isNull()).alias("absent"))
