"""Queries of headers, binary formats, sinks and streams; what they read is made from the tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import binary, table_functions
from ..sources import headers, loaders, new_path, sinks, store_table
from ..streaming import windows
from . import tables
from .catalogue import Catalogue
from .oracle import AUDIT, LEVELS
from .tables import read

catalogue = Catalogue()
query = catalogue.query
WITH_LEVELS = "with " + LEVELS + " "

# ------------------------------------------------------------------ headers


def header_texts(spark, sf_dir, zarr_format: int):
    """Headers of the present levels, written as JSON in the layout of a format."""
    rows = tables.levels(spark, sf_dir).filter(F.col("present") & (F.col("zarr_format") == zarr_format))
    fill = F.coalesce("fill_value", F.lit("null"))
    numbers = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ","), F.lit("]"))
    if zarr_format == 2:
        raw = F.concat(F.lit('{"zarr_format":2,"shape":'), numbers("shape"), F.lit(',"chunks":'), numbers("chunks"), F.lit(',"dtype":"'), F.col("dtype"), F.lit('","fill_value":'), fill, F.lit(',"compressor":null,"dimension_separator":"'), F.col("separator"), F.lit('"}'))
    else:
        raw = F.concat(F.lit('{"zarr_format":3,"node_type":"array","shape":'), numbers("shape"), F.lit(',"data_type":"uint8","chunk_grid":{"name":"regular","configuration":{"chunk_shape":'), numbers("chunks"), F.lit('}},"chunk_key_encoding":{"name":"default"},"fill_value":'), fill, F.lit(',"codecs":[{"name":"bytes"}]}'))
    bad = F.length("path") + F.length("root")
    return rows.select("root", "path", F.when(bad % 10 == 9, F.substring(raw, 1, 20)).otherwise(raw).alias("raw"))


HEADER = "select root, path, case when ok then array_to_string(shape, ',') end shape, case when ok then array_to_string(chunks, ',') end chunks, case when ok then {dtype} end dtype, case when ok then fill_value end fill_value, {compressor} compressor_id, {separator} as separator, case when not ok then 'AUDIT_ERROR' end code from (select *, (length(path) + length(root)) % 10 <> 9 ok from lv where present and zarr_format = {f})"


def parsed(spark, sf_dir, zarr_format):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return headers.parsed(header_texts(spark, sf_dir, zarr_format)).select("root", "path", text("shape"), text("chunks"), "dtype", "fill_value", "compressor_id", "separator", "code")


@query("s13_v2_headers", WITH_LEVELS + HEADER.format(dtype="dtype", compressor="'none'", separator="case when ok then separator else '.' end", f=2))
def v2_headers(spark, sf_dir):
    return parsed(spark, sf_dir, 2)


@query("s14_v3_headers", WITH_LEVELS + HEADER.format(dtype="'uint8'", compressor="case when ok then 'bytes' else 'none' end", separator="case when ok then '/' else '.' end", f=3))
def v3_headers(spark, sf_dir):
    return parsed(spark, sf_dir, 3)


N_SCALE = "case when declared_scale is null then 0 else len(list_filter(transforms, lambda t: t.kind = 'scale')) end"
DATASETS = WITH_LEVELS + f"select root, idx, path, case when n_scale > 0 then declared_scale[1] end scale, cast(n_scale as bigint) n_scale from (select *, {N_SCALE} n_scale from lv)"


@query("p01_datasets", DATASETS)
def datasets(spark, sf_dir):
    """Datasets of multiscales documents, written from the levels and read back."""
    scale = F.format_string("[%s]", F.array_join(F.col("declared_scale").cast("array<string>"), ","))
    one = F.concat(F.lit('{"type":"scale","scale":'), scale, F.lit("}"))
    n_scale = F.when(F.col("declared_scale").isNull(), 0).otherwise(F.size(F.filter("transforms", lambda t: t.kind == "scale")))
    transforms = F.array_join(F.array_repeat(one, n_scale), ",")
    dataset = F.concat(F.lit('{"path":"'), F.col("path"), F.lit('","coordinateTransformations":['), transforms, F.lit("]}"))
    # one document per root, in one of the two layouts
    docs = tables.levels(spark, sf_dir).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("idx", dataset.alias("d")))).alias("ds"))
    body = F.concat(F.lit('{"datasets":['), F.array_join(F.transform("ds", lambda s: s.d), ","), F.lit("]}"))
    old = F.length("root") % 2 == 0
    raw = F.when(old, F.concat(F.lit('{"multiscales":['), body, F.lit("]}"))).otherwise(F.concat(F.lit('{"ome":{"version":"0.5","multiscales":['), body, F.lit("]}}")))
    found = headers.multiscale(docs.select("root", raw.alias("raw")))
    return found.select("root", F.col("path").cast("bigint").alias("idx"), "path", F.when(F.col("n_scale") > 0, F.get("declared_scale", F.lit(0))).alias("scale"), F.col("n_scale").cast("bigint").alias("n_scale"))


query("p02_declared_scale", f"select scale, count(*) n from ({DATASETS}) group by 1")(lambda spark, sf_dir: datasets(spark, sf_dir).groupBy("scale").agg(F.count("*").alias("n")))


@query("p17_sharding", "select p_partkey, p_partkey % 3 = 0 sharded from part")
def sharding(spark, sf_dir):
    codecs = F.when(F.col("p_partkey") % 3 == 0, '[{"name":"sharding_indexed","configuration":{"chunk_shape":[128,128,128]}}]').otherwise('[{"name":"bytes"}]')
    raw = F.concat(F.lit('{"zarr_format":3,"shape":[1],"codecs":'), codecs, F.lit("}"))
    return headers.parsed(read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))).select("p_partkey", "sharded")


# ------------------------------------------------------------------ bytes
def indexes(spark, sf_dir):
    """A shard index per part: p_size pairs of little-endian offsets and lengths, the checksum behind."""

    @pandas_udf("binary")
    def build(key: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for k, m in zip(key, n):
            pairs = np.stack([np.arange(m, dtype="<u8") * 100 + k % 100, np.full(m, 100, "<u8")], axis=1)
            pairs[k % m] = binary.MISSING
            out.append(pairs.tobytes())
        sums = binary.crc32c_of(out).tolist()
        return pd.Series([raw + (crc ^ (k % 10 == 0)).to_bytes(4, "little") for raw, crc, k in zip(out, sums, key)])

    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism)
    return parts.select("p_partkey", "p_size", build("p_partkey", "p_size").alias("raw"))


@query("c32_unpack_index", "select p_partkey, p_size entries, 1 missing, cast(p_size * (p_size - 1) // 2 * 100 + p_size * (p_partkey % 100) - ((p_partkey % p_size) * 100 + p_partkey % 100) as bigint) offsets from part")
def unpack_index(spark, sf_dir):
    rows = indexes(spark, sf_dir).withColumn("e", binary.unpack_index("raw", "p_size", F.lit(True)))
    gone = F.filter("e", lambda x: x.off == -1)
    total = F.aggregate(F.filter("e", lambda x: x.off >= 0), F.lit(0).cast("bigint"), lambda a, x: a + x.off)
    return rows.select("p_partkey", F.size("e").cast("bigint").alias("entries"), F.size(gone).cast("bigint").alias("missing"), total.alias("offsets"))


query("s16_shard_index", "select p_partkey, p_size - 1 present from part")(lambda spark, sf_dir: indexes(spark, sf_dir).withColumn("e", binary.unpack_index("raw", "p_size", F.lit(True))).select("p_partkey", F.size(F.filter("e", lambda x: x.off >= 0)).cast("bigint").alias("present")))


@query("c31_index_checksum", "select p_partkey, case when p_partkey % 7 = 0 then null else p_partkey % 10 <> 0 end ok from part")
def index_checksum(spark, sf_dir):
    return indexes(spark, sf_dir).select("p_partkey", binary.index_checksum_ok("raw", F.col("p_partkey") % 7 != 0).alias("ok"))


@query("j19_reread", "select p_partkey, case when p_partkey % 10 = 0 then 'MISMATCH' else 'VERIFIED' end verdict from part")
def reread(spark, sf_dir):
    """Indexes whose checksum fails are read again from where they are stored before they are blamed."""
    objects = store_table(indexes(spark, sf_dir).select("p_partkey", "raw"))
    first = store_table(objects.select("p_partkey", binary.index_checksum_ok("raw", F.lit(True)).alias("ok")))
    again = objects.join(first.filter("not ok").select("p_partkey"), "p_partkey", "left_semi").select("p_partkey", binary.index_checksum_ok("raw", F.lit(True)).alias("again"))
    verdict = F.when(F.col("ok"), "VERIFIED").when(F.col("again"), "VERIFIED_ON_REREAD").otherwise("MISMATCH")
    return first.join(again, "p_partkey", "left").select("p_partkey", verdict.alias("verdict"))


@query("c30_crc32c")
def crc32c(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", binary.crc32c(F.col("text").cast("binary")).alias("crc32c"))


def tiffs(spark, sf_dir):
    """A small TIFF per part."""

    @pandas_udf("binary")
    def build(key: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binary.build_tiff(np.full((3, m), k, np.float32)) if k % 13 else b"no image" for k, m in zip(key, n)])

    return read(spark, sf_dir, "part").select("p_partkey", "p_size", build("p_partkey", "p_size").alias("raw"))


@query("s17_tiff_headers", "select p_partkey, case when p_partkey % 13 <> 0 then p_size end width, case when p_partkey % 13 <> 0 then 3 end height, case when p_partkey % 13 <> 0 then 32 end bits from part")
def tiff_headers(spark, sf_dir):
    big = lambda c: F.col(f"h.{c}").cast("bigint").alias(c)
    return tiffs(spark, sf_dir).withColumn("h", binary.parse_tiff("raw")).select("p_partkey", big("width"), big("height"), big("bits"))


@query("s18_tiff_content", "select p_partkey, p_size * 3 n, cast(p_size * 3 * p_partkey as double) total from part where p_partkey % 13 <> 0")
def tiff_content(spark, sf_dir):
    @pandas_udf("struct<n: bigint, total: double>")
    def sums(raw: pd.Series) -> pd.DataFrame:
        grids = [binary.tiff_grid(r, h) if (h := binary.tiff_header(r)) else None for r in raw]
        return pd.DataFrame({"n": pd.array([None if g is None else g.size for g in grids], dtype="Int64"), "total": [None if g is None else float(g.sum(dtype=np.float64)) for g in grids]})

    return tiffs(spark, sf_dir).withColumn("s", sums("raw")).filter("s.n is not null").select("p_partkey", "s.n", "s.total")


STATUSES = "case when p_partkey % 5 = 4 then 'undecodable' when p_partkey % 3 = 0 then 'empty' else 'populated' end"


@query("c35_fill_test", f"select p_partkey, {STATUSES} status from part")
def fill_test(spark, sf_dir):
    """Chunks of one value: decoded and compared with the fill value."""
    k = F.col("p_partkey")
    raw = F.unhex(F.repeat(F.when(k % 3 == 0, "00").otherwise("07"), F.col("p_size") * 4))
    codec = F.when(k % 5 == 4, "blosc").otherwise("none")
    return read(spark, sf_dir, "part").select("p_partkey", binary.decoded_status(raw, F.lit("<f4"), codec, F.lit("0")).alias("status"))


query("c33_codecs", f"select {STATUSES} status, count(*) n from part group by 1")(lambda spark, sf_dir: fill_test(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")))


# ------------------------------------------------------------------ sinks and loaders
def all_findings(spark, sf_dir):
    from .queries_audit import findings

    return findings(spark, sf_dir).select("code", "severity", "root", "level")


ALL_FINDINGS = AUDIT + "select code, severity, root, level from findings"


@query("s24_jsonl", ALL_FINDINGS)
def jsonl(spark, sf_dir):
    return sinks.stored_jsonl(all_findings(spark, sf_dir))


@query("s25_csv", ALL_FINDINGS)
def csv(spark, sf_dir):
    path = new_path(spark, "csv")
    sinks.write_csv(all_findings(spark, sf_dir), path)
    return sinks.read_csv(spark, path, ["code", "severity", "root", "level"])


query("s23_findings_csv", AUDIT + "select root, code, count(*) n from findings group by 1, 2")(lambda spark, sf_dir: csv(spark, sf_dir).groupBy("root", "code").agg(F.count("*").alias("n")))


ROOT_LINES = "with l as (select *, row_number() over (order by copy, o_orderkey) line from (select o_orderkey, copy from orders, (select unnest([0, 1]) copy))) "


def root_lines(spark, sf_dir):
    """A list of roots, written twice over in the order of keys; every third line is cut off."""
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, '{"root": ').otherwise(F.concat(F.lit('{"root":"root/'), k.cast("string"), F.lit('"}')))
    rows = read(spark, sf_dir, "orders").select(k, line.alias("value"))
    rows = rows.withColumn("copy", F.lit(0)).unionAll(rows.withColumn("copy", F.lit(1)))
    path = new_path(spark, "roots")
    rows.orderBy("copy", "o_orderkey").select("value").write.text(path)
    lines = loaders.numbered_lines(spark, path)
    # as if the files were one: their lines go on counting
    sizes = lines.groupBy("file").agg(F.max("line").alias("n"))
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # a row for each file
    return lines.join(F.broadcast(before), "file").select("file", (F.col("line") + F.col("before")).alias("line"), "value")


@query("s21_roots_jsonl", ROOT_LINES + "select 'root/' || o_orderkey root, min(line) line from l where o_orderkey % 3 <> 0 group by 1")
def roots_jsonl(spark, sf_dir):
    """Root lists as JSON lines: bad lines are left out, and of repeated roots the first line counts."""
    return loaders.roots(root_lines(spark, sf_dir))[0].select("root", "line")


@query("s21_line_counts", ROOT_LINES + "select count(*) as lines, count(*) filter (o_orderkey % 3 = 0) bad, count(distinct o_orderkey) filter (o_orderkey % 3 <> 0) roots, count(*) filter (o_orderkey % 3 <> 0) - count(distinct o_orderkey) filter (o_orderkey % 3 <> 0) repeated from l")
def line_counts(spark, sf_dir):
    return loaders.roots(root_lines(spark, sf_dir))[1]


@query("s22_levels_jsonl", WITH_LEVELS + "select root, path as level, len(shape) ndim from lv where present")
def levels_jsonl(spark, sf_dir):
    """Levels of a scan read back: all present ones."""
    rows = tables.levels(spark, sf_dir).select("root", F.col("path").alias("level"), F.col("idx").alias("index"), "present", "shape", "chunks", F.col("compressor_id").alias("compressor"))
    path = new_path(spark, "levels")
    sinks.write_jsonl(rows, path)
    found = loaders.levels(loaders.numbered_lines(spark, path))
    return found.select("root", "level", F.size("shape").cast("bigint").alias("ndim"))


@query("s28_manifest", ALL_FINDINGS.replace("select code, severity, root, level from findings", "select 'findings' output, count(*) as rows, count(*) filter (severity = 'high') high, count(distinct code) codes, true ok from findings"))
def manifest(spark, sf_dir):
    """The manifest of a run that writes all findings; its counters are observed by the job that writes."""
    folder = new_path(spark, "run")
    with sinks.Run(spark, folder, "audit", [sf_dir]) as run:
        known = F.size(F.collect_set("code"))
        run.write(all_findings(spark, sf_dir), "findings", "jsonl", {"high": F.count_if(F.col("severity") == "high"), "codes": known})
    rows = sinks.read_manifest(spark, run.manifest)
    return rows.select("counters", "ok", F.explode("outputs").alias("output", "o")).select("output", F.col("o.rows").alias("rows"), F.col("counters")["high"].alias("high"), F.col("counters")["codes"].alias("codes"), "ok")


@query("f19_limit", ROOT_LINES + "select 'root/' || o_orderkey root, min(line) line from l where o_orderkey % 3 <> 0 group by 1 order by line limit 40")
def limited(spark, sf_dir):
    """The first roots of a list, in its order."""
    return loaders.roots(root_lines(spark, sf_dir))[0].orderBy("file", "line").limit(40).select("root", "line")


# ------------------------------------------------------------------ table functions
@query("u01_array_headers", WITH_LEVELS + "select root, path, case when ok then array_to_string(shape, ',') end shape, case when ok then array_to_string(chunks, ',') end chunks, case when ok then case dtype when '|u1' then 'uint8' when '<u2' then 'uint16' else 'float32' end end dtype, case when ok then fill_value end fill_value, case when ok then separator end as separator, not ok broken from (select *, (length(path) + length(root)) % 10 <> 9 ok from lv where present and zarr_format = 2)")
def header_rows(spark, sf_dir):
    """Headers in a table, read by a table function in SQL."""
    table_functions.register(spark)
    return spark.sql("select r.root, r.path, array_join(h.shape, ',') shape, array_join(h.chunks, ',') chunks, h.dtype, h.fill_value, h.separator, h.error is not null broken from {rows} r, lateral array_header(r.raw) h", rows=header_texts(spark, sf_dir, 2))


@query("u02_shard_entries", "select p_partkey, cast(p_size as bigint) entries, 1 missing, cast(100 * (p_size - 1) as bigint) bytes, p_partkey % 10 <> 0 ok from part")
def shard_entries(spark, sf_dir):
    table_functions.register(spark)
    return spark.sql("select r.p_partkey, count(*) entries, cast(count_if(t.offset is null) as int) missing, coalesce(sum(t.length), 0) bytes, bool_and(t.checksum_ok) ok from {rows} r, lateral shard_index(r.raw, r.p_size, true) t group by 1", rows=indexes(spark, sf_dir))


@query("u03_tiff_directories", "select p_partkey, case when p_partkey % 13 <> 0 then p_size end width, case when p_partkey % 13 <> 0 then 3 end height, case when p_partkey % 13 <> 0 then 1 end strips, p_partkey % 13 = 0 broken from part")
def tiff_directories(spark, sf_dir):
    table_functions.register(spark)
    return spark.sql("select r.p_partkey, t.width, t.height, t.strips, t.error is not null broken from {rows} r, lateral tiff_directory(r.raw) t", rows=tiffs(spark, sf_dir))


# ------------------------------------------------------------------ streams (ours; the surveyed system has none)
@query("st01_windowed_counts", "select date_trunc('hour', ts) window_start, event_type, count(*) n from events group by 1, 2")
def windowed_counts(spark, sf_dir):
    return windows.hourly_counts(spark, sf_dir)


@query("st02_last_findings", "select user_id root, event_type code, max(event_id) last_event from events group by 1, 2")
def last_findings(spark, sf_dir):
    return windows.latest_by_key(spark, sf_dir)
