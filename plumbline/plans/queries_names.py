"""Queries of scalar functions and name predicates, over pages, events, parts and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from .. import schema
from .catalogue import Catalogue
from .tables import read

catalogue = Catalogue()
query = catalogue.query

HREFS = "with h as (select page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"?][^\"]*)\"', 1)) href from pages), d as (select page_id, href, url_decode(replace(href, '+', '%2B')) as name, case when regexp_matches(href, '^([a-zA-Z][a-zA-Z0-9+.-]*:|/|#|\\.\\.)') or contains(href, '#') or contains(href, '?') then null when ends_with(href, '/') then 'dir' else 'file' end kind from h) "


def links(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.explode(fn.hrefs("html")).alias("href"))
    return rows.select("page_id", "href", fn.unquoted("href").alias("name"), fn.listed_kind(F.col("href")).alias("kind"))


@query("s10_autoindex", HREFS + "select page_id, count(*) links, count(kind) listed, count(*) filter (kind = 'dir') dirs from d group by 1")
def autoindex(spark, sf_dir):
    return links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("links"), F.count("kind").alias("listed"), F.count_if(F.col("kind") == "dir").alias("dirs"))


@query("c03_hrefs", HREFS + "select page_id, href, count(*) n from d group by 1, 2")
def href_counts(spark, sf_dir):
    return links(spark, sf_dir).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("c04_unquote", "select doc_id, md5(url_decode(replace(q, '+', '%2B'))) decoded from (select doc_id, replace(replace(text, '%', '%25'), ' ', '%20') q from documents)")
def unquote(spark, sf_dir):
    """Percent escapes of made-up paths; a plus stays a plus."""
    quoted = F.replace(F.replace("text", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(fn.unquoted(quoted).cast("binary")).alias("decoded"))


@query("c02_paths", "select page_id, string_split(p, '/')[-1] base, len(string_split(p, '/')) depth from (select page_id, rtrim(split_part(split_part(url, '#', 1), '?', 1), '/') p from pages)")
def paths(spark, sf_dir):
    path = F.rtrim(F.substring_index(F.substring_index("url", "#", 1), "?", 1), F.lit("/"))
    return read(spark, sf_dir, "pages").select("page_id", fn.base_name(path).alias("base"), F.size(F.split(path, "/")).cast("bigint").alias("depth"))


@query("c01_string_predicates", "select count(*) filter (starts_with(s_name, 'Supplier')) a, count(*) filter (ends_with(s_name, '7')) b, count(*) filter (contains(lower(s_name), 'r#')) c, count(*) filter (trim(s_name) = s_name) d from supplier")
def string_predicates(spark, sf_dir):
    name = F.col("s_name")
    return read(spark, sf_dir, "supplier").agg(F.count_if(name.startswith("Supplier")).alias("a"), F.count_if(name.endswith("7")).alias("b"), F.count_if(F.lower(name).contains("r#")).alias("c"), F.count_if(F.trim(name) == name).alias("d"))


#: Made-up names of directories, by part.
NAMED = """with n as (select p_partkey k, case p_partkey % 9 when 0 then 'Vol_' || p_partkey || '.ZARR' when 1 then p_partkey || '_' || p_size when 2 then lpad('' || p_partkey, 9, '2') || '_run' when 3 then '.git' when 4 then 's' || p_partkey || '.tifxyz' when 5 then p_partkey || '.' || p_size || '.0'
  when 6 then '.zarray' when 7 then '' || p_size else p_name end as name from part) """


def named(spark, sf_dir):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    kinds = [F.concat(F.lit("Vol_"), k, F.lit(".ZARR")), F.concat_ws("_", k, size), F.concat(F.lpad(k, 9, "2"), F.lit("_run")), F.lit(".git"), F.concat(F.lit("s"), k, F.lit(".tifxyz")), F.concat_ws(".", k, size, F.lit("0")), F.lit(".zarray"), size]
    name = F.col("p_name")
    for i, v in enumerate(kinds):
        name = F.when(F.col("p_partkey") % 9 == i, v).otherwise(name)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), name.alias("name"))


PREDICATES = {
    "f01_zarr_name": ("lower(name) like '%.zarr'", lambda: fn.is_zarr_name("name")),
    "f02_coordinate_name": ("regexp_full_match(name, '[0-9]+(_[0-9]+)*')", lambda: fn.is_coordinate_name("name")),
    "f03_timestamp_name": ("regexp_matches(name, '^[0-9]{8,}')", lambda: fn.is_timestamp_name("name")),
    "f04_skipped_name": ("name in ('__pycache__', '.git', '.ipynb_checkpoints', 'node_modules')", lambda: F.col("name").isin("__pycache__", ".git", ".ipynb_checkpoints", "node_modules")),
    "f05_leaf_format": ("ends_with(name, '.tifxyz')", lambda: F.col("name").endswith(".tifxyz")),
    "f08_chunk_key": ("regexp_full_match(name, '[0-9]+(\\.[0-9]+)*')", lambda: fn.is_chunk_key("name")),
    "f09_metadata_name": ("name not in ('.zarray', '.zattrs', '.zgroup', '.zmetadata', 'zarr.json')", lambda: ~F.col("name").isin(".zarray", ".zattrs", ".zgroup", ".zmetadata", "zarr.json")),
    "f13_root_filter": ("contains(name, '1') or contains(name, 'widget')", lambda: F.exists(F.array(F.lit("1"), F.lit("widget")), lambda f: F.col("name").contains(f))),
    "f21_text_query": ("contains(lower(name), 'vol')", lambda: F.lower("name").contains("vol")),
}
for _id, (_sql, _test) in PREDICATES.items():
    query(_id, NAMED + f"select k, name from n where {_sql}")(lambda spark, sf_dir, test=_test: named(spark, sf_dir).filter(test()))


@query("f06_three_channels", "select l_orderkey, list_has_all(list(l_returnflag), ['A', 'N', 'R']) complete from lineitem group by 1")
def three_channels(spark, sf_dir):
    wanted = F.array(*(F.lit(x) for x in "ANR"))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.size(F.array_intersect(F.collect_set("l_returnflag"), wanted)) == 3).alias("complete"))


@query("f15_finding_codes", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag in ('A', 'R') and l_discount = 0)")
def finding_codes(spark, sf_dir):
    found = read(spark, sf_dir, "lineitem").filter("l_returnflag in ('A', 'R') and l_discount = 0").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(found, "o_orderkey", "left_semi")


# ------------------------------------------------------------------ ranges and errors
RANGES = """with r as (select l_orderkey, l_linenumber, pk % 100 as start, 1 + sk % 50 as length, case when pk % 7 = 0 then 'items ' when pk % 5 = 0 then 'Bytes ' else 'bytes ' end || (pk % 100 + case when pk % 11 = 0 then 1 else 0 end) || '-' || (pk % 100 + sk % 50) || '/' || case when sk % 3 = 0 then '*' else '' || (pk % 100 + sk % 50 + sk % 4) end header, sk % 13 missing from ln),
p as (select *, regexp_extract(header, '(?i)^\\s*bytes (\\d+)-(\\d+)/(\\d+|\\*)\\s*$', 1) a, regexp_extract(header, '(?i)^\\s*bytes (\\d+)-(\\d+)/(\\d+|\\*)\\s*$', 2) b, regexp_extract(header, '(?i)^\\s*bytes (\\d+)-(\\d+)/(\\d+|\\*)\\s*$', 3) t from r) """


def ranges(spark, sf_dir):
    from .tables import lines

    pk, sk = F.col("pk"), F.col("sk")
    first, last = pk % 100, pk % 100 + sk % 50
    header = F.concat(F.when(pk % 7 == 0, "items ").when(pk % 5 == 0, "Bytes ").otherwise("bytes "), first + F.when(pk % 11 == 0, 1).otherwise(0), F.lit("-"), last, F.lit("/"), F.when(sk % 3 == 0, "*").otherwise((last + sk % 4).cast("string")))
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", first.alias("start"), (1 + sk % 50).alias("length"), header.alias("header"), (sk % 13).alias("missing"))


def _with_lines(sql: str) -> str:
    from .oracle import LINES

    return "with " + LINES + ", " + sql.removeprefix("with ")


@query("c05_content_range", _with_lines(RANGES) + "select l_orderkey, l_linenumber, cast(nullif(a, '') as bigint) as first, cast(nullif(b, '') as bigint) as last, cast(nullif(nullif(t, ''), '*') as bigint) total from p")
def content_range(spark, sf_dir):
    return ranges(spark, sf_dir).withColumn("r", fn.content_range("header")).select("l_orderkey", "l_linenumber", "r.first", "r.last", "r.total")


@query("s07_strict_range", _with_lines(RANGES) + """select l_orderkey, l_linenumber, case when a = '' or cast(a as bigint) <> start or cast(b as bigint) <> start + length - 1 or (t <> '*' and cast(t as bigint) <= cast(b as bigint)) then 'invalid Content-Range'
    when missing = 0 then 'short ranged GET' else 'ok' end outcome from p""")
def strict_range(spark, sf_dir):
    """A partial response must name exactly the range that was asked for, and be whole."""
    rows = ranges(spark, sf_dir).withColumn("r", fn.content_range("header"))
    bad = F.col("r").isNull() | (F.col("r.first") != F.col("start")) | (F.col("r.last") != F.col("start") + F.col("length") - 1) | F.coalesce(F.col("r.total") <= F.col("r.last"), F.lit(False))
    return rows.select("l_orderkey", "l_linenumber", F.when(bad, "invalid Content-Range").when(F.col("missing") == 0, "short ranged GET").otherwise("ok").alias("outcome"))


@query("s08_strict_suffix", _with_lines(RANGES) + "select l_orderkey, l_linenumber, case when a = '' or t = '*' or cast(b as bigint) <> cast(t as bigint) - 1 or cast(a as bigint) <> cast(t as bigint) - length then 'invalid Content-Range' when missing = 0 then 'short suffix GET' else 'ok' end outcome from p")
def strict_suffix(spark, sf_dir):
    """A tail must come with a known total and end there."""
    rows = ranges(spark, sf_dir).withColumn("r", fn.content_range("header"))
    bad = F.col("r").isNull() | F.col("r.total").isNull() | (F.col("r.last") != F.col("r.total") - 1) | (F.col("r.first") != F.col("r.total") - F.col("length"))
    return rows.select("l_orderkey", "l_linenumber", F.when(bad, "invalid Content-Range").when(F.col("missing") == 0, "short suffix GET").otherwise("ok").alias("outcome"))


ERRORS = ["HTTP 404 Not Found", "HTTP 401", "HTTP 403 Forbidden", "HTTP 405", "HTTP 408", "HTTP 429 Too Many", "HTTP 503", "read timed out", "connection reset", "odd failure"]


@query("c06_error_evidence", "select event_id, ['ABSENT', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN'][1 + event_id % 10] state, ['NOT_FOUND', 'UNAUTHORIZED', 'FORBIDDEN', 'LISTING_UNSUPPORTED', 'TIMEOUT', 'RATE_LIMITED', 'SERVER_ERROR', 'TIMEOUT', 'CONNECTION_ERROR', 'TRANSPORT_ERROR'][1 + event_id % 10] reason from events")
def error_evidence(spark, sf_dir):
    text = F.get(F.array(*(F.lit(e) for e in ERRORS)), (F.col("event_id") % 10).cast("int"))
    return read(spark, sf_dir, "events").withColumn("e", fn.evidence_of_error(text, listing=True)).select("event_id", "e.state", "e.reason")


@query("c22_json_evidence", "select event_id, case when event_id % 9 = 0 then 'ABSENT' else 'PRESENT' end state, case when event_id % 9 <> 0 and event_id % 7 = 0 then 'METADATA_UNREADABLE' end reason from events")
def json_evidence(spark, sf_dir):
    """Missing, malformed and readable documents are three things."""
    raw = F.when(F.col("event_id") % 9 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").withColumn("e", fn.json_evidence(raw)).select("event_id", "e.state", "e.reason")


query("s09_json_evidence", "select case when event_id % 9 = 0 then 'ABSENT' else 'PRESENT' end state, case when event_id % 9 <> 0 and event_id % 7 = 0 then 'METADATA_UNREADABLE' end reason, count(*) n from events group by 1, 2")(lambda spark, sf_dir: json_evidence(spark, sf_dir).groupBy("state", "reason").agg(F.count("*").alias("n")))


@query("c07_gap_details", "select event_id, ['x', 'y', 'z'][1 + event_id % 3] || '.tif' channel, cast(floor(value * 1000) as bigint) bytes from events where event_type = 'error'")
def gap_details(spark, sf_dir):
    """Channel and size out of a finding's text; a text of another form stops the run."""
    detail = F.concat(F.get(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("event_id") % 3).cast("int")), F.lit(".tif is "), F.floor(F.col("value") * 1000).cast("string"), F.lit(" bytes, above --max-content-bytes"))
    pattern = r"^([xyz]\.tif) is (\d+) bytes, above --max-content-bytes$"
    rows = read(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", detail.alias("d"))
    return rows.select("event_id", F.when(F.col("d").rlike(pattern), F.regexp_extract("d", pattern, 1)).otherwise(F.raise_error(F.lit("unknown detail"))).alias("channel"), F.regexp_extract("d", pattern, 2).cast("bigint").alias("bytes"))


query("l07_gap_order", "select ['x', 'y', 'z'][1 + event_id % 3] || '.tif' channel, count(*) n from events where event_type = 'error' group by 1")(lambda spark, sf_dir: gap_details(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n")).orderBy("channel"))


@query("c08_annotations", "select doc_id, length(a) chars, length(a) - length(replace(a, '%0A', '%0')) breaks from (select doc_id, '::warning::' || replace(text, chr(10), '%0A') a from documents)")
def annotations(spark, sf_dir):
    a = F.concat(F.lit("::warning::"), F.replace("text", F.lit("\n"), F.lit("%0A")))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(a).cast("bigint").alias("chars"), (F.length(a) - F.length(F.replace(a, F.lit("%0A"), F.lit("%0")))).cast("bigint").alias("breaks"))


@query("c09_human_bytes", "select l_suppkey, case when b < 1024 then printf('%.0f B', b) when b < 1048576 then printf('%.1f KiB', b / 1024) when b < 1073741824 then printf('%.1f MiB', b / 1048576) else printf('%.1f GiB', b / 1073741824) end size from (select l_suppkey, cast(sum(l_quantity) as bigint)::double * case l_suppkey % 3 when 0 then 1 when 1 then 64 else 4096 end b from lineitem group by 1)")
def human_bytes(spark, sf_dir):
    b = F.sum("l_quantity") * F.when(F.col("l_suppkey") % 3 == 0, 1).when(F.col("l_suppkey") % 3 == 1, 64).otherwise(4096)
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("b")).select("l_suppkey", fn.human_bytes(F.col("b") * F.when(F.col("l_suppkey") % 3 == 0, 1).when(F.col("l_suppkey") % 3 == 1, 64).otherwise(4096)).alias("size"))


# ------------------------------------------------------------------ numbers
@query("c11_grid_extents", "select p_partkey, greatest(1, cast(ceil(p_size / 4) as bigint)) up, greatest(1, cast(floor(p_size / 4) as bigint)) down from part")
def grid_extents(spark, sf_dir):
    up, down = (fn.expected_extent(F.col("p_size"), F.lit(4.0), m) for m in ("ceil", "floor"))
    return read(spark, sf_dir, "part").select("p_partkey", up.alias("up"), down.alias("down"))


@query("c12_ratio", "select p_partkey, round(case when p_size % 5 <> 0 then p_retailprice / (p_size % 5) end, 6) ratio from part")
def ratio(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.round(fn.ratio("p_retailprice", F.col("p_size") % 5), 6).alias("ratio"))


@query("c13_is_close", "select l_orderkey, count(*) filter (abs(l_quantity - 25) <= greatest(0.1 * greatest(abs(l_quantity), 25), 0.5)) n from lineitem group by 1")
def is_close(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(fn.is_close("l_quantity", F.lit(25.0), 0.1, 0.5)).alias("n"))


@query("c14_is_finite", "select event_id, isfinite(value) and event_id % 4 <> 0 finite from events")
def is_finite(spark, sf_dir):
    v = F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 8 == 0, float("nan")).otherwise(float("-inf"))).otherwise(F.col("value"))
    return read(spark, sf_dir, "events").select("event_id", fn.is_finite(v).alias("finite"))


@query("c15_rounding", "select p_partkey, cast(round_even(p_size / 4.0::double, 0) as bigint) half_even, cast(trunc(p_retailprice) as bigint) truncated, cast(p_size as bigint) * 7 * 11 product from part")
def rounding(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.rint(F.col("p_size") / 4.0).cast("bigint").alias("half_even"), F.col("p_retailprice").cast("bigint").alias("truncated"), fn.product(F.array(F.col("p_size").cast("bigint"), F.lit(7).cast("bigint"), F.lit(11).cast("bigint"))).cast("bigint").alias("product"))


@query("c16_unravel", "select p_partkey, (p_partkey // 35) || ',' || ((p_partkey // 7) % 5) || ',' || (p_partkey % 7) idx, p_partkey flat from part")
def unravel(spark, sf_dir):
    at = fn.unravel(F.col("p_partkey"), [F.lit(10**9), F.lit(5), F.lit(7)])
    rows = read(spark, sf_dir, "part").select("p_partkey", at.alias("i"))
    return rows.select("p_partkey", F.array_join(F.col("i").cast("array<string>"), ",").alias("idx"), fn.ravel([F.get("i", F.lit(k)) for k in range(3)], [F.lit(10**9), F.lit(5), F.lit(7)]).alias("flat"))


UNIT_NAMES = ("nanometer", "micrometer", "millimeter", "centimeter", "meter", "furlong")
UNIT_SQL = "case p_size % 6 when 0 then 'nanometer' when 1 then 'micrometer' when 2 then 'millimeter' when 3 then 'centimeter' when 4 then 'meter' else 'furlong' end"


@query("j17_unit_fence", f"""with u as (select p_partkey, {UNIT_SQL} unit, p_size % 4 + 1 as value from part),
    f as (select *, case unit when 'nanometer' then 0.001 when 'micrometer' then 1.0 when 'millimeter' then 1000.0 when 'meter' then 1000000.0 end factor from u)
    select p_partkey, round(value * factor, 6) um, case when factor is null then 'GATE_VOXEL_SIZE_UNKNOWN' when abs(value * factor - 2) > 0.5 then 'GATE_VOXEL_SIZE_MISMATCH' else 'OK' end code from f""")
def unit_fence(spark, sf_dir):
    """Declared voxel sizes in micrometres against an expected one; an unknown unit fails closed."""
    units = spark.createDataFrame([(k, v) for k, v in schema.UNITS.items()], "unit string, factor double")
    names = F.array(*(F.lit(u) for u in UNIT_NAMES))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.get(names, F.col("p_size") % 6).alias("unit"), (F.col("p_size") % 4 + 1).alias("value"))
    um = F.col("value") * F.col("factor")
    code = F.when(um.isNull(), "GATE_VOXEL_SIZE_UNKNOWN").when(F.abs(um - 2) > 0.5, "GATE_VOXEL_SIZE_MISMATCH").otherwise("OK")
    return rows.join(F.broadcast(units), "unit", "left").select("p_partkey", F.round(um, 6).alias("um"), code.alias("code"))  # some thirty names


query("c17_units", f"select {UNIT_SQL} unit, count(*) n from part group by 1")(lambda spark, sf_dir: read(spark, sf_dir, "part").select(F.get(F.array(*(F.lit(u) for u in UNIT_NAMES)), F.col("p_size") % 6).alias("unit")).groupBy("unit").agg(F.count("*").alias("n")))


# ------------------------------------------------------------------ dates, json, arrays, hashes
@query("c20_http_dates", "select o_orderkey, cast(epoch(o_orderdate) as bigint) epoch_s from orders")
def http_dates(spark, sf_dir):
    text = F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    parsed = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(parsed).alias("epoch_s"))


@query("c21_latest_prefix", "select o_orderpriority, max(strftime(o_orderdate, '%Y-%m-%d')) latest from orders where o_orderkey % 3 <> 0 group by 1")
def latest_prefix(spark, sf_dir):
    """The largest date that artifact names start with."""
    name = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "draft-").otherwise(""), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-run"))
    day = F.when(name.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(name, 1, 10))
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max(day).alias("latest"))


@query("c19_run_stamp", "select strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') stamp, count(*) n from events group by 1")
def run_stamp(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp")).agg(F.count("*").alias("n"))


@query("c23_canonical_json", "select event_id, sha256('{\"id\":' || event_id || ',\"k\":' || (props->>'$.k') || ',\"type\":\"' || event_type || '\"}') digest from events")
def canonical_json(spark, sf_dir):
    """Sorted keys, no spaces, UTF-8: the digest that attests a source document."""
    doc = F.struct(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("type"))
    return read(spark, sf_dir, "events").select("event_id", F.sha2(F.to_json(doc), 256).alias("digest"))


@query("p12_attestation", "select event_id, case when event_id % 9 <> 0 then sha256('{\"k\":' || (props->>'$.k') || '}') end attestation from events")
def attestation(spark, sf_dir):
    """Null unless the document is present and readable."""
    readable = F.col("event_id") % 9 != 0
    doc = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k")))
    return read(spark, sf_dir, "events").select("event_id", F.when(readable, F.sha2(doc, 256)).alias("attestation"))


@query("c25_array_functions", "select l_orderkey, list_aggregate(list(l_quantity), 'max') top, len(list(l_quantity)) n, len(list_filter(list(l_quantity), lambda x: x > 40)) large from lineitem group by 1")
def array_functions(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return rows.select("l_orderkey", F.array_max("q").alias("top"), F.size("q").cast("bigint").alias("n"), F.size(F.filter("q", lambda x: x > 40)).cast("bigint").alias("large"))


@query("c27_rank_order", "select l_orderkey, list(l_linenumber order by l_shipdate, l_linenumber) = list_sort(list(l_linenumber)) in_order from (select distinct l_orderkey, l_linenumber, l_shipdate from lineitem) group by 1")
def rank_order(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").distinct()
    rows = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber"))), lambda s: s.l_linenumber).alias("ranks"))
    return rows.select("l_orderkey", (F.col("ranks") == F.array_sort("ranks")).alias("in_order"))


@query("c28_map_default", "select event_type, cast(sum(case event_type when 'click' then 3 when 'view' then 2 else 1 end) as bigint) weight from events group by 1")
def map_default(spark, sf_dir):
    weight = F.coalesce(F.create_map(F.lit("click"), F.lit(3), F.lit("view"), F.lit(2))[F.col("event_type")], F.lit(1))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(weight).alias("weight"))


@query("c29_sha256", "select page_id, sha256(html) digest from pages")
def sha256(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


@query("c10_value_text", "select event_id, case when event_id % 5 = 0 then 'None' when event_id % 5 = 1 then 'True' else props->>'$.k' end text from events")
def value_text(spark, sf_dir):
    """Values as the text that drift compares: None, True and False are written so."""
    raw = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, F.lit("true")).otherwise(F.get_json_object("props", "$.k"))
    rows = read(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.when(F.col("raw").isNull(), "None").when(F.col("raw") == "true", "True").when(F.col("raw") == "false", "False").otherwise(F.col("raw")).alias("text"))


@query("p05_compressor_id", "select p_partkey, case p_partkey % 5 when 0 then 'none' when 1 then 'zlib:l' || (p_size % 9) when 2 then 'blosc:lz4:l' || (p_size % 9) when 3 then 'bytes,zstd' else '?' end id from part")
def compressor_ids(spark, sf_dir):
    k, level = F.col("p_partkey") % 5, (F.col("p_size") % 9).cast("string")
    raw = F.when(k == 0, "null").when(k == 1, F.concat(F.lit('{"id":"zlib","level":'), level, F.lit("}"))).when(k == 2, F.concat(F.lit('{"id":"blosc","cname":"lz4","clevel":'), level, F.lit(',"shuffle":1}'))).when(k == 3, '[{"name":"bytes","configuration":{"endian":"little"}},{"name":"zstd"}]').otherwise('{"x":1}')
    return read(spark, sf_dir, "part").select("p_partkey", fn.compressor_id(raw).alias("id"))


@query("p18_bbox", "select p_partkey, case when p_partkey % 4 < 2 then p_size * 1.0 end low, case when p_partkey % 4 < 2 then p_size + 10.0 end high from part")
def bboxes(spark, sf_dir):
    s = F.col("p_size").cast("string")
    corner = lambda add: F.concat_ws(",", s, s, (F.col("p_size") + add).cast("string"))
    k = F.col("p_partkey") % 4
    raw = F.when(k < 2, F.concat(F.lit("[["), corner(0), F.lit("],["), corner(10), F.lit("]]"))).when(k == 2, "[[1,2],[3,4]]").otherwise("{}")
    rows = read(spark, sf_dir, "part").select("p_partkey", fn.bbox(raw).alias("b"))
    at = lambda i: F.get(F.get("b", F.lit(i)), F.lit(2))
    return rows.select("p_partkey", at(0).alias("low"), at(1).alias("high"))


@query("p19_volume_id", NAMED + "select k, regexp_replace(name, '\\.zarr$', '') id from (select k, lower(name) as name from n)")
def volume_ids(spark, sf_dir):
    path = F.concat(F.lit("s3://store/volumes/"), F.lower("name"), F.lit("/"))
    return named(spark, sf_dir).select("k", fn.volume_id(path).alias("id"))


@query("p15_index_size", "select p_partkey, case when p_partkey % 3 = 2 then null else 16 * p_size + case when p_partkey % 3 = 1 then 4 else 0 end end size from part")
def index_size(spark, sf_dir):
    """Bytes of a shard index; an unknown index codec has no size."""
    codecs = F.when(F.col("p_partkey") % 3 == 0, "bytes").when(F.col("p_partkey") % 3 == 1, "bytes,crc32c").otherwise("bytes,zstd")
    size = F.when(codecs == "bytes", 16 * F.col("p_size")).when(codecs == "bytes,crc32c", 16 * F.col("p_size") + 4)
    return read(spark, sf_dir, "part").select("p_partkey", size.cast("bigint").alias("size"))


@query("c36_prefix_proof", "select p_partkey, p_partkey % 4 < 2 and p_size % 3 = 0 proves from part")
def prefix_proof(spark, sf_dir):
    """A non-zero byte proves content only for integer kinds with fill zero."""
    dtype = F.get(F.array(F.lit("|u1"), F.lit("<i2"), F.lit("<f4"), F.lit("float64")), (F.col("p_partkey") % 4).cast("int"))
    kind = F.create_map(*(F.lit(x) for k, v in schema.DTYPES.items() for x in (k, v[0])))[dtype]
    fill = (F.col("p_size") % 3).cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", (kind.isin("u", "i") & (fill == 0)).alias("proves"))


@query("l04_code_table", "select event_type code, count(*) n from events group by 1")
def code_table(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")
