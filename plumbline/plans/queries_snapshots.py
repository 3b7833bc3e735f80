"""Queries that compare snapshots and choose rows by order, over events, orders and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl, diff, sampling
from .catalogue import Catalogue
from .tables import read

catalogue = Catalogue()
query = catalogue.query

#: Findings of two runs: the halves of the month.
RUNS = """with e as (select user_id root, cast(floor(value) as bigint) % 3 as level, event_type code, value, day(ts) <= 15 early from events),
b as (select distinct root, level, code from e where early), a as (select distinct root, level, code from e where not early) """


def runs(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("root"), (F.floor("value") % 3).alias("level"), F.col("event_type").alias("code"), (F.day("ts") <= 15).alias("early"))
    return tuple(rows.filter(F.col("early") == half).select("root", "level", "code").distinct() for half in (True, False))


@query("x01_fixed", RUNS + "select * from b where root in (select root from a) except select * from a")
def fixed(spark, sf_dir):
    return diff.fixed(*runs(spark, sf_dir), "root")


@query("x02_new", RUNS + "select * from a where root in (select root from b) except select * from b")
def new(spark, sf_dir):
    return diff.new(*runs(spark, sf_dir), "root")


@query("x03_unchanged", RUNS + "select * from b intersect select * from a")
def unchanged(spark, sf_dir):
    return diff.unchanged(*runs(spark, sf_dir))


@query("x04_on_new_roots", "with b as (select distinct c_nationkey root, c_mktsegment code from customer where c_custkey % 50 = 0), a as (select distinct c_nationkey root, c_mktsegment code from customer) select * from a where root not in (select root from b)")
def on_new_roots(spark, sf_dir):
    after = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("root"), F.col("c_mktsegment").alias("code"))
    return diff.on_new_roots(after.filter("c_custkey % 50 = 0").select("root", "code"), after.select("root", "code"), "root")


@query("x05_roots", RUNS + "select coalesce(x.root, y.root) root, case when x.root is null then 'added' when y.root is null then 'dropped' else 'common' end change from (select distinct root from b) x full join (select distinct root from a) y on x.root = y.root")
def roots(spark, sf_dir):
    return diff.roots(*runs(spark, sf_dir), "root")


@query("x06_union_of_sources", "select distinct n from (select s_name n from supplier union all select c_name from customer union all select s_name from supplier where s_suppkey % 2 = 0)")
def union_of_sources(spark, sf_dir):
    s, c = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("n")), read(spark, sf_dir, "customer").select(F.col("c_name").alias("n"))
    return s.unionByName(c).unionByName(read(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("n"))).distinct()


@query("x08_key_sets", RUNS + "select 'before' side, root, level from (select root, level from b except select root, level from a) union all select 'after', root, level from (select root, level from a except select root, level from b)")
def key_sets(spark, sf_dir):
    before, after = (r.select("root", "level") for r in runs(spark, sf_dir))
    side = lambda rows, name: rows.select(F.lit(name).alias("side"), "root", "level")
    return side(before.subtract(after), "before").unionByName(side(after.subtract(before), "after"))


LEVEL_RUNS = """with e as (select user_id, event_type, count(*) n, cast(floor(max(value)) as bigint) top, case when min(value) >= 1 then cast(floor(min(value)) as bigint) end low, day(ts) <= 15 early from events group by 1, 2, 6),
b as (select * from e where early), a as (select * from e where not early) """


@query("j06_snapshot_diff", LEVEL_RUNS + """select coalesce(b.user_id, a.user_id) user_id, coalesce(b.event_type, a.event_type) event_type,
    case when b.user_id is null then 'added' when a.user_id is null then 'dropped' when b.n is distinct from a.n or b.top is distinct from a.top or b.low is distinct from a.low then 'changed' else 'same' end change,
    case when b.user_id is null or a.user_id is null then '' else concat_ws(',', case when b.n is distinct from a.n then 'n' end, case when b.top is distinct from a.top then 'top' end, case when b.low is distinct from a.low then 'low' end) end fields
    from b full join a on b.user_id = a.user_id and b.event_type = a.event_type""")
def snapshot_diff(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id", "event_type", (F.day("ts") <= 15).alias("early")).agg(F.count("*").alias("n"), F.floor(F.max("value")).alias("top"), F.when(F.min("value") >= 1, F.floor(F.min("value"))).alias("low"))
    return diff.changes(rows.filter("early"), rows.filter("not early"), ["user_id", "event_type"], ["n", "top", "low"])


@query("j15_roots_by_run", RUNS + "select change, count(*) n from (select case when x.root is null then 'added' when y.root is null then 'dropped' else 'common' end change from (select distinct root from b) x full join (select distinct root from a) y on x.root = y.root) group by 1")
def roots_by_run(spark, sf_dir):
    return roots(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


@query("j16_code_totals", RUNS + "select code, coalesce(n_before, 0) n_before, coalesce(n_after, 0) n_after from (select code, count(*) n_before from b group by 1) full join (select code, count(*) n_after from a group by 1) using (code)")
def code_totals(spark, sf_dir):
    return diff.totals(*runs(spark, sf_dir), "code")


@query("a29_regression_counts", RUNS + """select (select count(*) from (select * from b where root in (select root from a) except select * from a)) fixed,
    (select count(*) from (select * from a where root in (select root from b) except select * from b)) added, (select count(*) from (select * from b intersect select * from a)) unchanged""")
def regression_counts(spark, sf_dir):
    """Fixed, added and unchanged by one full outer join of the two runs."""
    before, after = runs(spark, sf_dir)
    kept = lambda rows, other: rows.join(other.select("root").distinct().withColumn("common", F.lit(True)), "root", "left")
    keys = ["root", "level", "code"]
    both = kept(before, after).withColumnRenamed("common", "cb").withColumn("b", F.lit(True)).join(kept(after, before).withColumnRenamed("common", "ca").withColumn("a", F.lit(True)), keys, "full_outer")
    return both.agg(F.count_if(F.col("b") & F.col("a").isNull() & F.col("cb")).alias("fixed"), F.count_if(F.col("a") & F.col("b").isNull() & F.col("ca")).alias("added"), F.count_if(F.col("a") & F.col("b")).alias("unchanged"))


# ------------------------------------------------------------------ choices by order
@query("w03_keep_first", "select text, doc_id, lang from (select *, row_number() over (partition by text order by doc_id, lang) k from documents) where k = 1")
def keep_first(spark, sf_dir):
    return sampling.keep_first(read(spark, sf_dir, "documents").select("text", "doc_id", "lang"), ["text"], ["doc_id"])


@query("w05_until_gap", "select distinct l_orderkey, l_linenumber from (select *, l_linenumber - dense_rank() over (partition by l_orderkey order by l_linenumber) g, min(l_linenumber) over (partition by l_orderkey) - 1 g0 from lineitem) where g = g0")
def until_gap(spark, sf_dir):
    return sampling.until_gap(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("w06_even_sample", "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_partkey) - 1 k, count(*) over (partition by p_brand) n from part) where n <= 6 or list_contains([0, n // 6, 2 * n // 6, 3 * n // 6, 4 * n // 6, 5 * n // 6], k)")
def even_sample(spark, sf_dir):
    return sampling.even_sample(read(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 6).select("p_brand", "p_partkey")


@query("w07_spread_sample", "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_partkey) - 1 k, count(*) over (partition by p_brand) n from part) where list_contains(list_transform([0, 1, 2, 3, 4], lambda i: cast(round_even(i * (n - 1) / 4.0::double, 0) as bigint)), k)")
def spread_sample(spark, sf_dir):
    return sampling.spread_sample(read(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 5).select("p_brand", "p_partkey")


@query("l08_hashed_sample", "select p_partkey from part order by md5('7|' || p_partkey), p_partkey limit 50")
def hashed_sample(spark, sf_dir):
    return sampling.hashed_sample(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 50, seed=7)


SUFFIX = "select s_name, case when n_nationkey is null then null else n_name end n_name from (select s.s_name, s.s_suppkey, n.*, row_number() over (partition by s_suppkey order by n_nationkey) k from supplier s left join nation n on ends_with(s.s_name, '0' || n_nationkey)) where k = 1"


@query("j09_first_suffix", SUFFIX)
def first_suffix(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("0"), F.col("n_nationkey").cast("string")).alias("suffix"))
    return sampling.first_suffix(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name", nations, "suffix", "n_nationkey").select("s_name", "n_name")


@query("j07_prefix_join", "select c.c_custkey, n.n_name from customer c join nation n on starts_with('NATION_' || c.c_nationkey, n.n_name) and contains(c.c_name, '1')")
def prefix_join(spark, sf_dir):
    """Target and pyramid by prefix and content: the paths' prefixes are joined by equality."""
    customers = read(spark, sf_dir, "customer").filter(F.col("c_name").contains("1")).select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("path"))
    starts = customers.select("c_custkey", F.explode(sampling.prefixes(F.col("path"))).alias("n_name"))
    return starts.join(read(spark, sf_dir, "nation").select("n_name"), "n_name").select("c_custkey", "n_name")


@query("j10_pool_without", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def pool_without(spark, sf_dir):
    flagged = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(flagged, "o_orderkey", "left_anti")


@query("j18_mirror_pairs", "select split_part(s_name, '#', 2) stem, s_suppkey, c_custkey from supplier join customer on split_part(s_name, '#', 2) = split_part(c_name, '#', 2)")
def mirror_pairs(spark, sf_dir):
    stem = lambda c: F.regexp_extract(c, "#(.*)$", 1).alias("stem")
    return read(spark, sf_dir, "supplier").select(stem("s_name"), "s_suppkey").join(read(spark, sf_dir, "customer").select(stem("c_name"), "c_custkey"), "stem")


@query("l05_largest", "select l_suppkey, n from (select l_suppkey, count(*) n from lineitem where l_discount > 0.05 group by 1) order by n desc, l_suppkey limit 5")
def largest(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").filter("l_discount > 0.05").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(5)


# ------------------------------------------------------------------ crawl
TREE = """with recursive u as (select distinct regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') p from pages),
parts as (select p, string_split(p, '/') s from u),
nodes as (select distinct array_to_string(s[1:i], '/') path, case when i > 1 then array_to_string(s[1:i - 1], '/') end parent from parts, lateral (select unnest(range(1, len(s) + 1)) i)),
walk as (select path, 0 depth from nodes where parent is null
  union all select n.path, w.depth + 1 from walk w join nodes n on n.parent = w.path where w.depth < 10 and not regexp_full_match(split_part(w.path, '/', -1), '[0-9]+(_[0-9]+)*')) """


def tree(spark, sf_dir):
    """Hosts and folders of the pages' addresses as (parent, path)."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/+$", "")
    parts = read(spark, sf_dir, "pages").select(path.alias("p")).distinct().select(F.split("p", "/").alias("s"))
    nodes = parts.select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("i"))
    return nodes.select(F.when(F.col("i") > 1, F.array_join(F.slice("s", F.lit(1), F.col("i") - 1), "/")).alias("parent"), F.array_join(F.slice("s", F.lit(1), F.col("i")), "/").alias("path")).distinct()


@query("w08_crawl", TREE + "select path, cast(depth as bigint) depth, case when regexp_full_match(split_part(path, '/', -1), '[0-9]+(_[0-9]+)*') then 'coordinate' else 'descend' end step from walk")
def crawled(spark, sf_dir):
    from ..sources import store_table

    edges = tree(spark, sf_dir)
    found = crawl.crawl(edges.filter("parent is not null"), edges.filter("parent is null"), store=store_table)
    return found.select("path", F.col("depth").cast("bigint").alias("depth"), "step")


@query("f07_crawl_outcomes", TREE + "select case when regexp_full_match(split_part(path, '/', -1), '[0-9]+(_[0-9]+)*') then 'coordinate' else 'descend' end step, count(*) n from walk group by 1")
def crawl_outcomes(spark, sf_dir):
    return crawled(spark, sf_dir).groupBy("step").agg(F.count("*").alias("n"))
