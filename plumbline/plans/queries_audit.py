"""Queries of the audit program: each rule, the roll-ups, the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from .. import schema
from ..functions.json_schema import schema_faults
from ..operators import rollup, sampling
from ..sources import store_table
from . import rules, tables
from .catalogue import Catalogue
from .oracle import AUDIT, LEVELS, PYRAMIDS
from .tables import read

catalogue = Catalogue()
query = catalogue.query
WITH_LEVELS = "with " + LEVELS + " "

#: Rules in the order of the inventory; the part of the program that each belongs to.
RULES = (
    "ACCESS_UNKNOWN METADATA_UNREADABLE BARE_ARRAY HEADERLESS_CHUNK_STORE CONTAINER_NO_GROUP_HEADER ROOT_ABSENT EMPTY_ZARR_DIR NOT_A_ZARR_GROUP NOT_MULTISCALE MULTISCALE_EMPTY "
    "LEVEL_MISSING DEGENERATE_LEVEL LEVEL_NO_CHUNKS LEVEL_UNDECLARED NDIM_DRIFT AXES_MISMATCH PHYSICAL_SCALE_CONTRADICTION PHYSICAL_SCALE_UNKNOWN OME_VERSION_UNMODELLED AXES_INVALID "
    "DIMENSION_NAMES_MISMATCH TRANSFORM_SCALE_COUNT TRANSFORM_ARITY DTYPE_DRIFT FILL_DRIFT COMPRESSOR_DRIFT SEPARATOR_DRIFT SCALE_NONMONOTONIC SCALE_SHAPE_MISMATCH MIXED_ROUNDING CHUNK_EXCEEDS_SHAPE AUDIT_ERROR"
).split()


def relations(spark, sf_dir):
    return tables.pyramids(spark, sf_dir), tables.levels(spark, sf_dir)


def findings(spark, sf_dir):
    return rules.audit(*relations(spark, sf_dir))


def rolled(spark, sf_dir):
    return rules.integrity(tables.pyramids(spark, sf_dir), findings(spark, sf_dir))


query("r00_audit", AUDIT + "select * from findings")(findings)
for _i, _code in enumerate(RULES, 1):
    query(f"r{_i:02d}_{_code.lower()}", AUDIT + f"select * from findings where code = '{_code}'")(lambda spark, sf_dir, code=_code: rules.audit(*relations(spark, sf_dir), only=code))


@query("a01_counts", AUDIT + "select coalesce(code, '*') code, coalesce(severity, '*') severity, count(*) n from findings group by grouping sets ((code), (severity), ())")
def counts(spark, sf_dir):
    return rollup.counts(findings(spark, sf_dir))


@query(
    "a02_run_summary",
    AUDIT
    + """select count(*) roots, count(*) filter (n_findings > 0) roots_with_findings, count(*) filter (n_findings = 0) roots_clean,
    cast(sum(n_findings) as bigint) findings, cast(sum(n_actionable) as bigint) actionable, cast(sum(n_findings - n_actionable) as bigint) informational,
    count(*) filter (n_actionable > 0) roots_with_defects from verdicts""",
)
def run_summary(spark, sf_dir):
    return rollup.run_summary(tables.pyramids(spark, sf_dir), findings(spark, sf_dir))


@query("a05_max_severity", AUDIT + "select max_severity, count(*) n from verdicts group by 1")
def max_severity(spark, sf_dir):
    return rolled(spark, sf_dir).groupBy("max_severity").agg(F.count("*").alias("n"))


@query(
    "a06_integrity",
    AUDIT
    + """select root, n_findings, n_actionable, max_severity, integrity,
    case integrity when 'WARN' then 'CAUTION' when 'PASS' then 'DEFER_TO_QUALITY' else 'DO NOT TRAIN' end verdict, unreadable, nothing from verdicts""",
)
def integrity(spark, sf_dir):
    return rolled(spark, sf_dir)


GATE = """case when unreadable then 'unreadable' when nothing then 'absent' when coalesce(top, -1) >= 3 then 'fail' else 'pass' end"""


GATE_CODE = "case when unreadable then 'GATE_UNREADABLE' when nothing then 'GATE_ROOT_ABSENT' end code"


@query("g01_gate", AUDIT + f"select root, {GATE} outcome, {GATE} <> 'pass' fail, integrity, max_severity, {GATE_CODE} from verdicts")
def gate(spark, sf_dir):
    return rules.gate(rolled(spark, sf_dir))


@query("g02_gate_lenient", AUDIT + f"select root, {GATE} outcome, {GATE} = 'fail' fail, integrity, max_severity, {GATE_CODE} from verdicts")
def gate_lenient(spark, sf_dir):
    return rules.gate(rolled(spark, sf_dir), ignore_unreadable=True, allow_absent=True)


VOXELS = """, vx as (
  select py.root, case when not py.has_multiscales or marked or base_scale is null or k % 5 <> 0 or k % 15 = 0 then 'unknown'
    when abs(base_scale[1] * case when k % 10 = 0 then 0.001 else 1.0 end - 1.0) > 0.001 then 'mismatch' else 'match' end size
  from py left join dr using (root))"""
FENCE = "case when unreadable then 'unreadable' when nothing then 'absent' when size <> 'match' or coalesce(top, -1) >= 3 then 'fail' else 'pass' end"
FENCE_CODE = "case when unreadable then 'GATE_UNREADABLE' when nothing then 'GATE_ROOT_ABSENT' when size <> 'match' then 'GATE_VOXEL_SIZE_' || upper(size) end code"


@query("g03_gate_voxel_size", AUDIT + VOXELS + f" select root, {FENCE} outcome, {FENCE} <> 'pass' fail, integrity, max_severity, {FENCE_CODE} from verdicts join vx using (root)")
def gate_voxel_size(spark, sf_dir):
    """The gate where every root is asked to have voxels of one micrometre."""
    return rules.gate(rolled(spark, sf_dir), voxels=rules.voxel_sizes(*relations(spark, sf_dir), 1.0))


@query("a31_gate_totals", AUDIT + f"select count(*) filter ({GATE} = 'pass') n_pass, count(*) filter ({GATE} <> 'pass') n_fail from verdicts")
def gate_totals(spark, sf_dir):
    return gate(spark, sf_dir).agg(F.count_if(~F.col("fail")).alias("n_pass"), F.count_if("fail").alias("n_fail"))


@query("l01_gate_order", AUDIT + f"select root, fail, row_number() over (order by fail desc, root) place from (select root, {GATE} <> 'pass' fail from verdicts)")
def gate_order(spark, sf_dir):
    """The gate's report: all roots, failing ones first, then by root."""
    # stored first: dealing rows to ranges reads them twice
    rows = store_table(gate(spark, sf_dir).select("root", "fail")).withColumn("passes", ~F.col("fail"))
    return sampling.placed(rows, ["passes", "root"], "place").select("root", "fail", "place")


@query("l03_counter_order", AUDIT + "select code, count(*) n from findings group by 1")
def counter_order(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


@query("f11_threshold", AUDIT + "select root, level, code, severity from findings where severity in ('medium', 'high')")
def threshold(spark, sf_dir):
    return findings(spark, sf_dir).filter(fn.severity_rank("severity") >= schema.SEVERITIES.index("medium")).select("root", "level", "code", "severity")


@query("f12_actionable", AUDIT + "select root, count(*) n from findings where actionable group by 1")
def actionable(spark, sf_dir):
    return findings(spark, sf_dir).filter("actionable").groupBy("root").agg(F.count("*").alias("n"))


@query("a28_registry", AUDIT + """select root, string_agg(distinct code, ',' order by code) codes, ['info', 'low', 'medium', 'high'][max(case severity when 'high' then 4 when 'medium' then 3 when 'low' then 2 else 1 end)] max_severity,
    case when bool_or(severity = 'high') then 'high' else 'low' end compat_severity from findings where actionable group by 1""")
def defect_registry(spark, sf_dir):
    return rollup.registry(findings(spark, sf_dir))


@query("l02_registry_order", AUDIT + "select root, bool_or(severity = 'high') high from findings where actionable group by 1")
def registry_order(spark, sf_dir):
    """Roots with something to act on, those with high findings first; stored before they are put in order, as that reads them twice."""
    return store_table(findings(spark, sf_dir).filter("actionable").groupBy("root").agg(F.bool_or(F.col("severity") == "high").alias("high"))).orderBy(F.desc("high"), "root")


@query("p21_queue", AUDIT + "select root, integrity, case integrity when 'PASS' then 1.0::double else 0.5::double end weight from verdicts where integrity in ('PASS', 'WARN')")
def queue(spark, sf_dir):
    return rollup.queue(rolled(spark, sf_dir), {"PASS": 1.0, "WARN": 0.5})


@query("p11_reports", AUDIT + """select v.root, integrity, max_severity, case integrity when 'WARN' then 'CAUTION' when 'PASS' then 'DEFER_TO_QUALITY' else 'DO NOT TRAIN' end verdict,
    c.declared, c.present, coalesce(x.listed, '') listed
    from verdicts v left join (select root, count(*) declared, count(*) filter (present) present from lv group by 1) c using (root)
    left join (select root, string_agg(level || ':' || code || ':' || evidence_state, ';' order by level, code, severity, evidence_state) listed from findings group by 1) x using (root)""")
def reports(spark, sf_dir):
    found = store_table(findings(spark, sf_dir))
    docs = rollup.reports(rules.integrity(tables.pyramids(spark, sf_dir), found), found, tables.levels(spark, sf_dir))
    listed = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f.level, f.code, f.evidence_state)), ";")
    return docs.select("root", "integrity", "max_severity", "verdict", "coverage.declared", "coverage.present", listed.alias("listed"))


@query("c24_report_schema", AUDIT + """select root, case k % 10 when 3 then '$.integrity: enum' when 5 then '$.coverage: required' when 7 then '$.note: additionalProperties' when 9 then '$: json' else '' end faults
    from (select root, cast(substr(root, 6) as bigint) k from verdicts)""")
def report_schema(spark, sf_dir):
    """Reports as JSON, some of them damaged, against their schema."""
    found = store_table(findings(spark, sf_dir))
    docs = rollup.reports(rules.integrity(tables.pyramids(spark, sf_dir), found), found, tables.levels(spark, sf_dir))
    k = F.substring("root", 6, 20).cast("bigint") % 10
    docs = docs.withColumns({"integrity": F.when(k == 3, "BROKEN").otherwise(F.col("integrity")), "coverage": F.when(k != 5, F.col("coverage")), "note": F.when(k == 7, "x")})
    text = F.to_json(F.struct(*docs.columns))
    text = F.when(k == 9, F.substring(text, 2, 30)).otherwise(text)
    return docs.select("root", F.array_join(schema_faults(text, schema.REPORT), ";").alias("faults"))


@query("p13_finding_evidence", AUDIT + "select code, evidence_state, count(*) n from findings group by 1, 2")
def finding_evidence(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("code", "evidence_state").agg(F.count("*").alias("n"))


@query("j03_finding_level", AUDIT + "select f.root, f.level, f.code, l.state level_state, l.chunk_state from findings f left join lv l on f.root = l.root and f.level = l.path")
def finding_level(spark, sf_dir):
    levels = tables.levels(spark, sf_dir).select("root", F.col("path").alias("level"), F.col("state").alias("level_state"), "chunk_state")
    return findings(spark, sf_dir).select("root", "level", "code").join(levels, ["root", "level"], "left")


@query("a33_contract", AUDIT + f"select distinct code, severity, '{schema.fingerprint()}' contract from findings")
def contract(spark, sf_dir):
    """Codes that occur and their share of the contract, with its fingerprint."""
    seen = findings(spark, sf_dir).select("code", "severity").distinct()
    return seen.withColumn("contract", F.lit(schema.fingerprint()))


@query("x09_code_coverage", AUDIT + "select distinct code from (select unnest([" + ", ".join(f"'{c}'" for c in schema.SEVERITY) + "]) code) where code not in (select code from findings)")
def code_coverage(spark, sf_dir):
    """Codes of the catalogue that no finding has."""
    wanted = spark.createDataFrame([(c,) for c in schema.SEVERITY], "code string")
    return wanted.subtract(findings(spark, sf_dir).select("code"))


# ------------------------------------------------------------------ levels
@query("a07_coverage", WITH_LEVELS + """select root, count(*) declared, count(*) filter (present) present, count(*) filter (state = 'UNKNOWN') as unknown, count(*) filter (state = 'ABSENT') absent,
    count(*) filter (present and chunk_state = 'PRESENT') chunks_present, count(*) filter (present and chunk_state = 'ABSENT') chunks_absent, count(*) filter (present and chunk_state = 'UNKNOWN') chunks_unknown from lv group by 1""")
def coverage(spark, sf_dir):
    return rollup.coverage(tables.levels(spark, sf_dir))


@query("p03_chunk_grid", WITH_LEVELS + """select root, path, array_to_string(g, 'x') grid, cast(list_product(list_transform(g, lambda n: greatest(1, n))) as bigint) n_chunks, cast(list_product(shape) as bigint) n_voxels,
    cast(case when zarr_format = 3 then 1 when separator = '/' then g[1] else list_product(list_transform(g, lambda n: greatest(1, n))) end as bigint) top_entries
    from (select *, list_transform(range(1, len(shape) + 1), lambda i: cast(ceil(shape[i] / chunks[i]) as bigint)) g from lv where present)""")
def chunk_grid(spark, sf_dir):
    rows = tables.levels(spark, sf_dir).filter("present")
    return rows.select("root", "path", F.array_join(fn.grid("shape", "chunks").cast("array<string>"), "x").alias("grid"), fn.n_chunks("shape", "chunks").cast("bigint").alias("n_chunks"), fn.product("shape").cast("bigint").alias("n_voxels"), fn.top_entries("shape", "chunks", "separator", "zarr_format").alias("top_entries"))


@query("p06_chunk_keys", WITH_LEVELS + """select root, path, case when zarr_format = 3 then 'c/' || array_to_string(g, '/') when separator = '/' then array_to_string(g, '/') else array_to_string(g, '.') end last_key
    from (select *, list_transform(range(1, len(shape) + 1), lambda i: greatest(0, cast(ceil(shape[i] / chunks[i]) as bigint) - 1)) g from lv where present)""")
def chunk_keys(spark, sf_dir):
    """The key of each level's last chunk."""
    last = F.transform(fn.grid("shape", "chunks"), lambda n: F.greatest(F.lit(0), n - 1))
    return tables.levels(spark, sf_dir).filter("present").select("root", "path", fn.chunk_key(last, F.col("separator"), F.col("zarr_format")).alias("last_key"))


@query("p16_inner_chunks", WITH_LEVELS + """select root, path, cast(list_product(list_transform(range(1, len(shape) + 1), lambda i: greatest(0, least(2, cast(ceil((shape[i] - (shape[i] // (2 * chunks[i])) * 2 * chunks[i]) / chunks[i]) as bigint))))) as bigint) inner_chunks
    from lv where present""")
def inner_chunks(spark, sf_dir):
    """Inner chunks in the last shard of each level, with shards of two chunks an axis."""
    rows = tables.levels(spark, sf_dir).filter("present")
    start = lambda s, c: F.floor(s / (2 * c)) * 2 * c
    per_axis = F.zip_with("shape", "chunks", lambda s, c: F.greatest(F.lit(0), F.least(F.lit(2), F.ceil((s - start(s, c)) / c))))
    return rows.select("root", "path", fn.product(per_axis).cast("bigint").alias("inner_chunks"))


@query("p10_level_records", WITH_LEVELS + """select root, path, idx, present, array_to_string(shape, ',') shape, array_to_string(chunks, ',') chunks, dtype, fill_value, compressor_id, separator, state, reason, has_chunks, chunk_state from lv""")
def level_records(spark, sf_dir):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return tables.levels(spark, sf_dir).select("root", "path", F.col("idx").cast("bigint").alias("idx"), "present", text("shape"), text("chunks"), "dtype", "fill_value", "compressor_id", "separator", "state", "reason", "has_chunks", "chunk_state")


@query("f10_present_levels", WITH_LEVELS + "select root, count(*) n from lv where present and len(shape) > 0 group by 1")
def present_levels(spark, sf_dir):
    return tables.levels(spark, sf_dir).filter(F.col("present") & (F.size("shape") > 0)).groupBy("root").agg(F.count("*").alias("n"))


for _id, _col in (("a03_dtype_drift", "dtype"), ("a03_fill_drift", "fill_value"), ("a03_separator_drift", "separator"), ("a03_compressor_drift", "compressor_id")):

    @query(_id, WITH_LEVELS + f"select root, '{_col}' code, array_to_string(list_sort(list(distinct coalesce({_col}, 'None'))), ',') observed from lv where present group by 1 having count(distinct coalesce({_col}, 'None')) > 1")
    def drift(spark, sf_dir, col=_col):
        return rollup.drift(tables.levels(spark, sf_dir).filter("present"), "root", F.col(col), col)


@query("a04_ndims", WITH_LEVELS + "select root, array_to_string(list_sort(list(distinct len(shape))), ',') ndims from lv where present group by 1")
def ndims(spark, sf_dir):
    return tables.levels(spark, sf_dir).filter("present").groupBy("root").agg(F.array_join(F.array_sort(F.collect_set(F.size("shape"))).cast("array<string>"), ",").alias("ndims"))


@query("a08_node_state", WITH_LEVELS + """select root, bool_and(state = 'ABSENT') all_absent, bool_or(coalesce(reason = 'METADATA_UNREADABLE', false)) any_unreadable, arg_min(reason, idx) filter (state = 'UNKNOWN') first_unknown from lv group by 1""")
def node_state(spark, sf_dir):
    return tables.levels(spark, sf_dir).groupBy("root").agg(
        F.bool_and(F.col("state") == "ABSENT").alias("all_absent"),
        F.bool_or(F.equal_null("reason", F.lit("METADATA_UNREADABLE"))).alias("any_unreadable"),
        F.min_by("reason", F.when(F.col("state") == "UNKNOWN", F.col("idx"))).alias("first_unknown"),
    )


@query("j01_dataset_level", "with " + LEVELS + "," + PYRAMIDS + " select py.root, lv.path, coalesce(lv.state, 'ABSENT') state from py left join lv using (root) where py.has_multiscales")
def dataset_level(spark, sf_dir):
    pyramids, levels = relations(spark, sf_dir)
    return pyramids.filter("has_multiscales").select("root").join(levels.select("root", "path", "state"), "root", "left").select("root", "path", F.coalesce("state", F.lit("ABSENT")).alias("state"))


@query("j08_roots_with_code", AUDIT + "select root from py where root in (select root from findings where code = 'LEVEL_MISSING')")
def roots_with_code(spark, sf_dir):
    pyramids, levels = relations(spark, sf_dir)
    return pyramids.select("root").join(rules.audit(pyramids, levels, only="LEVEL_MISSING"), "root", "left_semi")


@query("p14_kinds", "with " + PYRAMIDS + """ select root, case when has_multiscales then 'pyramid' when state = 'UNKNOWN' then 'access_unknown' when reason = 'METADATA_UNREADABLE' then 'metadata_unreadable'
    when not is_group then case when node_kind = 'unknown' then 'not_a_zarr_group' else node_kind end when not multiscales_key then 'not_multiscale' else 'multiscale_empty' end kind from py""")
def kinds(spark, sf_dir):
    kind = (
        F.when(F.col("has_multiscales"), "pyramid")
        .when(F.col("state") == "UNKNOWN", "access_unknown")
        .when(F.equal_null("reason", F.lit("METADATA_UNREADABLE")), "metadata_unreadable")
        .when(~F.col("is_group"), F.when(F.col("node_kind") == "unknown", "not_a_zarr_group").otherwise(F.col("node_kind")))
        .when(~F.col("multiscales_key"), "not_multiscale")
        .otherwise("multiscale_empty")
    )
    return tables.pyramids(spark, sf_dir).select("root", kind.alias("kind"))


@query("p08_versions", "with " + PYRAMIDS + " select version, case when modelled then true else false end modelled, count(*) n from py group by 1, 2")
def versions(spark, sf_dir):
    return tables.pyramids(spark, sf_dir).select("version", fn.ome_version("version").modelled.alias("modelled")).groupBy("version", "modelled").agg(F.count("*").alias("n"))


@query("c26_duplicate_axes", "with " + PYRAMIDS + " select root, array_to_string(axes, ',') axes, r11 = 1 duplicated from py")
def duplicate_axes(spark, sf_dir):
    return tables.pyramids(spark, sf_dir).select("root", F.array_join("axes", ",").alias("axes"), (F.size(F.array_distinct("axes")) < F.size("axes")).alias("duplicated"))


# ------------------------------------------------------------------ truth, tools, targets, conditions
TRUTH = "tr as (select root, case when k % 40 < 10 then 'broken' when k % 14 = 7 then 'bare' else 'whole' end truth from py), to_ as (select 'audit' tool, root from verdicts where integrity <> 'PASS' union all select distinct 'findings', root from findings where severity in ('high', 'medium') union all select 'headers', root from py where state <> 'PRESENT' or reason is not null)"


def truth_and_tools(spark, sf_dir):
    """What is known of each root, and which roots three tools object to."""
    # stored, as two tools read it: else the audit would run for each
    pyramids, found = tables.pyramids(spark, sf_dir), store_table(findings(spark, sf_dir))
    k = F.substring_index("root", "/", -1).cast("bigint")
    truth = pyramids.select("root", F.when(k % 40 < 10, "broken").when(k % 14 == 7, "bare").otherwise("whole").alias("truth"))
    named = lambda tool, rows: rows.select(F.lit(tool).alias("tool"), "root")
    tools = named("audit", rules.integrity(pyramids, found).filter("integrity <> 'PASS'")).unionByName(named("findings", found.filter("severity in ('high', 'medium')").select("root").distinct()))
    return truth, tools.unionByName(named("headers", pyramids.filter("state <> 'PRESENT' or reason is not null")))


@query("j14_truth_and_tools", AUDIT + ", " + TRUTH + " select distinct tool, root, truth from to_ join tr using (root)")
def truth_joined(spark, sf_dir):
    truth, tools = truth_and_tools(spark, sf_dir)
    return tools.distinct().join(truth, "root").select("tool", "root", "truth")


@query("a26_hit_matrix", AUDIT + ", " + TRUTH + " select coalesce(tool, '*') tool, coalesce(truth, '*') truth, count(*) filter (hit) hits, count(*) total from (select t.tool, tr.truth, (t.tool, tr.root) in (select (tool, root) from to_) hit from tr, (select distinct tool from to_) t) group by cube (tool, truth)")
def hit_matrix(spark, sf_dir):
    truth, tools = truth_and_tools(spark, sf_dir)
    return rules.hit_matrix(truth, store_table(tools))


@query("a30_target_totals", AUDIT + "select count(*) targets, count(*) filter (n_findings = 0) without_findings, count(*) filter (levels = present) all_present, count(*) filter (levels is null) unmatched, count(*) filter (levels = 1) single, cast(coalesce(sum(levels), 0) as bigint) levels from verdicts left join (select root, count(*) levels, count(*) filter (present) present from lv group by 1) using (root)")
def target_totals(spark, sf_dir):
    """Targets by what was found of them: without findings, with all levels, with none."""
    own = tables.levels(spark, sf_dir).groupBy("root").agg(F.count("*").alias("levels"), F.count_if("present").alias("present"))
    rows = rolled(spark, sf_dir).select("root", "n_findings").join(own, "root", "left")
    return rows.agg(
        F.count("*").alias("targets"),
        F.count_if(F.col("n_findings") == 0).alias("without_findings"),
        F.count_if(F.col("levels") == F.col("present")).alias("all_present"),
        F.count_if(F.col("levels").isNull()).alias("unmatched"),
        F.count_if(F.col("levels") == 1).alias("single"),
        F.coalesce(F.sum("levels"), F.lit(0)).alias("levels"),
    )


@query("a32_conditions", AUDIT + "select count(*) roots, count(*) filter (state = 'UNKNOWN') unreachable, count(*) filter (state = 'ABSENT') absent, count(*) filter (coalesce(reason = 'METADATA_UNREADABLE', false)) unreadable, count(*) filter (has_multiscales and version is null) undeclared_version, count(*) filter (marked) marked, count(*) filter (node_kind = 'array') arrays from py")
def conditions(spark, sf_dir):
    """How many roots meet each condition of the corpus."""
    of = {
        "unreachable": "state = 'UNKNOWN'",
        "absent": "state = 'ABSENT'",
        "unreadable": "reason = 'METADATA_UNREADABLE'",
        "undeclared_version": "has_multiscales and version is null",
        "marked": "marker is not null",
        "arrays": "node_kind = 'array'",
    }
    return tables.pyramids(spark, sf_dir).agg(F.count("*").alias("roots"), *(F.count_if(F.expr(test)).alias(name) for name, test in of.items()))


@query("j02_undeclared", "with d as (select distinct l_orderkey k, l_linenumber n from lineitem), m as (select o_orderkey k, 1 + o_orderkey % 3 last from orders), b as (select k, n, last, row_number() over (partition by k order by n) r from d join m using (k) where n > last and n <= last + 3) select k, n from b where n = last + r")
def undeclared(spark, sf_dir):
    """Levels on disk that follow the last declared one: up to the first gap, three at most."""
    found = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    declared = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 3).alias("last"))
    return sampling.undeclared(found, declared, "k", "n", "last", 3)


@query("j05_level_probe", AUDIT + "select root, path, case when idx % 5 = 4 then 'UNKNOWN' else state end state, case when idx % 5 = 4 or state = 'UNKNOWN' then 'ACCESS_UNKNOWN' when state = 'ABSENT' then 'LEVEL_MISSING' end code from lv")
def level_probe(spark, sf_dir):
    """Declared levels with what a probe of their headers said; one that was not probed is unknown, not absent."""
    levels = tables.levels(spark, sf_dir)
    probes = levels.filter("idx % 5 <> 4").select("root", "path", "state")
    state = F.coalesce("state", F.lit("UNKNOWN"))
    rows = levels.select("root", "path").join(probes, ["root", "path"], "left").select("root", "path", state.alias("state"))
    return rows.withColumn("code", F.when(F.col("state") == "UNKNOWN", "ACCESS_UNKNOWN").when(F.col("state") == "ABSENT", "LEVEL_MISSING"))


@query("w12_first_suffix_table", "select root, reason from (select py.root, t.reason, row_number() over (partition by py.root order by t.n) r from py left join (select n_nationkey n, 'kind ' || n_nationkey reason, case when n_nationkey % 2 = 0 then cast(50 - n_nationkey as varchar) else '' || n_nationkey end suffix from nation) t on ends_with(py.root, t.suffix)) where r = 1".replace("select root, reason from", "with " + PYRAMIDS + " select root, reason from", 1))
def first_suffix_table(spark, sf_dir):
    """Each root with the first entry of an ordered table of suffixes that ends its name."""
    n = F.col("n_nationkey")
    table = read(spark, sf_dir, "nation").select(n.alias("n"), F.concat(F.lit("kind "), n.cast("string")).alias("reason"), F.when(n % 2 == 0, (50 - n).cast("string")).otherwise(n.cast("string")).alias("suffix"))
    return sampling.first_suffix(tables.pyramids(spark, sf_dir).select("root"), "root", table, "suffix", "n").select("root", "reason")


@query("l06_first_of_each", AUDIT + "select code, string_agg(root, ',' order by root) names, any_value(n) n from (select code, root, row_number() over (partition by code order by root) r, count(*) over (partition by code) n from (select distinct code, root from findings)) where r <= 8 group by 1")
def first_of_each(spark, sf_dir):
    """The first eight roots of each code, and how many it has."""
    return sampling.first_of_each(store_table(findings(spark, sf_dir).select("code", "root").distinct()), "code", "root", 8)


@query("p20_golden", AUDIT + "select root, level, code, severity, evidence_state, actionable from findings")
def golden(spark, sf_dir):
    """Findings as two runs are compared by: without free text."""
    return rules.golden(findings(spark, sf_dir).withColumn("detail", F.concat("code", F.lit(" at "), "level")))
