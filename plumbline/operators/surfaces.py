"""Surface grids as points: masks, extents and codes; the audit of surfaces in a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from .. import schema
from ..sources import store_table
from ..sources import surface_scan as scanning

AXES = ("x", "y", "z")


def masked(points: DataFrame) -> DataFrame:
    """Points with ``valid`` (no channel is -1, all finite), ``partial`` and ``finite``."""
    marked = [F.col(a) == -1 for a in AXES]
    any_marked, all_marked = marked[0] | marked[1] | marked[2], marked[0] & marked[1] & marked[2]
    finite = fn.is_finite("x") & fn.is_finite("y") & fn.is_finite("z")
    return points.withColumns({"partial": any_marked & ~all_marked, "finite": finite, "valid": ~any_marked & finite})


def statistics(points: DataFrame, key: str) -> DataFrame:
    """Counts and extents of each surface."""
    rows, valid = masked(points), F.col("valid")
    negative = valid & ((F.col("x") < 0) | (F.col("y") < 0) | (F.col("z") < 0))
    return rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(valid).alias("n_valid"),
        F.bround(F.count_if(valid) / F.count("*"), 6).alias("valid_fraction"),
        F.count_if("partial").alias("n_partial"),
        F.count_if(~F.col("finite")).alias("n_nonfinite"),
        F.count_if(negative).alias("n_negative"),
        *(f(F.when(valid, F.col(a))).alias(f"{name}_{a}") for a in AXES for f, name in ((F.min, "min"), (F.max, "max"))),
    )


def outside(points: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """Valid points outside a declared box, beyond a tolerance of max(1e-2, 1e-5 * |bound|)."""
    slack = lambda v: max(1e-2, 1e-5 * abs(v))
    out = [(F.col(a) < low - slack(low)) | (F.col(a) > high + slack(high)) for a in AXES]
    return masked(points).groupBy(key).agg(F.count_if(F.col("valid") & (out[0] | out[1] | out[2])).alias("n_outside"))


# ------------------------------------------------------------------ whole audit of scanned surfaces
def eligible(found: DataFrame) -> Column:
    """Whether three readable channels of one float sample share a grid, so that content can be judged."""
    good = F.forall("channels", lambda c: c.readable & _one_float(c))
    return good & (F.size(F.array_distinct(F.transform("channels", lambda c: F.struct(c.width, c.height)))) == 1)


def _over(c: Column, most_bytes: int | None) -> Column:
    return F.lit(False) if most_bytes is None else c.bytes > most_bytes


def _one_float(c: Column) -> Column:
    return (c["format"] == "float") & c.bits.isin(32, 64) & (c.samples == 1)


def found_in_headers(found: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """``(surface, level, code, evidence_state, detail)`` of what a header scan observed."""
    finding = lambda level, code, state, detail: F.struct(level.alias("level"), code.alias("code"), state.alias("evidence_state"), detail.cast("string").alias("detail"))
    meta, nothing = F.lit("meta.json"), F.lit(None).cast("string")
    one = lambda test, *args: F.when(test, F.array(finding(*args)))
    present, absent, unknown = F.lit("PRESENT"), F.lit("ABSENT"), F.lit("UNKNOWN")
    each = lambda test, code, state: F.transform(F.filter("channels", test), lambda c: finding(c["name"], F.lit(code), state, c.error))
    readable = F.filter("channels", lambda c: c.readable)
    grids = F.array_distinct(F.transform(readable, lambda c: F.struct(c.height, c.width)))
    over = F.filter("channels", lambda c: _over(c, most_bytes))
    parts = [
        one(F.col("meta_state") == "UNKNOWN", meta, F.lit("ACCESS_UNKNOWN"), unknown, F.col("meta_error")),
        one(F.col("meta_state") == "ABSENT", meta, F.lit("TIFXYZ_META_MISSING"), absent, nothing),
        one((F.col("meta_state") == "PRESENT") & ~F.col("meta_readable"), meta, F.lit("TIFXYZ_META_UNREADABLE"), present, nothing),
        one(F.size("problems") > 0, meta, F.lit("TIFXYZ_META_INCOMPLETE"), present, F.array_join("problems", "; ")),
        each(lambda c: c.state == "ABSENT", "TIFXYZ_CHANNEL_MISSING", absent),
        each(lambda c: c.state == "UNKNOWN", "ACCESS_UNKNOWN", unknown),
        each(lambda c: (c.state == "PRESENT") & ~c.readable, "TIFXYZ_TIFF_UNREADABLE", present),
        each(lambda c: c.readable & ~_one_float(c), "TIFXYZ_SAMPLE_FORMAT", present),
        one(F.size(grids) > 1, F.lit(""), F.lit("TIFXYZ_CHANNEL_SHAPE_MISMATCH"), present, F.to_json(grids)),
        F.when(eligible(found) & (F.size(over) > 0), F.array(finding(F.get(over, F.lit(0))["name"], F.lit("TIFXYZ_CONTENT_UNDECODED"), present, F.lit("over the size cap")))),
    ]
    # where every probe confirmed absence there is one finding: nothing to audit
    gone = (F.col("meta_state") == "ABSENT") & F.forall("channels", lambda c: c.state == "ABSENT")
    empty = F.array().cast("array<struct<level:string,code:string,evidence_state:string,detail:string>>")
    all_ = F.flatten(F.array(*(F.coalesce(p, empty) for p in parts)))
    return found.select("surface", F.inline(F.when(gone, F.array(finding(F.lit(""), F.lit("TIFXYZ_ABSENT"), absent, nothing))).otherwise(all_)))


def content_statistics(cells: DataFrame, shape_zyx: tuple[int, int, int] | None = None) -> DataFrame:
    """Counts and extents of each surface in one aggregate; cells have the box as declared, ``low`` and ``high``."""
    valid = F.col("valid")
    low, high = F.col("low"), F.col("high")
    slack = lambda v: F.greatest(F.lit(1e-2), F.abs(v) * 1e-5)
    out = F.lit(False)
    for i, a in enumerate(AXES):
        out = out | (F.col(a) < low[i] - slack(low[i])) | (F.col(a) > high[i] + slack(high[i]))
    marked = (F.col("x") == -1) | (F.col("y") == -1) | (F.col("z") == -1)
    beyond = (F.col("z") >= shape_zyx[0]) | (F.col("y") >= shape_zyx[1]) | (F.col("x") >= shape_zyx[2]) if shape_zyx else F.lit(False)
    stats = masked(cells).groupBy("surface").agg(
        F.count("*").alias("n"),
        F.count_if(valid).alias("n_valid"),
        F.bround(F.count_if(valid) / F.count("*"), 6).alias("valid_fraction"),
        F.count_if("partial").alias("n_partial"),
        F.count_if(~marked & ~F.col("finite")).alias("n_nonfinite"),
        F.count_if(valid & ((F.col("x") < 0) | (F.col("y") < 0) | (F.col("z") < 0))).alias("n_negative"),
        F.count_if(valid & F.coalesce(out, F.lit(False))).alias("n_outside"),
        F.count_if(valid & beyond).alias("n_overrun"),
        F.array(*(F.min(F.when(valid, F.col(a))) for a in AXES)).alias("data_low"),
        F.array(*(F.max(F.when(valid, F.col(a))) for a in AXES)).alias("data_high"),
        F.any_value("low").alias("low"),
        F.any_value("high").alias("high"),
    )
    off = F.lit(False)
    for i in range(3):
        off = off | ~fn.is_close(F.col("data_low")[i], low[i], 1e-5, 1e-2) | ~fn.is_close(F.col("data_high")[i], high[i], 1e-5, 1e-2)
    return stats.withColumn("box_differs", F.col("low").isNotNull() & (F.col("n_valid") > 0) & F.coalesce(off, F.lit(False)))


def found_in_content(stats: DataFrame) -> DataFrame:
    """``(surface, level, code, evidence_state, detail)`` of content; an empty surface is not judged further."""
    some = F.col("n_valid") > 0
    finding = lambda test, code, detail, level="": F.when(test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit("PRESENT").alias("evidence_state"), detail.cast("string").alias("detail")))
    hits = [
        finding(~some, "TIFXYZ_EMPTY", F.concat(F.lit("0/"), F.col("n").cast("string"), F.lit(" valid"))),
        finding(some & (F.col("n_partial") > 0), "TIFXYZ_INVALID_MASK_MISMATCH", F.col("n_partial")),
        finding(some & (F.col("n_nonfinite") > 0), "TIFXYZ_NONFINITE", F.col("n_nonfinite")),
        finding(some & (F.col("n_negative") > 0), "TIFXYZ_NEGATIVE_COORDINATE", F.col("n_negative")),
        finding(some & (F.col("n_overrun") > 0), "TIFXYZ_TARGET_VOLUME_OVERRUN", F.col("n_overrun")),
        finding(F.col("box_differs"), "TIFXYZ_BBOX_MISMATCH", F.when(F.col("n_outside") > 0, F.concat(F.col("n_outside").cast("string"), F.lit(" points outside"))).otherwise(F.lit("looser than the data")), "meta.json"),
    ]
    return stats.select("surface", F.inline(F.array_compact(F.array(*hits))))


def audit(surfaces: DataFrame, base: str | None = None, content: bool = True, most_bytes: int | None = None, shape_zyx: tuple[int, int, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(header scan, findings, content statistics) of surfaces in a store; see ``surface_scan``.

    Both passes are stored once, as reading them again could find another state. Content is read of
    all surfaces that are fit for it, of any size; of none with a channel over ``most_bytes``, where that is given.
    """
    found = store_table(scanning.headers(surfaces, base))
    findings = found_in_headers(found, most_bytes)
    stats = None
    if content:
        fit = found.filter(eligible(found) & ~F.exists("channels", lambda c: _over(c, most_bytes)))
        fit = fit.select("surface", "channels", "low", "high")
        # stores that come with the rows are dealt by surface: their size is unknown to the planner, and a broadcast would pass the driver
        fit = fit.join(surfaces.select("surface", "objects", "faults").hint("merge"), "surface") if base is None else fit
        blocks = store_table(scanning.content(fit, base))
        broken = blocks.filter("channel is not null").select("surface", F.col("channel").alias("level"), "undecoded", "error")
        stats = content_statistics(scanning.cells(blocks), shape_zyx)
        stats = store_table(stats.join(broken.select("surface").distinct(), "surface", "left_anti"))
        state = fn.evidence_of_error("error").state
        gaps = broken.select("surface", "level", F.when(F.col("error").isNull(), "TIFXYZ_CONTENT_UNDECODED").otherwise("ACCESS_UNKNOWN").alias("code"), F.when(F.col("error").isNull(), "PRESENT").otherwise(state).alias("evidence_state"), F.coalesce("undecoded", "error").alias("detail"))
        findings = findings.unionByName(found_in_content(stats)).unionByName(gaps)
    return found, findings.withColumn("severity", fn.severity_of("code")), stats


def verdicts(found: DataFrame, findings: DataFrame) -> DataFrame:
    """``(surface, evidence_state, reason, integrity, max_severity)`` of each surface, with findings or none."""
    rank = fn.severity_rank("severity")
    sums = findings.groupBy("surface").agg(
        F.max(rank).alias("rank"),
        F.bool_or(F.col("code") == "ACCESS_UNKNOWN").alias("blind"),
        F.bool_or(F.col("code") == "TIFXYZ_ABSENT").alias("gone"),
        F.bool_or(F.col("evidence_state") == "ABSENT").alias("parts"),
    )
    rows = found.select("surface").join(sums.hint("merge"), "surface", "left")
    unsure = F.coalesce(F.col("blind") | F.col("gone"), F.lit(False))
    return rows.select(
        "surface",
        F.when(F.col("gone"), "ABSENT").when(F.col("blind"), "UNKNOWN").otherwise("PRESENT").alias("evidence_state"),
        F.when(F.col("gone"), "NOT_FOUND").when(F.col("blind"), "ACCESS_UNKNOWN").when(F.col("parts"), "PARTS_ABSENT").alias("reason"),
        F.when(F.col("rank") == 3, "FAIL").when(unsure, "UNKNOWN").when(F.col("rank") == 2, "WARN").otherwise("PASS").alias("integrity"),
        F.coalesce(F.get(F.array(*(F.lit(s) for s in schema.SEVERITIES)), F.col("rank")), F.lit("none")).alias("max_severity"),
    )


def target_failures(found: DataFrame, expected: str) -> DataFrame:
    """``(surface, why)`` of the surfaces that don't declare the expected volume."""
    want = F.trim(F.lit(expected))
    if not expected.strip().rstrip("/"):
        raise ValueError("the expected volume must be an id or a path")
    right = F.coalesce(fn.volume_id(F.trim("target")) == fn.volume_id(want), F.lit(False))
    why = F.when(F.col("meta_state") != "PRESENT", F.concat(F.lit("meta.json is "), "meta_state")).when(~F.col("meta_readable"), "meta.json is no JSON object").otherwise(F.concat(F.lit("target_volume is "), F.coalesce("target", F.lit("not declared"))))
    return found.filter(~(right & (F.col("meta_state") == "PRESENT"))).select("surface", why.alias("why"))


def guarded(found: DataFrame, expected: str) -> DataFrame:
    """``found`` if every surface declares the expected volume; else an error before anything is audited."""
    wrong = target_failures(found, expected)
    n = wrong.count()
    if n:
        some = "; ".join(f"{r.surface}: {r.why}" for r in wrong.orderBy("surface").limit(8).collect())
        raise ValueError(f"{n} surfaces don't declare {expected!r}: {some}")
    return found
