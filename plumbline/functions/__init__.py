"""Column functions of the evidence engine: built-in expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ numbers
def is_close(a: Column | str, b: Column | str, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    """|a - b| <= max(rel * max(|a|, |b|), absolute); infinities equal themselves, NaN nothing."""
    a, b = col(a), col(b)
    same = (a == b) & ~F.isnan(a)
    finite = is_finite(a) & is_finite(b)
    return same | (finite & (F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))))


def is_finite(x: Column | str) -> Column:
    x = col(x)
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def product(values: Column | str) -> Column:
    """Product of whole numbers, exact to 38 digits."""
    return F.aggregate(col(values), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))


def grid(shape: Column | str, chunks: Column | str) -> Column:
    """Chunks along each axis."""
    return F.zip_with(col(shape), col(chunks), lambda s, c: F.ceil(s / c))


def n_chunks(shape: Column | str, chunks: Column | str) -> Column:
    """Number of chunks; null if a chunk extent is not positive."""
    bad = F.exists(col(chunks), lambda c: c <= 0)
    safe = F.transform(col(chunks), lambda c: F.when(c > 0, c))
    return F.when(~bad, product(F.transform(grid(shape, safe), lambda n: F.greatest(F.lit(1), n))))


def top_entries(shape: Column | str, chunks: Column | str, separator: Column | str, zarr_format: Column | str) -> Column:
    """Most top-level keys a level directory can have."""
    return F.when(col(zarr_format) == 3, F.lit(1)).when(col(separator) == "/", F.get(grid(shape, chunks), F.lit(0))).otherwise(n_chunks(shape, chunks).cast("bigint"))


def expected_extent(base: Column, factor: Column, mode: str) -> Column:
    """An axis scaled down by ``factor``, rounded up (ceil) or down (floor), one at least."""
    x = base / factor
    return F.greatest(F.lit(1), F.ceil(x) if mode == "ceil" else F.floor(x))


def unravel(flat: Column, shape: list[Column]) -> Column:
    """Index along each axis of a flat position, last axis fastest."""
    out, rest = [], flat
    for n in reversed(shape):
        out.append(rest % n)
        rest = F.floor(rest / n)
    return F.array(*reversed(out))


def ravel(index: list[Column], shape: list[Column]) -> Column:
    flat = F.lit(0)
    for i, n in zip(index, shape):
        flat = flat * n + i
    return flat


def spread_positions(total: Column, k: int) -> Column:
    """k positions evenly over 0 ... total - 1, both ends included, rounded half to even."""
    if k == 1:
        return F.array(F.floor((total - 1) / 2))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (total - 1) / F.lit(float(k - 1))).cast("bigint")))


# ------------------------------------------------------------------ names and paths
def is_zarr_name(name: Column | str) -> Column:
    return F.lower(col(name)).endswith(".zarr")


def is_coordinate_name(name: Column | str) -> Column:
    return col(name).rlike("^[0-9]+(_[0-9]+)*$")


def is_timestamp_name(name: Column | str) -> Column:
    return col(name).rlike("^[0-9]{8,}")


def is_chunk_key(name: Column | str) -> Column:
    return col(name).rlike(r"^\d+(\.\d+)*$")


def chunk_key(index: Column, separator: Column, zarr_format: Column) -> Column:
    return F.when(zarr_format == 3, F.concat(F.lit("c/"), F.array_join(index.cast("array<string>"), "/"))).when(separator == "/", F.array_join(index.cast("array<string>"), "/")).otherwise(F.array_join(index.cast("array<string>"), "."))


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.regexp_replace(col(path), "/+$", ""), "/", -1)


def volume_id(path: Column | str) -> Column:
    """Last part of a path without ``.zarr``."""
    return F.regexp_replace(base_name(path), r"\.zarr$", "")


def hrefs(html: Column | str) -> Column:
    """Targets of links on a listing page."""
    return F.regexp_extract_all(col(html), F.lit('(?i)href="([^"?][^"]*)"'), F.lit(1))


def unquoted(text: Column | str) -> Column:
    """Percent escapes decoded; a plus stays."""
    return F.try_url_decode(F.replace(col(text), F.lit("+"), F.lit("%2B")))


def listed_kind(href: Column) -> Column:
    """dir or file; null for what leaves the listing."""
    outside = href.rlike("^([a-zA-Z][a-zA-Z0-9+.-]*:|/|#|\\.\\.)") | href.contains("#") | href.contains("?")
    return F.when(~outside, F.when(href.endswith("/"), "dir").otherwise("file"))


def human_bytes(n: Column | str) -> Column:
    """1024-based units: whole bytes, else one decimal."""
    n = col(n).cast("double")
    out = F.when(n < 1024, F.concat(F.format_string("%.0f", n), F.lit(" B")))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        bounded = F.concat(F.format_string("%.1f", F.bround(n / 1024.0**i, 1)), F.lit(f" {unit}"))
        out = out.otherwise(bounded) if unit == "PiB" else out.when(n < 1024.0 ** (i + 1), bounded)
    return out


# ------------------------------------------------------------------ evidence
def content_range(header: Column | str) -> Column:
    """struct(first, last, total) of a Content-Range header; total null for ``*``; null if malformed."""
    h, pattern = col(header), r"(?i)^\s*bytes (\d+)-(\d+)/(\d+|\*)\s*$"
    part = lambda i: F.regexp_extract(h, pattern, i)
    return F.when(h.rlike(pattern), F.struct(part(1).cast("bigint").alias("first"), part(2).cast("bigint").alias("last"), F.nullif(part(3), F.lit("*")).cast("bigint").alias("total")))


def evidence_of_error(error: Column | str, listing: bool = False) -> Column:
    """struct(state, reason) of a failed access: only a confirmed 404 is absence."""
    e = F.lower(col(error))
    has = lambda *words: e.rlike("|".join(words))
    rules = [(has(r"\b404\b", "not found"), schema.ABSENT, "NOT_FOUND"), (has(r"\b401\b"), schema.UNKNOWN, "UNAUTHORIZED"), (has(r"\b403\b", "forbidden", "access denied"), schema.UNKNOWN, "FORBIDDEN")]
    if listing:
        rules.append((has(r"\b405\b"), schema.UNKNOWN, "LISTING_UNSUPPORTED"))
    rules += [(has(r"\b408\b"), schema.UNKNOWN, "TIMEOUT"), (has(r"\b429\b"), schema.UNKNOWN, "RATE_LIMITED"), (has(r"\b5\d\d\b"), schema.UNKNOWN, "SERVER_ERROR"), (has("timeout", "timed out"), schema.UNKNOWN, "TIMEOUT"), (has("connection"), schema.UNKNOWN, "CONNECTION_ERROR")]
    state, reason = None, None
    for test, s, r in rules:
        state = F.when(test, s) if state is None else state.when(test, s)
        reason = F.when(test, r) if reason is None else reason.when(test, r)
    return F.struct(state.otherwise(schema.UNKNOWN).alias("state"), reason.otherwise("TRANSPORT_ERROR").alias("reason"))


def json_evidence(raw: Column | str) -> Column:
    """PRESENT / ABSENT of a document and METADATA_UNREADABLE where it doesn't parse."""
    raw = col(raw)
    bad = raw.isNotNull() & F.try_parse_json(raw).isNull()
    return F.struct(F.when(raw.isNull(), schema.ABSENT).otherwise(schema.PRESENT).alias("state"), F.when(bad, "METADATA_UNREADABLE").alias("reason"))


def ome_version(raw: Column | str) -> Column:
    """struct(major, minor, modelled): versions up to 0.5 are modelled; none declared is as well."""
    raw, pattern = col(raw), r"^(\d+)\.(\d+)(?:\.\d+)?$"
    ok = raw.rlike(pattern)
    major, minor = (F.when(ok, F.regexp_extract(raw, pattern, i).cast("int")) for i in (1, 2))
    newer = (major > 0) | ((major == 0) & (minor > 5))
    return F.struct(major.alias("major"), minor.alias("minor"), (raw.isNull() | (ok & ~newer)).alias("modelled"))


def compressor_id(compressor: Column | str) -> Column:
    """``id[:cname][:lN]`` of a v2 compressor object, ``none`` for null, joined names of v3 codecs."""
    raw = F.trim(col(compressor))
    get = lambda path: F.get_json_object(raw, path)
    one = F.concat_ws(":", F.coalesce(get("$.id"), F.lit("?")), get("$.cname"), F.concat(F.lit("l"), F.coalesce(get("$.clevel"), get("$.level"))))
    names = F.array_join(F.transform(F.from_json(raw, "array<struct<name:string>>"), lambda c: F.coalesce(c["name"], F.lit("?"))), ",")
    return F.when(raw.isNull() | raw.isin("null", "", "{}", "[]"), "none").when(raw.startswith("["), names).otherwise(one)


def bbox(raw: Column | str) -> Column:
    """array<array<double>> of two corners with three coordinates, null when malformed."""
    box = F.from_json(col(raw), "array<array<double>>")
    good = (F.size(box) == 2) & (F.size(F.get(box, F.lit(0))) == 3) & (F.size(F.get(box, F.lit(1))) == 3)
    return F.when(good, box)


# ------------------------------------------------------------------ severities
def severity_of(code: Column | str) -> Column:
    pairs = [F.lit(x) for kv in schema.SEVERITY.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[col(code)], F.lit(schema.DEFAULT_SEVERITY))


def severity_rank(severity: Column | str) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in schema.SEVERITIES)), col(severity)).cast("int") - 1
