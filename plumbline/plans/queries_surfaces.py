"""Queries of surfaces audited from stored bytes. Each part is a surface; the files are written here by a
program of their own, and the SQL computes from the same rules of the part's key."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import selection, surfaces
from ..sources import arrays, surface_scan
from .catalogue import Catalogue
from .tables import read

catalogue = Catalogue()
query = catalogue.query

#: Cap of a channel's bytes where a query has one, and extent of the volume the surfaces belong to (z, y, x).
MOST_BYTES, SHAPE = 700, (90, 95, 98)


# ------------------------------------------------------------------ what is planted
def _point(k: int, r: int, col: int) -> list[float]:
    x, y, z = (((k * 17 + r * 29 + col * 13 + c * 41) % 201) / 2 for c in range(3))
    if k % 8 == 3 and col == 1:
        y = -3.5
    if k % 6 == 2 and (r * 3 + col) % 11 == 5:
        z = math.nan
    if k % 4 == 1 and (r + col) % 10 == 3:
        x = -1.0
    return [-1.0] * 3 if (k + r * 7 + col) % 9 == 0 or k % 25 == 0 else [x, y, z]


def _tiff(k: int, m: int, grid: list[list[float]]) -> bytes:
    """Three rows in strips of two, of either byte order, classic or big, the directory last."""
    e, big, w = ">" if k % 3 == 0 else "<", k % 5 == 0, len(grid[0])
    code, bits, kind = ("H", 16, 1) if m % 41 == 0 else ("f", 32, 3)
    strips = [struct.pack(f"{e}{w * len(rows)}{code}", *(v if code == "f" else 7 for row in rows for v in row)) for rows in (grid[:2], grid[2:])]
    if m % 2 == 0:
        strips = [zlib.compress(s, 0) for s in strips]
    begin = 16 if big else 8
    places, lengths = [begin, begin + len(strips[0])], [len(s) for s in strips]
    tags = [(256, 3, [w]), (257, 3, [3]), (258, 3, [bits]), (259, 3, [8 if m % 2 == 0 else 1]), (273, 4, places), (277, 3, [1]), (278, 3, [2]), (279, 4, lengths), (317, 3, [2 if m % 53 == 0 else 1]), (339, 3, [kind])]
    body, after = b"".join(strips), begin + sum(lengths)
    entries, tail = b"", b""
    for tag, typ, values in tags:
        data = struct.pack(f"{e}{len(values)}{'H' if typ == 3 else 'I'}", *values)
        if len(data) > (8 if big else 4):
            tail += data
            data = struct.pack(e + "I", after + len(tail) - len(data))
        entries += struct.pack(e + ("HHQ" if big else "HHI"), tag, typ, len(values)) + data.ljust(8 if big else 4, b"\0")
    place = after + len(tail)
    if big:
        return struct.pack(e + "2sHHHQ", b"MM" if e == ">" else b"II", 43, 8, 0, place) + body + tail + struct.pack(e + "Q", len(tags)) + entries + bytes(8)
    return struct.pack(e + "2sHI", b"MM" if e == ">" else b"II", 42, place) + body + tail + struct.pack(e + "H", len(tags)) + entries + bytes(4)


def _planted(k: int, w: int) -> tuple[dict[str, bytes], dict[str, int]]:
    root, objects, faults = f"surface/{k}", {}, {}
    if k % 47 == 0:
        return objects, faults
    points = [[_point(k, r, col) for col in range(w)] for r in range(3)]
    valid = [p for row in points for p in row if -1 not in p and not math.isnan(sum(p))]
    box = [[f(p[c] for p in valid) for c in range(3)] for f in (min, max)] if valid and k % 3 else [[0, 0, 0], [40, 40, 40]]
    meta = {"format": "tifxyz", "scale": [0.5, 0.5], "bbox": box, "target_volume": f"volumes/v{k % 3}.zarr"}
    if k % 19 == 0:
        del meta["format"]
    if k % 43 == 0:
        faults[f"{root}/meta.json"] = 503
    elif k % 11:
        objects[f"{root}/meta.json"] = (b'{"format": ' if k % 2 == 0 else b"[1, 2]") if k % 17 == 0 else json.dumps(meta).encode()
    for c, axis in enumerate("xyz"):
        m, path = k + c, f"{root}/{axis}.tif"
        if m % 13 == 0:
            continue
        if m % 29 == 0:
            faults[path] = 500
            continue
        n = w - 1 if m % 37 == 0 and w > 1 else w
        body = _tiff(k, m, [[p[c] for p in row[:n]] for row in points])
        objects[path] = b"no image at all" if m % 31 == 0 else body[: len(body) // 2] if m % 59 == 0 else body
    return objects, faults


def planted(spark, sf_dir):
    """Surfaces with their part of a store."""
    kinds = pa.schema([("surface", pa.string()), ("objects", pa.map_(pa.string(), pa.binary())), ("faults", pa.map_(pa.string(), pa.int32()))])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrays.slices(batches):
            rows = []
            for k, w in zip(b["p_partkey"].to_pylist(), b["p_size"].to_pylist()):
                objects, faults = _planted(k, w)
                rows.append({"surface": f"surface/{k}", "objects": list(objects.items()), "faults": list(faults.items())})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism)
    return parts.mapInArrow(plant, "surface string, objects map<string, binary>, faults map<string, int>")


# ------------------------------------------------------------------ the same rules in SQL
def _rules(most_bytes: int | None) -> str:
    """Findings of surfaces; without a cap content is judged whatever a channel's size."""
    capped = most_bytes is not None
    large = f" arg_min(name, c) filter (size > {most_bytes}) large," if capped else ""
    within, left, first = ("large is null and packed is null", "(large is not null or packed is not null)", "coalesce(large, packed)") if capped else ("packed is null", "packed is not null", "packed")
    return f"""with p as (select p_partkey k, 'surface/' || p_partkey surface, p_size w, p_partkey % 47 = 0 gone from part),
ch as (select *, k + c m, ['x.tif', 'y.tif', 'z.tif'][c + 1] name from p, (select unnest([0, 1, 2]) c)),
st as (select *, case when gone or m % 13 = 0 then 'ABSENT' when m % 29 = 0 then 'UNKNOWN' else 'PRESENT' end state, m % 31 <> 0 and m % 59 <> 0 good, case when m % 37 = 0 and w > 1 then w - 1 else w end width, m % 41 = 0 odd,
  12 * w + case when m % 2 = 0 then 22 else 0 end + case when k % 5 = 0 then 232 else 150 end size from ch),
gr as (select k, any_value(surface) surface, any_value(w) w, bool_and(state = 'PRESENT' and good and not odd) and count(distinct width) = 1 fit,{large} arg_min(name, c) filter (m % 53 = 0) packed from st group by k),
cell as (select *, (k + r * 7 + col) % 9 = 0 or k % 25 = 0 hole from (select k, surface, w, unnest(range(w)) col, r from gr, (select unnest([0, 1, 2]) r) where fit and {within})),
pt as (select k, surface, r, col,
  case when hole or k % 4 = 1 and (r + col) % 10 = 3 then -1.0 else ((k * 17 + r * 29 + col * 13) % 201) / 2.0 end::double x,
  case when hole then -1.0 when k % 8 = 3 and col = 1 then -3.5 else ((k * 17 + r * 29 + col * 13 + 41) % 201) / 2.0 end::double y,
  case when hole then -1.0 when k % 6 = 2 and (r * 3 + col) % 11 = 5 then 'nan'::double else ((k * 17 + r * 29 + col * 13 + 82) % 201) / 2.0 end::double z from cell),
mk as (select *, x = -1 or y = -1 or z = -1 marked, x = -1 and y = -1 and z = -1 allm, isnan(z) odd from pt),
sf as (select k, any_value(surface) surface, count(*) n, count(*) filter (not marked and not odd) n_valid, count(*) filter (marked and not allm) n_partial, count(*) filter (not marked and odd) n_nonfinite,
  count(*) filter (not marked and not odd and (x < 0 or y < 0 or z < 0)) n_negative, count(*) filter (not marked and not odd and (z >= 90 or y >= 95 or x >= 98)) n_overrun,
  coalesce(k % 3 = 0 and k % 43 <> 0 and k % 11 <> 0 and k % 17 <> 0 and (min(x) filter (not marked and not odd) <> 0 or min(y) filter (not marked and not odd) <> 0 or min(z) filter (not marked and not odd) <> 0
    or max(x) filter (not marked and not odd) <> 40 or max(y) filter (not marked and not odd) <> 40 or max(z) filter (not marked and not odd) <> 40), false) differs from mk group by k),
raw as (
  select surface, '' as level, 'TIFXYZ_ABSENT' code, 'ABSENT' evidence_state from p where gone
  union all select surface, 'meta.json', 'ACCESS_UNKNOWN', 'UNKNOWN' from p where not gone and k % 43 = 0
  union all select surface, 'meta.json', 'TIFXYZ_META_MISSING', 'ABSENT' from p where not gone and k % 43 <> 0 and k % 11 = 0
  union all select surface, 'meta.json', case when k % 17 = 0 then 'TIFXYZ_META_UNREADABLE' else 'TIFXYZ_META_INCOMPLETE' end, 'PRESENT' from p where not gone and k % 43 <> 0 and k % 11 <> 0 and (k % 17 = 0 or k % 19 = 0)
  union all select surface, name, case state when 'ABSENT' then 'TIFXYZ_CHANNEL_MISSING' else 'ACCESS_UNKNOWN' end, state from st where not gone and state <> 'PRESENT'
  union all select surface, name, case when not good then 'TIFXYZ_TIFF_UNREADABLE' else 'TIFXYZ_SAMPLE_FORMAT' end, 'PRESENT' from st where state = 'PRESENT' and (not good or odd)
  union all select any_value(surface), '', 'TIFXYZ_CHANNEL_SHAPE_MISMATCH', 'PRESENT' from st where state = 'PRESENT' and good group by k having count(distinct width) > 1
  union all select surface, {first}, 'TIFXYZ_CONTENT_UNDECODED', 'PRESENT' from gr where fit and {left}
  union all select surface, '', 'TIFXYZ_EMPTY', 'PRESENT' from sf where n_valid = 0
  union all select surface, '', 'TIFXYZ_INVALID_MASK_MISMATCH', 'PRESENT' from sf where n_valid > 0 and n_partial > 0
  union all select surface, '', 'TIFXYZ_NONFINITE', 'PRESENT' from sf where n_valid > 0 and n_nonfinite > 0
  union all select surface, '', 'TIFXYZ_NEGATIVE_COORDINATE', 'PRESENT' from sf where n_valid > 0 and n_negative > 0
  union all select surface, '', 'TIFXYZ_TARGET_VOLUME_OVERRUN', 'PRESENT' from sf where n_valid > 0 and n_overrun > 0
  union all select surface, 'meta.json', 'TIFXYZ_BBOX_MISMATCH', 'PRESENT' from sf where n_valid > 0 and differs),
fd as (select *, case when code in ('TIFXYZ_META_MISSING', 'TIFXYZ_META_UNREADABLE', 'TIFXYZ_CHANNEL_MISSING', 'TIFXYZ_TIFF_UNREADABLE', 'TIFXYZ_CHANNEL_SHAPE_MISMATCH', 'TIFXYZ_EMPTY') then 'medium' when code in ('ACCESS_UNKNOWN', 'TIFXYZ_CONTENT_UNDECODED') then 'info' else 'low' end severity from raw) """


SURFACES, UNCAPPED = _rules(MOST_BYTES), _rules(None)
FINDING = "surface, level, code, evidence_state, severity"


def audited(spark, sf_dir, content: bool = True, most_bytes: int | None = MOST_BYTES):
    return surfaces.audit(planted(spark, sf_dir), content=content, most_bytes=most_bytes, shape_zyx=SHAPE)


def findings(spark, sf_dir, content: bool = True, most_bytes: int | None = MOST_BYTES):
    return audited(spark, sf_dir, content, most_bytes)[1].select(*FINDING.split(", "))


query("t00_surface_findings", SURFACES + f"select {FINDING} from fd")(findings)

#: Codes that the header pass alone decides, and codes of content.
HEADER_CODES = ((1, "ABSENT"), (2, "META_MISSING"), (3, "META_UNREADABLE"), (4, "META_INCOMPLETE"), (5, "CHANNEL_MISSING"), (6, "TIFF_UNREADABLE"), (7, "CHANNEL_SHAPE_MISMATCH"), (8, "SAMPLE_FORMAT"), (16, "ACCESS_UNKNOWN"))
CONTENT_CODES = ((9, "EMPTY"), (10, "INVALID_MASK_MISMATCH"), (11, "NONFINITE"), (12, "NEGATIVE_COORDINATE"), (13, "BBOX_MISMATCH"), (14, "TARGET_VOLUME_OVERRUN"), (15, "CONTENT_UNDECODED"))
#: Codes that are looked for in all surfaces that are fit for it, whatever their channels' size.
OF_ANY_SIZE = ("NONFINITE",)
for _i, _name in HEADER_CODES + CONTENT_CODES:
    _code = _name if _i == 16 else f"TIFXYZ_{_name}"
    _most = None if _name in OF_ANY_SIZE else MOST_BYTES

    @query(f"t{_i:02d}_{_name.lower()}", (UNCAPPED if _most is None else SURFACES) + f"select {FINDING} from fd where code = '{_code}'")
    def one_code(spark, sf_dir, code=_code, content=_i in dict(CONTENT_CODES), most_bytes=_most):
        return findings(spark, sf_dir, content, most_bytes).filter(F.col("code") == code)


@query("t00_header_codes", SURFACES + f"select {FINDING} from fd where code in ({', '.join(repr(c if i == 16 else 'TIFXYZ_' + c) for i, c in HEADER_CODES)})")
def header_codes(spark, sf_dir):
    return findings(spark, sf_dir, content=False).filter("code <> 'TIFXYZ_CONTENT_UNDECODED'")


@query("t00_content_codes", SURFACES + f"select surface, code, severity from fd where code in ({', '.join(repr('TIFXYZ_' + c) for _, c in CONTENT_CODES)})")
def content_codes(spark, sf_dir):
    return findings(spark, sf_dir).filter(F.col("code").isin(["TIFXYZ_" + c for _, c in CONTENT_CODES])).select("surface", "code", "severity")


@query("t00_content_statistics", SURFACES + "select surface, n, n_valid, round_even(n_valid / n, 6) valid_fraction, n_partial, n_nonfinite, n_negative, n_overrun, differs box_differs from sf")
def content_statistics(spark, sf_dir):
    return audited(spark, sf_dir)[2].select("surface", "n", "n_valid", "valid_fraction", "n_partial", "n_nonfinite", "n_negative", "n_overrun", "box_differs")


@query(
    "t00_verdicts",
    SURFACES
    + """, sums as (select surface, max(case severity when 'info' then 0 when 'low' then 1 else 2 end) worst, bool_or(code = 'ACCESS_UNKNOWN') blind, bool_or(code = 'TIFXYZ_ABSENT') none_, bool_or(evidence_state = 'ABSENT') parts from fd group by 1)
select surface, case when none_ then 'ABSENT' when blind then 'UNKNOWN' else 'PRESENT' end evidence_state, case when none_ then 'NOT_FOUND' when blind then 'ACCESS_UNKNOWN' when parts then 'PARTS_ABSENT' end reason,
  case when none_ or blind then 'UNKNOWN' when worst = 2 then 'WARN' else 'PASS' end integrity, case worst when 0 then 'info' when 1 then 'low' when 2 then 'medium' else 'none' end max_severity from p left join sums using (surface)""",
)
def surface_verdicts(spark, sf_dir):
    found, said, _ = audited(spark, sf_dir)
    return surfaces.verdicts(found, said)


@query("a27_survey", SURFACES + "select code, count(distinct fd.surface) n, quantile_cont(n_valid, 0.5) median_valid from fd left join sf using (surface) group by 1")
def survey(spark, sf_dir):
    _, said, stats = audited(spark, sf_dir)
    rows = said.join(stats.select("surface", "n_valid").hint("merge"), "surface", "left")
    counts = rows.groupBy("code").agg(F.count_distinct("surface").alias("n"))
    return counts.join(selection.percentiles(rows, ["code"], "n_valid", {"median_valid": 0.5}), "code", "left")


@query("l09_ordered_codes", SURFACES + "select surface, string_agg(code, ',' order by code) codes from fd group by 1")
def ordered_codes(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("surface").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))


@query("f16_expected_volume", SURFACES + "select surface, case when gone or k % 11 = 0 and k % 43 <> 0 then 'meta.json is ABSENT' when k % 43 = 0 then 'meta.json is UNKNOWN' when k % 17 = 0 then 'meta.json is no JSON object' else 'target_volume is volumes/v' || k % 3 || '.zarr' end why from p where gone or k % 43 = 0 or k % 11 = 0 or k % 17 = 0 or k % 3 <> 0")
def expected_volume(spark, sf_dir):
    """The surfaces that an audit with an expected volume stops at, before it reads any content."""
    return surfaces.target_failures(surface_scan.headers(planted(spark, sf_dir)), "other/v0.zarr/")


@query("f20_size_cap", SURFACES + "select surface from gr where fit and large is null")
def size_cap(spark, sf_dir):
    """Surfaces whose content may be read: fit for it, and no channel over the cap, decided by headers."""
    found = surface_scan.headers(planted(spark, sf_dir))
    return found.filter(surfaces.eligible(found) & F.forall("channels", lambda c: c.bytes <= MOST_BYTES)).select("surface")
