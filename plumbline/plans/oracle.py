"""The registered queries in SQL for DuckDB, written apart from the DataFrame programs."""

from __future__ import annotations

LINES = """
ln as (
  select l_orderkey, l_linenumber, cast(sum(l_quantity) as bigint) q, min(l_partkey) pk, min(l_suppkey) sk, min(l_returnflag) rf
  from lineitem group by 1, 2)"""

LEVELS = (
    LINES
    + """,
lw as (
  select *, first_value(q) over w b, first_value(l_linenumber) over w s0
  from ln window w as (partition by l_orderkey order by l_linenumber)),
ls as (
  select *, cast(greatest(1, floor(8 * b * s0 / l_linenumber)) as bigint) + case when l_linenumber = s0 then 0 else pk % 3 end d8,
         cast(greatest(1, floor(16 * b * s0 / l_linenumber)) as bigint) + case when l_linenumber = s0 then 0 else pk % 3 end d16,
         (1 + pk % 64) * case when sk % 7 = 0 then 16 else 1 end ch,
         case when pk % 13 = 0 then 1.0::double else l_linenumber::double end sc
  from lw),
lv as (
  select 'root/' || l_orderkey root, l_linenumber - 1 idx, cast(l_linenumber - 1 as varchar) path, pk % 17 <> 0 present,
    case when pk % 17 <> 0 or pk % 3 = 1 then 'PRESENT' when pk % 3 = 0 then 'UNKNOWN' else 'ABSENT' end state,
    case when pk % 17 = 0 and pk % 3 = 1 then 'METADATA_UNREADABLE' when pk % 17 = 0 and pk % 3 = 0 then 'SERVER_ERROR' end reason,
    case when pk % 17 = 0 then null when pk % 101 = 0 then [0::bigint, d16, d16] when pk % 53 = 0 then [d16, d16] else [d8, d16, d16] end shape,
    case when pk % 17 = 0 then null when pk % 101 <> 0 and pk % 53 = 0 then [ch, ch] else [ch, ch, ch] end chunks,
    case rf when 'A' then '|u1' when 'N' then '<u2' else '<f4' end dtype,
    case when pk % 29 <> 0 then '0' end fill_value,
    case sk % 4 when 0 then 'none' when 1 then 'zlib:l1' else 'blosc:lz4:l5' end compressor_id,
    case when pk % 31 = 0 then '/' else '.' end separator,
    case when pk % 37 <> 0 then [sc, sc, sc] end declared_scale,
    case when sk % 19 = 0 then false when sk % 23 <> 0 then true end has_chunks,
    case when sk % 19 = 0 then 'ABSENT' when sk % 23 = 0 then 'UNKNOWN' else 'PRESENT' end chunk_state,
    case when l_orderkey % 2 = 0 then 3 else 2 end zarr_format,
    case when pk % 41 <> 0 then ['z', 'y', 'x'] end dimension_names,
    case when l_orderkey % 14 = 7 then [] else list_concat(
      list_transform(range(case when pk % 43 = 0 then 0 when pk % 47 = 0 then 2 else 1 end), lambda i: {'kind': 'scale', 'len': case when pk % 61 = 0 then 2 when pk % 67 = 0 then null else 3 end}),
      case when pk % 59 = 0 then [{'kind': 'translation', 'len': 2}] else [] end) end transforms
  from ls)"""
)

PYRAMIDS = """
py as (
  select 'root/' || k root, case when k % 40 = 0 then 'UNKNOWN' when k % 40 in (5, 6) then 'ABSENT' else 'PRESENT' end state,
    case when k % 40 = 0 then 'SERVER_ERROR' when k % 40 = 1 then 'METADATA_UNREADABLE' when k % 80 = 7 then 'AUDIT_ERROR' end reason,
    k % 40 >= 10 has_multiscales, k % 40 >= 8 is_group, k % 40 >= 9 multiscales_key,
    case k % 40 when 2 then 'array' when 3 then 'headerless_chunks' when 4 then 'container' when 5 then 'absent' when 6 then 'empty' else 'unknown' end node_kind,
    case k % 7 when 1 then '0.4' when 2 then '0.5' when 3 then '0.6' when 4 then '0.10' when 5 then 'junk' when 6 then '0.3' end version,
    k % 7 in (0, 1, 2, 6) modelled, k % 7 <> 0 declared, k % 7 in (1, 2) or k % 14 = 0 transforms, k % 7 = 2 v5,
    case k % 11 when 0 then ['y', 'x'] when 1 then ['z', 'y', 'y'] when 2 then ['z'] else ['z', 'y', 'x'] end axes,
    k % 11 r11, k % 13 r13, k % 5 = 0 and not (k % 15 = 0 and k % 11 = 2) has_unit, k % 9 = 0 marked, k % 21 = 0 beyond, k
  from (select o_orderkey k from orders))"""

AUDIT = (
    "with "
    + LEVELS
    + ","
    + PYRAMIDS
    + """,
own as (select lv.* from lv join py using (root) where py.has_multiscales),
p0 as (
  select *, first_value({'path': path, 'shape': shape, 'scale': declared_scale}) over w base, lag(declared_scale) over w before,
         row_number() over w place
  from own where present window w as (partition by root order by idx)),
p1 as (
  select *, case when place > 1 and declared_scale is not null and len(shape) = len(base.shape)
    then declared_scale[1] / coalesce(base.scale[1], 1.0) end f
  from p0),
p2 as (
  select *, case when f > 0 then list_transform(base.shape, lambda s: cast(greatest(1, ceil(s / f)) as bigint)) end up,
            case when f > 0 then list_transform(base.shape, lambda s: cast(greatest(1, floor(s / f)) as bigint)) end down
  from p1),
pr as (
  select *, case when up is not null then case when shape = up and shape = down then 'exact' when shape = up then 'ceil' when shape = down then 'floor' else 'mismatch' end end rounding
  from p2),
dr as (
  select root, count(distinct len(shape)) ndims, count(distinct dtype) dtypes, count(distinct coalesce(fill_value, 'None')) fills,
    count(distinct compressor_id) compressors, count(distinct separator) separators,
    count(distinct rounding) filter (rounding in ('ceil', 'floor')) roundings,
    any_value(path) filter (place = 1) base_path, any_value(shape) filter (place = 1) base_shape, any_value(declared_scale) filter (place = 1) base_scale
  from pr group by root),
rt as (
  select *, marked and ((has_unit and spatial) or coalesce(scaled, false)) contradiction
  from (select dr.*, py.*,
      -- typed space, or named x, y or z: every axis here is
      true spatial, base_scale[1] <> 1.0 scaled
    from dr join py using (root) where py.has_multiscales)),
cf as (
  select own.* exclude (transforms), own.transforms ts, py.axes, py.declared, py.transforms, py.v5, case when len(py.axes) > 0 then len(py.axes) else coalesce(len(own.shape), 0) end ndim
  from own join py using (root) where py.modelled and root in (select root from pr)),
f as (
  select root, '' as level, 'ACCESS_UNKNOWN' code, 'UNKNOWN' evidence_state from py where not has_multiscales and state = 'UNKNOWN'
  union all select root, '', 'METADATA_UNREADABLE', 'PRESENT' from py where not has_multiscales and state <> 'UNKNOWN' and reason = 'METADATA_UNREADABLE'
  union all select root, '', case node_kind when 'array' then 'BARE_ARRAY' when 'headerless_chunks' then 'HEADERLESS_CHUNK_STORE' when 'container' then 'CONTAINER_NO_GROUP_HEADER'
      when 'absent' then 'ROOT_ABSENT' when 'empty' then 'EMPTY_ZARR_DIR' else 'NOT_A_ZARR_GROUP' end, state
    from py where not has_multiscales and not is_group and k % 40 not in (0, 1) and k % 80 <> 7
  union all select root, '', 'AUDIT_ERROR', 'PRESENT' from py where reason = 'AUDIT_ERROR'
  union all select root, '', case when multiscales_key then 'MULTISCALE_EMPTY' else 'NOT_MULTISCALE' end, 'PRESENT' from py where not has_multiscales and is_group
  union all select root, path, case when state = 'UNKNOWN' then 'ACCESS_UNKNOWN' when reason = 'METADATA_UNREADABLE' then 'METADATA_UNREADABLE' else 'LEVEL_MISSING' end, state
    from own where not present
  union all select root, path, 'DEGENERATE_LEVEL', 'PRESENT' from own where present and shape[1] <= 0
  union all select root, path, 'LEVEL_NO_CHUNKS', chunk_state from own where present and has_chunks = false
  union all select root, cast(last + j as varchar), 'LEVEL_UNDECLARED', 'PRESENT'
    from (select root, k, max(idx) last from own join py using (root) where beyond group by 1, 2), (select unnest([1, 2, 3]) j)
    where (k + 1) % 3 <> 0 and (j < 2 or (k + 2) % 3 <> 0) and (j < 3 or (k + 3) % 3 <> 0)
  union all select root, path, 'SCALE_NONMONOTONIC', 'PRESENT' from pr where declared_scale is not null and before is not null and declared_scale[1] <= before[1]
  union all select root, path, 'SCALE_SHAPE_MISMATCH', 'PRESENT' from pr where rounding = 'mismatch'
  union all select root, path, 'CHUNK_EXCEEDS_SHAPE', 'PRESENT' from (
      select *, list_transform(range(1, len(shape) + 1), lambda i: case when shape[i] = 0 then 1.0 else chunks[i] / shape[i] end) r from pr)
    where len(list_filter(range(1, len(shape) + 1), lambda i: chunks[i] < shape[i])) = 0 and list_product(shape) > 1 and list_product(r) >= 8
  union all select root, '', 'NDIM_DRIFT', 'PRESENT' from rt where ndims > 1
  union all select root, '', 'DTYPE_DRIFT', 'PRESENT' from rt where dtypes > 1
  union all select root, '', 'FILL_DRIFT', 'PRESENT' from rt where fills > 1
  union all select root, '', 'COMPRESSOR_DRIFT', 'PRESENT' from rt where compressors > 1
  union all select root, '', 'SEPARATOR_DRIFT', 'PRESENT' from rt where separators > 1
  union all select root, '', 'MIXED_ROUNDING', 'PRESENT' from rt where roundings > 1
  union all select root, base_path, 'AXES_MISMATCH', 'PRESENT' from rt where len(axes) <> len(base_shape)
  union all select root, base_path, 'PHYSICAL_SCALE_CONTRADICTION', 'PRESENT' from rt where contradiction
  union all select root, base_path, 'PHYSICAL_SCALE_UNKNOWN', 'PRESENT' from rt where marked and not contradiction
  union all select root, '', 'OME_VERSION_UNMODELLED', 'PRESENT' from rt where not modelled
  union all select root, '', 'AXES_INVALID', 'PRESENT' from rt where modelled and (
      r11 in (1, 2) or (r13 <> 0 and case when r13 = 1 then true else len(axes) not in (2, 3) end))
  union all select root, path, 'DIMENSION_NAMES_MISMATCH', 'PRESENT' from cf where v5 and present and zarr_format = 3 and dimension_names is distinct from axes
  union all select root, path, 'TRANSFORM_SCALE_COUNT', 'PRESENT' from cf where transforms and len(list_filter(ts, lambda t: t.kind = 'scale')) <> 1
  -- each transform whose payload is no list or has another length than the axes, unless it agrees with the array and the axes don't
  union all select root, path, 'TRANSFORM_ARITY', 'PRESENT' from (select *, unnest(ts).len n from cf where transforms and ndim > 0)
    where n is null or (n <> ndim and not coalesce(len(axes) <> len(shape) and n = len(shape), false))),
fi as (
  select root, level, code, case
      when code in ('MULTISCALE_EMPTY', 'LEVEL_MISSING', 'LEVEL_NO_CHUNKS', 'SEPARATOR_DRIFT', 'DTYPE_DRIFT', 'SCALE_SHAPE_MISMATCH', 'DEGENERATE_LEVEL', 'NDIM_DRIFT', 'HEADERLESS_CHUNK_STORE', 'METADATA_UNREADABLE', 'PHYSICAL_SCALE_CONTRADICTION', 'AUDIT_ERROR') then 'high'
      when code in ('LEVEL_UNDECLARED', 'SCALE_NONMONOTONIC', 'FILL_DRIFT', 'MIXED_ROUNDING') then 'medium'
      when code in ('NOT_A_ZARR_GROUP', 'NOT_MULTISCALE', 'BARE_ARRAY', 'CHUNK_EXCEEDS_SHAPE', 'ACCESS_UNKNOWN', 'PHYSICAL_SCALE_UNKNOWN', 'OME_VERSION_UNMODELLED') then 'info'
      else 'low' end severity, evidence_state
  from f),
findings as (select *, severity <> 'info' actionable from fi),
rolled as (
  select py.root, count(f.code) n_findings, count(*) filter (f.actionable) n_actionable,
    max(case f.severity when 'high' then 3 when 'medium' then 2 when 'low' then 1 when 'info' then 0 end) top,
    coalesce(bool_or(f.code in ('ACCESS_UNKNOWN', 'ROOT_ABSENT', 'EMPTY_ZARR_DIR') or f.evidence_state = 'UNKNOWN'), false) blind,
    coalesce(bool_or(f.code in ('ROOT_ABSENT', 'EMPTY_ZARR_DIR')), false) nothing,
    coalesce(bool_or(f.code = 'ACCESS_UNKNOWN'), false) unreadable
  from py left join findings f using (root) group by py.root),
verdicts as (
  select root, n_findings, n_actionable, coalesce(['info', 'low', 'medium', 'high'][top + 1], 'none') max_severity,
    case when top = 3 then 'FAIL' when blind then 'UNKNOWN' when top = 2 then 'WARN' else 'PASS' end integrity, unreadable, nothing, top
  from rolled)
"""
)
