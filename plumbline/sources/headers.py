"""Array headers as text to level columns, by Spark's JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn


def whole_numbers(raw: Column) -> Column:
    """array<bigint>, null if any element is none."""
    values = F.from_json(raw, "array<bigint>")
    return F.when(values.isNotNull() & F.forall(values, lambda v: v.isNotNull()), values)


#: What is looked at of a header; arrays and codecs stay text.
HEADER = "zarr_format string, shape string, chunks string, dtype string, data_type string, fill_value string, compressor string, codecs string, chunk_grid struct<configuration:struct<chunk_shape:string>>, dimension_separator string, chunk_key_encoding struct<configuration:struct<separator:string>>, dimension_names string"


def parsed(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with the level columns of a v2 (.zarray) or v3 (zarr.json) array header, from one parse.

    ``fill_value`` stays text as written; a header that doesn't parse gives an AUDIT_ERROR row.
    """
    h = lambda path: F.col(f"__h.{path}")
    v3 = F.coalesce(h("zarr_format") == "3", F.lit(False))
    rows = rows.withColumn("__h", F.from_json(raw, HEADER))
    return rows.withColumns(
        {
            "zarr_format": h("zarr_format").try_cast("int"),
            "shape": whole_numbers(h("shape")),
            "chunks": whole_numbers(F.when(v3, h("chunk_grid.configuration.chunk_shape")).otherwise(h("chunks"))),
            "dtype": F.when(v3, h("data_type")).otherwise(h("dtype")),
            "fill_value": h("fill_value"),
            "compressor_id": fn.compressor_id(F.when(v3, h("codecs")).otherwise(h("compressor"))),
            "separator": F.when(v3, F.coalesce(h("chunk_key_encoding.configuration.separator"), F.lit("/"))).otherwise(F.coalesce(h("dimension_separator"), F.lit("."))),
            "dimension_names": F.from_json(h("dimension_names"), "array<string>"),
            "sharded": v3 & F.coalesce(h("codecs").contains("sharding_indexed"), F.lit(False)),
            # only what gave no field at all can be no JSON
            "code": F.when(F.col(raw).isNotNull() & F.coalesce(h("shape"), h("zarr_format")).isNull() & F.try_parse_json(F.col(raw)).isNull(), "AUDIT_ERROR"),
        }
    ).drop("__h")


def multiscale(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Datasets of the first multiscales block, of either layout: (idx, path, scale, version)."""
    block = F.coalesce(F.get_json_object(raw, "$.multiscales[0]"), F.get_json_object(raw, "$.ome.multiscales[0]"))
    version = F.coalesce(F.get_json_object(raw, "$.ome.version"), F.get_json_object(block, "$.version"))
    kind = "array<struct<path:string,coordinateTransformations:array<struct<type:string,scale:array<double>,translation:array<double>>>>>"
    rows = rows.withColumns({"version": version, "datasets": F.from_json(F.get_json_object(block, "$.datasets"), kind)})
    each = rows.select(*(c for c in rows.columns if c not in ("datasets", raw)), F.posexplode("datasets").alias("idx", "d"))
    scales = F.filter("d.coordinateTransformations", lambda t: (t.type == "scale") & (F.size(t.scale) > 0))
    return each.withColumns({"path": F.coalesce(F.col("d.path"), F.col("idx").cast("string")), "declared_scale": F.get(scales, F.lit(0)).scale, "n_scale": F.coalesce(F.size(F.filter("d.coordinateTransformations", lambda t: t.type == "scale")), F.lit(0))}).drop("d")
