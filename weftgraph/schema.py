"""Tables of the knowledge model, their storage names and the projection that loads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ids = "array<string>"
_DDL = {
    "documents": f"id string, text string, title string, text_unit_ids {_ids}, metadata map<string,string>, ord bigint",
    "chunks": f"id string, text string, embedding array<float>, metadata map<string,string>, document_id string, entity_ids {_ids}, relationship_ids {_ids}, covariate_ids {_ids}, n_tokens int, chunk_index int, unit_ord decimal(38,0)",
    "entities": f"id string, title string, type string, description string, description_embedding array<float>, text_unit_ids {_ids}, community_ids {_ids}, rank double, norm_title string, ord decimal(38,0)",
    "relationships": f"id string, source string, target string, description string, weight double, text_unit_ids {_ids}, rank double, norm_source string, norm_target string, ord decimal(38,0)",
    "covariates": f"id string, subject string, object string, type string, status string, description string, start_date string, end_date string, text_unit_ids {_ids}, norm_subject string, ord decimal(38,0)",
    "communities": f"id string, level int, parent string, entity_ids {_ids}, title string, children {_ids}, ord bigint",
    "reports": f"id string, community_id string, level int, title string, summary string, full_content string, rank double, embedding array<float>, entity_ids {_ids}, ord bigint",
    "entity_edges": "src_id string, dst_id string, description string, weight double",
}
_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "decimal(38,0)": T.DecimalType(38, 0), _ids: T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}
#: Parsed here, as Spark's own parser needs a running session.
SCHEMAS: dict[str, T.StructType] = {name: T.StructType([T.StructField(*f.split(" ")[:1], _TYPES[f.split(" ")[1]]) for f in ddl.split(", ")]) for name, ddl in _DDL.items()}
#: Values of columns that a stored row lacks or has as null.
DEFAULTS = {("entities", "type"): "UNKNOWN", ("entities", "rank"): 1.0, ("relationships", "weight"): 1.0, ("relationships", "rank"): 1.0, ("covariates", "type"): "claim", ("covariates", "status"): "TRUE"}


def base_name(name: str) -> str:
    """A storage name without the suffix of one of its tables, should it have been given with one."""
    name = (name or "").strip()
    for table in sorted(SCHEMAS, key=len, reverse=True):
        if name.endswith("_" + table) and len(name) > len(table) + 1:
            return name[: -len(table) - 1]
    return name


def table_names(name: str) -> dict[str, str]:
    return {table: f"{base_name(name)}_{table}" for table in SCHEMAS}


def safe_key(column: Column) -> Column:
    """A storage key: other signs than letters, digits, - and _ become _; 64 characters at most."""
    return F.substring(F.regexp_replace(column, r"[^\p{L}\p{N}_-]", "_"), 1, 64)


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Rows with exactly the columns of a table: unknown ones dropped, missing or null ones at their default.

    An id falls back to the column _key.
    """
    have, made = set(rows.columns), []
    for field in SCHEMAS[table].fields:
        name, kind = field.name, field.dataType
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if name == "id" and "_key" in have:
            value = F.coalesce(value, F.col("_key").cast("string"))
        if (table, name) in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[table, name]))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            value = F.coalesce(value, F.array().cast(kind))
        elif isinstance(kind, T.StringType) and name not in ("id", "parent", "document_id") and not name.startswith("norm_"):
            value = F.coalesce(value, F.lit(""))
        made.append(value.alias(name))
    return rows.select(*made)


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
