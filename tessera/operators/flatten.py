"""Any DataFrame as one long table of (pos, field, kind, value): structs and maps extend the path, arrays of records are exploded, arrays of plain values dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pystr import python_str, value_kind

HIDDEN = "_id"


def cell(field: str | Column, c: Column, kind: T.DataType) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.struct(name.alias("field"), value_kind(c, kind).alias("kind"), python_str(c, kind).alias("value"), F.lit(isinstance(kind, T.StringType)).alias("is_str"))


def is_flat(schema: T.StructType) -> bool:
    return not any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in schema if f.name != HIDDEN)


def _walk(path: str, c: Column, kind: T.DataType) -> list[Column]:
    """Arrays of cells, one for each leaf; sibling arrays are exploded apart, never crossed."""
    if isinstance(kind, T.StructType):
        return [x for f in kind if f.name != HIDDEN for x in _walk(f"{path}.{f.name}" if path else f.name, c.getField(f.name), f.dataType)]
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, (T.StructType, T.MapType)):
            return []
        inner = lambda e: F.flatten(F.array(*_walk(path, e, kind.elementType)))
        return [F.flatten(F.transform(F.coalesce(c, F.array().cast(kind)), inner))] if _walk(path, c.getItem(0), kind.elementType) else []
    if isinstance(kind, T.MapType):
        if isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)):
            return []
        entries = F.map_entries(F.coalesce(c, F.create_map().cast(kind)))
        entries = F.filter(entries, lambda e: e["key"] != HIDDEN)
        return [F.transform(entries, lambda e: cell(F.concat_ws(".", F.lit(path), e["key"].cast("string")), e["value"], kind.valueType))]
    return [F.array(cell(path, c, kind))]


def flatten(df: DataFrame, order_by: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """(pos, field, kind, value, is_str). pos orders records: the order_by columns, or the order of the rows as read."""
    pos = F.struct(*order_by) if order_by else F.monotonically_increasing_id()
    tops = {f.split(".")[0] for f in fields or ()}  # other columns aren't read
    cells = [x for f in df.schema if f.name != HIDDEN and (not fields or "." in f.name or f.name in tops) for x in _walk(f.name, F.col(f"`{f.name}`"), f.dataType)]
    none = F.array().cast("array<struct<field:string,kind:string,value:string,is_str:boolean>>")
    rows = df.select(pos.alias("pos"), (F.flatten(F.array(*cells)) if cells else none).alias("cells"))
    long = rows.select("pos", F.explode("cells").alias("c")).select("pos", "c.*")
    return long.where(F.col("field").isin(*fields)) if fields else long


def _depth(kind: str) -> int:
    """How deep records and lists nest in a variant schema."""
    deep = most = 0
    for c in kind:
        deep += (c == "<") - (c == ">")
        most = max(most, deep)
    return most


def flatten_json(df: DataFrame, column: str, order_by: list[str] | None = None) -> DataFrame:
    """The same for a VARIANT column of ragged records: a missing key gives nothing, an explicit null the kind empty."""
    pos = F.struct(*order_by) if order_by else F.monotonically_increasing_id()
    # One pass finds the depth of the data; the levels are then one plan.
    levels = _depth(df.select(F.schema_of_variant_agg(column)).first()[0] or "")
    at = df.select(pos.alias("pos"), F.lit("").alias("field"), F.col(column).alias("v"))
    explode, out = df.sparkSession.tvf.variant_explode, None
    for level in range(levels + 1):
        k = F.schema_of_variant("v")
        record, listed = k.startswith("OBJECT"), k.startswith("ARRAY")
        text = F.col("v").cast("string")
        value = F.when(k == "BOOLEAN", F.initcap(text)).when(k == "VOID", F.lit(None)).otherwise(text)
        kinds = F.when(k == "VOID", "empty").when(k == "BOOLEAN", "bool").when(k == "BIGINT", "int").when((k == "DOUBLE") | k.startswith("DECIMAL"), "float").otherwise(value_kind(value, T.StringType()))
        leaf = at.where(~(record | listed) & (F.col("field") != "")).select("pos", "field", kinds.alias("kind"), value.alias("value"), (k == "STRING").alias("is_str"))
        out = leaf if out is None else out.union(leaf)
        if level == levels:
            break
        each = at.where(record | listed).select("pos", "field", "v", record.alias("record")).lateralJoin(explode(F.col("v").outer()).toDF("n", "key", "x"))
        path = F.when(F.col("record"), F.concat_ws(".", F.nullif("field", F.lit("")), F.col("key"))).otherwise(F.col("field"))
        # Of a list's elements only records count; values in lists are dropped.
        use = F.when(F.col("record"), F.coalesce(F.col("key") != HIDDEN, F.lit(False))).otherwise(F.schema_of_variant("x").startswith("OBJECT"))
        at = each.where(use).select("pos", path.alias("field"), F.col("x").alias("v"))
    return out


def headers(long: DataFrame, limit: int | None = 1000) -> DataFrame:
    """(field, ord): the fields of the first limit records, numbered as first seen. Of a table, first_headers() cuts the records before they are flattened."""
    if limit is not None:
        first = long.groupBy("pos").agg(F.lit(1).alias("one")).select("pos").orderBy("pos").limit(limit)  # a top-k: nothing is sorted as a whole
        long = long.join(F.broadcast(first), "pos", "left_semi")  # limit rows
    seen = long.groupBy("field").agg(F.min("pos").alias("p"))
    return seen.selectExpr("field", "row_number() over (order by p, field) as ord")


def first_headers(df: DataFrame, limit: int = 1000, order_by: list[str] | None = None) -> DataFrame:
    """The same of a table: only its first limit records are flattened."""
    return headers(flatten(first_records(df, limit, order_by), order_by), None)


def extract(value: Column, schema: T.DataType, keys: list[str]) -> Column:
    """All values at a path, collected through arrays."""
    if not keys:
        return F.array(value)
    if isinstance(schema, T.ArrayType):
        return F.flatten(F.transform(value, lambda e: extract(e, schema.elementType, keys)))
    return extract(value.getField(keys[0]), schema[keys[0]].dataType, keys[1:])


def first_values(long: DataFrame, limit: int) -> DataFrame:
    """The first limit values of each field. Of a table, first_cells() has them at less cost."""
    return long.selectExpr("*", "row_number() over (partition by field order by pos) as nth").where(F.col("nth") <= limit).drop("nth")


def first_records(df: DataFrame, limit: int, order_by: list[str] | None = None) -> DataFrame:
    """The first limit records: a top-k, so that nothing is sorted as a whole and no more than limit rows a task are sent."""
    return df.orderBy(*order_by).limit(limit) if order_by else df.limit(limit)


def first_cells(df: DataFrame, limit: int, order_by: list[str] | None = None) -> DataFrame:
    """The first limit values of each field of a table. A flat one has every field in each record, so these are its first records; records of a nested one are all flattened."""
    return flatten(first_records(df, limit, order_by), order_by) if is_flat(df.schema) else first_values(flatten(df, order_by), limit)


def char_histogram(df: DataFrame, column: str) -> DataFrame:
    """(char, n) over all texts."""
    return df.select(F.explode(F.split(column, "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))
