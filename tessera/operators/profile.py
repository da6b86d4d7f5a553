"""Per-field statistics from the histogram of distinct values: one shuffle by (field, value), then one by field.

The histogram of a flat table groups by the typed columns themselves (grouping
sets, COLUMNS of them a scan, which reads only those), so texts are made of
distinct values only and the aggregate is a hash one. Nested tables are flattened first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pystr import number
from .flatten import HIDDEN, cell, flatten, is_flat

EMPTY_VALUES = ("None", "", "NaN", "-", "N/A")
DICT_SHARE = 10.0
COLUMNS = 4  # of one scan: more make code that is too large to be compiled
CLASSES = ("digit", "alphas", "special")
STATS = tuple("key ftype is_dictkey is_uniq n_uniq share_uniq minlen maxlen avglen tags has_digit has_alphas has_special minval maxval has_any_digit has_any_alphas has_any_special dictvalues".split())


def histogram(long: DataFrame) -> DataFrame:
    """H: (field, kind, value, is_str, cnt, first_pos). All statistics and rule results are functions of it."""
    return long.groupBy("field", "kind", "value", "is_str").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))


def place(df: DataFrame, order_by: list[str] | None) -> tuple[Column, bool]:
    """A whole number that orders records as far as their first order_by column does, and whether that is all of their order."""
    if not order_by:
        return F.monotonically_increasing_id(), True
    c, kind = F.col(order_by[0]), df.schema[order_by[0]].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long"), len(order_by) == 1
    return F.lit(0).cast("long"), False


def typed_histogram(df: DataFrame, order_by: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """H of a flat table, (field, value) being unique; first_pos is the least place()."""
    used = [f for f in df.schema if f.name != HIDDEN and (fields is None or f.name in fields)]
    if not used:
        return histogram(flatten(df.select(F.lit(0).alias(HIDDEN)))).withColumn("num", F.lit(None).cast("double"))
    out = None
    for k in range(0, len(used), COLUMNS):
        one = _typed(df, place(df, order_by)[0], used[k : k + COLUMNS])
        out = one if out is None else out.union(one)
    return out


def _typed(df: DataFrame, p: Column, used: list[T.StructField]) -> DataFrame:
    base, sets = [p.alias("p")], []
    for k, f in enumerate(used):
        c = F.col(f"`{f.name}`")
        base.append(c.alias(f"c{k}"))
        own = [f"c{k}"]
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            base.append((F.coalesce(c == 0, F.lit(False)) & (F.atan2(c.cast("double"), F.lit(-1.0)) < 0)).alias(f"z{k}"))  # groups take -0.0 for 0.0
            own.append(f"z{k}")
        sets.append(own)
    keys = [c for own in sets for c in own]
    rows = df.select(base).groupingSets(sets, *keys).agg(F.count("*").alias("cnt"), F.min("p").alias("first_pos"), *[F.grouping(own[0]).alias(f"g{k}") for k, own in enumerate(sets)])
    one = None
    for k, (f, own) in enumerate(zip(used, sets)):
        c = F.col(own[0]) if len(own) == 1 else F.when(F.col(own[1]), F.lit(-0.0).cast(f.dataType)).otherwise(F.col(own[0]))
        # Numbers are measured as they are, not read back from their texts.
        num = F.lit(None).cast("double") if not isinstance(f.dataType, T.NumericType) or isinstance(f.dataType, T.DecimalType) else c.cast("double")
        x = F.struct(cell(f.name, c, f.dataType).alias("c"), num.alias("num"))
        one = F.when(F.col(f"g{k}") == 0, x) if one is None else one.when(F.col(f"g{k}") == 0, x)
    return rows.select(one.alias("x"), "cnt", "first_pos").select("x.c.field", "x.c.kind", "x.c.value", "x.c.is_str", "x.num", "cnt", "first_pos")


def field_stats(h: DataFrame, dict_share: float = DICT_SHARE, empty_values: tuple[str, ...] = EMPTY_VALUES, unique: bool = False, places: DataFrame | None = None, values: bool = True) -> DataFrame:
    """One row of STATS a field. Fields whose first path part is a number or one character long have none. unique: h has one row a (field, value). places: (field, text, p), where values were first seen, if h's first_pos doesn't tell. values=False leaves dictvalues out."""
    top = F.substring_index("field", ".", 1)
    h = h.where(~top.rlike(r"^\p{Nd}+$") & (F.length(top) != 1)).withColumn("text", F.coalesce("value", F.lit("None")))
    n, size = F.col("cnt"), F.length("text")
    chars = F.col("is_str") & (F.col("value") != "")
    num = F.when(F.col("kind").isin("int", "float"), F.when(F.col("is_str"), number(F.col("value"))).otherwise(F.col("num")) if "num" in h.columns else number(F.col("value")))
    num = F.when(~F.isnan(num), num)
    sure = lambda pattern: F.coalesce(F.sum(F.when(chars & F.col("value").rlike(pattern), n)), F.lit(0))
    stats = h.groupBy(F.col("field").alias("key")).agg(
        F.sum("cnt").alias("total"),
        # The missing value and the text None count as one.
        (F.count("*") - (F.bool_or(F.col("value").isNull()) & F.coalesce(F.bool_or(F.col("value") == "None"), F.lit(False))).cast("long") if unique else F.countDistinct("text")).alias("n_uniq"),
        F.collect_set(F.when(F.col("kind") != "empty", F.col("kind"))).alias("kinds"),
        F.min(size).alias("minlen"),
        F.max(size).alias("maxlen"),
        F.sum(size * n).alias("totallen"),
        sure(r"\p{Nd}").alias("has_digit"),
        sure(r"\p{L}").alias("has_alphas"),
        sure(r"[^\p{L}\p{N}\s]").alias("has_special"),
        F.min(num).alias("minval"),
        F.max(num).alias("maxval"),
        F.coalesce(F.sum(F.when(F.col("text").isin(*empty_values), n)), F.lit(0)).alias("n_empty"),
    )
    share = F.col("n_uniq") * 100.0 / F.col("total")
    key = share <= dict_share
    stats = stats.select(
        "key",
        F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("str").alias("ftype"),
        key.alias("is_dictkey"),
        (share >= 100).alias("is_uniq"),
        "n_uniq",
        share.alias("share_uniq"),
        "minlen",
        "maxlen",
        (F.col("totallen") / F.col("total")).alias("avglen"),
        F.array_compact(F.array(F.when(share == 100, "uniq"), F.when(key, F.when(F.col("n_empty") == F.col("total"), "empty").otherwise("dict")))).alias("tags"),
        *[f"has_{k}" for k in CLASSES],
        "minval",
        "maxval",
        *[(F.col(f"has_{k}") > 0).alias(f"has_any_{k}") for k in CLASSES],
    )
    if not values:
        return stats
    return stats.join(listed(dictionary(h, stats, places)), "key", "left")


def dictionary(h: DataFrame, stats: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(field, text, n, p): the values of the fields that are dictionaries, how often they occur and where first; a row a value, for tables of any size."""
    text = F.coalesce("value", F.lit("None"))
    few = h.join(stats.where("is_dictkey").select(F.col("key").alias("field")), "field", "left_semi").groupBy("field", text.alias("text")).agg(F.sum("cnt").alias("n"), F.min("first_pos").alias("p"))
    return few if places is None else few.drop("p").join(places, ["field", "text"])


def listed(words: DataFrame) -> DataFrame:
    """(key, dictvalues): the values of each dictionary in one list, as the report has them."""
    return words.groupBy(F.col("field").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]).alias("dictvalues"))


def first_places(df: DataFrame, h: DataFrame, stats: DataFrame, fields: list[str], order_by: list[str]) -> DataFrame:
    """(field, text, p): the first record, in the full order, of each value of the dictionaries. Only records whose first order column is the least of some value are looked at."""
    few = dictionary(h, stats)
    p = place(df, order_by)[0]
    rows = df.withColumn("__place", p).join(few.select(F.col("p").alias("__first")).distinct(), F.col("__place") == F.col("__first"), "left_semi").drop("__place")
    cells = flatten(rows, order_by, fields).select("field", F.coalesce("value", F.lit("None")).alias("text"), "pos")
    return cells.join(few.select("field", "text"), ["field", "text"], "left_semi").groupBy("field", "text").agg(F.min("pos").alias("p"))


def parts(df: DataFrame, order_by: list[str] | None = None, fields: list[str] | None = None, dict_share: float = DICT_SHARE, empty_values: tuple[str, ...] = EMPTY_VALUES) -> tuple[DataFrame, DataFrame]:
    """Statistics without dictvalues, computed, a row a field; and (key, dictvalues), still to be computed."""
    flat = is_flat(df.schema) and "__place" not in df.columns
    h = typed_histogram(df, order_by, fields) if flat else histogram(flatten(df, order_by, fields))
    rows = field_stats(h, dict_share, empty_values, unique=flat, values=False).toArrow()  # a row a field
    stats = df.sparkSession.createDataFrame(rows)
    if not flat:
        return stats, listed(dictionary(h, stats))
    # The values of dictionaries are looked up in those columns only.
    few = [k for k, is_key in zip(rows.column("key").to_pylist(), rows.column("is_dictkey").to_pylist()) if is_key]
    h = typed_histogram(df, order_by, few)
    places = None if not few or place(df, order_by)[1] else first_places(df, h, stats, few, order_by)
    return stats, listed(dictionary(h, stats, places))


def profile(df: DataFrame, order_by: list[str] | None = None, fields: list[str] | None = None, dict_share: float = DICT_SHARE, empty_values: tuple[str, ...] = EMPTY_VALUES) -> DataFrame:
    stats, words = parts(df, order_by, fields, dict_share, empty_values)
    return stats.join(words, "key", "left")
