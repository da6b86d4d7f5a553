"""Patterns induced from samples of identifiers: the shape of each value, runs folded, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape(v: Column) -> Column:
    """Digits as 9, capitals as A, other letters as a; the rest as it is."""
    v = F.regexp_replace(v, r"\p{Nd}", "9")
    v = F.regexp_replace(v, r"\p{Lu}", "A")
    return F.regexp_replace(v, r"[\p{L}&&[^A]]", "a")


def shapes(df: DataFrame, column: str) -> DataFrame:
    """(shape, n) of a column's values."""
    return df.where(F.col(column).isNotNull()).groupBy(shape(F.col(column)).alias("shape")).agg(F.count("*").alias("n"))


def pattern(of: str) -> str:
    """The regular expression that a shape stands for."""
    import re
    from itertools import groupby

    names = {"9": "[0-9]", "A": "[A-Z]", "a": "[a-z]"}
    out = []
    for c, run in groupby(of):
        n = len(list(run))
        out.append((names.get(c) or re.escape(c)) + (f"{{{n}}}" if n > 1 else ""))
    return "^" + "".join(out) + "$"


def induced(df: DataFrame, column: str, most: int = 8) -> DataFrame:
    """(pattern, n, examples): one regular expression for all values that differ only in the lengths or the letters of their runs.

    Values are grouped by the order of their runs (digits, capitals, other letters, signs). Within a group a run's length becomes a
    range, and a run of letters that takes at most `most` different forms, each of them more than once, is listed.
    """
    kinds = (("9", r"\p{Nd}+", "[0-9]"), ("A", r"\p{Lu}+", "[A-Z]"), ("a", r"[\p{L}&&[^\p{Lu}]]+", "[a-z]"))
    v = F.col(column)
    runs = F.regexp_extract_all(v, F.lit(r"(\p{Nd}+|\p{Lu}+|[\p{L}&&[^\p{Lu}]]+|[^\p{Nd}\p{L}])"), 1)
    sign = lambda r: F.when(r.rlike("^" + kinds[0][1]), "9").when(r.rlike("^" + kinds[1][1]), "A").when(r.rlike("^" + kinds[2][1]), "a").otherwise(r)
    rows = df.where(v.isNotNull() & (v != "")).select(v.alias("v"), runs.alias("runs")).withColumn("key", F.transform("runs", sign))
    each = rows.select("key", F.posexplode("runs").alias("i", "run"))
    forms = each.groupBy("key", "i", "run").agg(F.count("*").alias("n"))
    per = forms.groupBy("key", "i").agg(F.min(F.length("run")).alias("lo"), F.max(F.length("run")).alias("hi"), F.count("*").alias("forms"), F.min("n").alias("least"), F.array_sort(F.slice(F.collect_set(F.when(F.length("run") <= 40, F.col("run"))), 1, most)).alias("some"))
    kind = F.get("key", F.col("i"))
    body = F.when(kind == "9", kinds[0][2]).when(kind == "A", kinds[1][2]).when(kind == "a", kinds[2][2])
    times = F.when(F.col("lo") == F.col("hi"), F.when(F.col("lo") == 1, F.lit("")).otherwise(F.format_string("{%d}", F.col("lo")))).otherwise(F.format_string("{%d,%d}", F.col("lo"), F.col("hi")))
    listed = (kind != "9") & (F.col("forms") <= most) & (F.col("least") > 1) & (F.size("some") == F.col("forms"))
    part = F.when(body.isNull(), F.regexp_replace(kind, r"([^\p{L}\p{N}\s])", r"\\$1")).when(listed & (F.col("forms") == 1), F.get("some", F.lit(0))).when(listed, F.concat(F.lit("(?:"), F.array_join("some", "|"), F.lit(")"))).otherwise(F.concat(body, times))
    whole = per.select("key", "i", part.alias("part")).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("p"))
    size = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
    return whole.join(size, "key").select(F.concat(F.lit("^"), "p", F.lit("$")).alias("pattern"), "n", F.array_distinct(F.array("first", "last")).alias("examples"))
