"""Where reports go: filtered rows as tables, JSON, CSV, YAML or files."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADERS = ("key", "ftype", "tags", "labels", "datatype_url")


def displayed(report: DataFrame, mode: str = "short") -> DataFrame:
    """short: fields with a label; anything else: all."""
    return report.where(F.col("labels") != "") if mode == "short" else report


def result_rows(report: DataFrame) -> DataFrame:
    lead = [c for c in ("table",) if c in report.columns]
    return report.select(*lead, *HEADERS)


def joined(df: DataFrame) -> DataFrame:
    """Lists as text with commas, records as JSON."""

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.StructType):
            return F.array_join(c.cast("array<string>"), ",").alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(c).alias(f.name)
        return c
    return df.select(*map(one, df.schema))


def write(df: DataFrame, path: str, format: str = "json") -> None:
    """Distributed output: csv (with a header), json lines or parquet."""
    if format == "csv":
        joined(df).write.mode("overwrite").csv(path, header=True)
    elif format in ("json", "jsonl", "ndjson"):
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").format(format).save(path)


def document(df: DataFrame, format: str = "json", pretty: bool = False, indent: int = 2) -> str:
    """A report, a row a field, as one text: json, jsonl (a record a line), yaml, csv or table."""
    import json

    rows = [r.asDict(recursive=True) for r in df.collect()]
    if format == "jsonl":
        return "\n".join(json.dumps(r, ensure_ascii=False, default=str) for r in rows)
    if format == "json":
        return json.dumps(rows, ensure_ascii=False, default=str, indent=indent if pretty else None, sort_keys=pretty)
    if format == "yaml":
        import yaml

        return yaml.safe_dump(json.loads(json.dumps(rows, default=str)), allow_unicode=True, sort_keys=False)
    flat = [[",".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v) for v in r.values()] for r in rows]
    if format == "csv":
        import csv
        import io

        out = io.StringIO()
        csv.writer(out).writerows([df.columns, *flat])
        return out.getvalue()
    width = [max(map(len, c)) for c in zip(df.columns, *flat)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in [df.columns, ["-" * w for w in width], *flat])


def emit(text: str, output: str | None = None) -> None:
    """To a file, or to standard output for none, "-" and "stdout"."""
    if output in (None, "-", "stdout"):
        sys.stdout.write(text + "\n")
    else:
        Path(output).write_text(text + "\n", "utf8")
