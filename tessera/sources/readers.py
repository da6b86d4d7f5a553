"""Files, folders, databases and archives as DataFrames of strings or typed columns."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = "avro bson csv json jsonl ndjson orc parquet tsv xls xlsx xml".split()
CODECS = "br bz2 gz lz4 snappy xz zip zst".split()
BINARY = ("bson", "parquet", "orc", "avro", "xls", "xlsx")
HADOOP_CODECS = ("gz", "bz2", "snappy", "lz4", "zst")
CHARSETS = ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32")  # what Spark's own text readers decode
DELIMITERS = (",", ";", "\t", "|")


class FormatError(ValueError):
    """A file whose format or codec can't be read here."""


def file_format(path: str) -> tuple[str | None, str | None]:
    """(format, codec) by the file's extensions; None where there is none that is known."""
    parts = PurePosixPath(path.lower()).name.split(".")[1:]
    codec = parts.pop() if parts and parts[-1] in CODECS else None
    return (parts[-1] if parts and parts[-1] in FORMATS else None), codec


def is_supported(path: str) -> bool:
    return file_format(path)[0] is not None


BOMS = ((b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: How often Russian letters come, in lower case; the code page under which a text's letters fit it best is taken.
_RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_CYRILLIC = ("windows-1251", "koi8-r", "cp866", "iso-8859-5")


def encoding_of(raw: bytes) -> str:
    """By the byte order mark; by zero bytes, UTF-16; utf-8 if the bytes are that (an end cut short apart); else a Cyrillic code page if most high bytes are frequent letters in it; else windows-1252 if it has its printed signs, else latin-1."""
    for mark, name in BOMS:
        if raw.startswith(mark):
            return name
    even, odd = raw[::2].count(0), raw[1::2].count(0)
    if len(raw) > 3 and max(even, odd) > 0.3 * len(raw) / 2:
        return "utf-16be" if even > odd else "utf-16le"
    for cut in range(4):
        try:
            raw[: len(raw) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    high = bytes(b for b in raw if b >= 0x80)
    weight = {c: 1 / (k + 1) for k, c in enumerate(_RUSSIAN)}

    def fit(name: str) -> float:
        text = high.decode(name, "replace")
        return sum(weight.get(c, 0.02 if c.lower() in weight else -0.5) for c in text)

    best = max(_CYRILLIC, key=fit)
    # Letters of a Cyrillic word stand together, accented ones of a Latin word mostly alone.
    together = sum(a >= 0x80 and b >= 0x80 for a, b in zip(raw, raw[1:]))
    if fit(best) > 0.05 * len(high) and together > 0.4 * len(high):
        return best
    return "windows-1252" if any(0x80 <= b < 0xA0 for b in high) else "iso-8859-1"


def delimiter_of(line: str) -> str:
    """The delimiter that the line has most of; of equals the first of comma, semicolon, tab, bar."""
    return max(DELIMITERS, key=line.count)


def spans_lines(text: str, delimiter: str) -> bool:
    """Whether a quoted cell of the CSV text holds a line feed."""
    open_, start = False, True
    for c in text:
        if c == '"' and (open_ or start):
            open_ = not open_
        elif c == "\n" and open_:
            return True
        start = c in (delimiter, "\n")
    return False


def head(spark: SparkSession, path: str, size: int = 1_000_000) -> bytes:
    """The first bytes of a file, or of the first file of a folder or pattern, read through the file system's stream; the rest isn't touched."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    files = sorted(str(f.getPath()) for f in found or ())
    if files and fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(files[0])).isDirectory():
        files = sorted(str(f.getPath()) for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(files[0])) if not f.getPath().getName().startswith(("_", ".")))
    if not files:
        return b""
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(files[0]))
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def record_tag(xml: bytes) -> str | None:
    """The first element, from the top and level by level, that repeats under one parent."""
    import xml.etree.ElementTree as ET

    level = [ET.fromstring(xml)]
    while level:
        below = []
        for e in level:
            names = [c.tag.rsplit("}", 1)[-1] for c in e]
            for n in names:
                if names.count(n) > 1:
                    return n
            below += list(e)
        level = below
    return None


def decompressed(raw: bytes, codec: str | None) -> bytes:
    if codec == "xz":
        return lzma.decompress(raw)
    if codec == "zip":
        z = zipfile.ZipFile(io.BytesIO(raw))
        return z.read(z.namelist()[0])
    if codec == "gz":
        return gzip.decompress(raw)
    if codec == "bz2":
        return bz2.decompress(raw)
    if codec is None:
        return raw
    if codec == "br":
        try:
            import brotli
        except ImportError as e:
            raise FormatError("codec br needs the package brotli") from e
        return brotli.decompress(raw)
    if codec == "zst":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw).read()
    raise FormatError(f"codec {codec} can't be read here")


def decoded(spark: SparkSession, path: str, codec: str | None, encoding: str) -> DataFrame:
    """(content): the texts of files in codecs or encodings that Spark doesn't read, each file in a task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for raw in p["content"]:
                yield pd.DataFrame({"content": [decompressed(raw, codec).decode(encoding, "replace")]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "content string")


def csv_records(spark: SparkSession, path: str, codec: str | None, encoding: str, delimiter: str | None, tabs: bool) -> DataFrame:
    """CSV in codecs or encodings that Spark doesn't read: a record may span lines, and only the first one of each file names columns. Rows that are too short are filled with empty cells, more cells get names by number."""
    import csv

    texts = decoded(spark, path, codec, encoding)
    first = texts.select(F.substring("content", 1, 100_000).alias("c")).first()
    top = (first.c if first else "").lstrip("\ufeff")
    sep = delimiter or ("\t" if tabs else delimiter_of(top.split("\n", 1)[0]))
    names = column_names(next(csv.reader(io.StringIO(top), delimiter=sep), []))
    if not names:
        return spark.range(0).select()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        for p in parts:
            for text in p["content"]:
                rows: list[list[str]] = []
                for k, r in enumerate(csv.reader(io.StringIO(text.lstrip("\ufeff"), newline=""), delimiter=sep)):
                    if k and r:
                        rows.append((r + [""] * len(names))[: len(names)])
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return texts.mapInPandas(run, ", ".join("`" + n.replace("`", "``") + "` string" for n in names))


def column_names(cells: list[str]) -> list[str]:
    """Names of columns: one without a name is col_i by its place, a repeated one gets its place, too."""
    out: list[str] = []
    for k, c in enumerate(cells):
        name = c.strip() or f"col_{k}"
        out.append(name if name not in out else f"{name}_{k}")
    return out


def _unpacked_lines(spark: SparkSession, path: str, codec: str | None, encoding: str) -> DataFrame:
    """Lines of such files."""
    return decoded(spark, path, codec, encoding).select(F.explode(F.split("content", "\r?\n")).alias("value")).where("trim(value) <> ''")


def json_frame(df: DataFrame, column: str) -> DataFrame:
    """The records in a column of JSON texts, with the schema that all of them share."""
    kind = df.select(F.schema_of_variant_agg(F.parse_json(column))).first()[0] or ""
    if not kind.startswith("OBJECT<"):
        return df.select().limit(0)
    return df.select(F.from_json(column, kind.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")).alias("r")).select("r.*")


def read_bson(spark: SparkSession, path: str) -> DataFrame:
    """A column v of VARIANT records."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for raw in p["content"]:
                yield pd.DataFrame({"j": list(bson_json(bytes(raw)))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "j string").select(F.parse_json("j").alias("v"))


def bson_json(raw: bytes) -> Iterator[str]:
    """Each document of a BSON dump as JSON."""
    import json
    import struct

    def cstring(at: int) -> tuple[str, int]:
        end = raw.index(b"\0", at)
        return raw[at:end].decode("utf-8", "replace"), end + 1

    def document(at: int, listed: bool):
        end = at + struct.unpack_from("<i", raw, at)[0] - 1
        at += 4
        out: dict = {}
        while at < end:
            kind = raw[at]
            name, at = cstring(at + 1)
            if kind == 1:
                v, at = struct.unpack_from("<d", raw, at)[0], at + 8
            elif kind in (2, 13, 14):
                n = struct.unpack_from("<i", raw, at)[0]
                v, at = raw[at + 4 : at + 3 + n].decode("utf-8", "replace"), at + 4 + n
            elif kind in (3, 4):
                v, size = document(at, kind == 4), struct.unpack_from("<i", raw, at)[0]
                at += size
            elif kind == 5:
                n = struct.unpack_from("<i", raw, at)[0]
                v, at = raw[at + 5 : at + 5 + n].hex(), at + 5 + n
            elif kind == 7:
                v, at = raw[at : at + 12].hex(), at + 12
            elif kind == 8:
                v, at = bool(raw[at]), at + 1
            elif kind == 9:
                ms = struct.unpack_from("<q", raw, at)[0]
                v, at = str(pd.Timestamp(ms, unit="ms")), at + 8
            elif kind == 10:
                v = None
            elif kind == 16:
                v, at = struct.unpack_from("<i", raw, at)[0], at + 4
            elif kind in (17, 18):
                v, at = struct.unpack_from("<q", raw, at)[0], at + 8
            elif kind == 19:
                v, at = raw[at : at + 16].hex(), at + 16
            else:
                raise FormatError(f"BSON element of type {kind}")
            out[name] = v
        return list(out.values()) if listed else out

    at = 0
    while at + 4 <= len(raw):
        yield json.dumps(document(at, False))
        at += struct.unpack_from("<i", raw, at)[0]


def read_file(spark: SparkSession, path: str, format: str | None = None, delimiter: str | None = None, encoding: str | None = None, tag: str | None = None, codec: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """A file or files of one format. Text formats keep every value a string, with empty cells empty strings; the first line of a file names the columns.

    multi_line: whether CSV cells hold line feeds. Files without such cells are split among tasks. None looks at the file's beginning.
    """
    known, packed = file_format(path)
    format, codec = format or known, codec if codec is not None else packed
    if format in ("csv", "tsv"):
        top = b"" if codec else head(spark, path)
        encoding = encoding or (encoding_of(top) if top else "utf-8")
        if codec and codec not in HADOOP_CODECS or encoding.lower() not in CHARSETS:
            return csv_records(spark, path, codec, encoding, delimiter, format == "tsv")
        if not delimiter:
            line = top.decode(encoding, "replace").split("\n", 1)[0] if top else spark.read.text(path).limit(1).first()
            line = line if isinstance(line, str) else (line.value if line else "")
            delimiter = "\t" if format == "tsv" else delimiter_of(line)
        if multi_line is None:
            multi_line = spans_lines(top.decode(encoding, "replace"), delimiter)
        df = spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, inferSchema=False, multiLine=multi_line, escape='"')
        return df.toDF(*column_names([c if not c.startswith("_c") else "" for c in df.columns])).na.fill("")
    if format == "json":
        return spark.read.json(path, multiLine=True)
    if format in ("jsonl", "ndjson"):
        if codec and codec not in HADOOP_CODECS:
            return json_frame(_unpacked_lines(spark, path, codec, encoding or "utf-8"), "value")
        return spark.read.json(path)
    if format in ("parquet", "orc"):
        return spark.read.format(format).load(path)
    if format == "xml":
        return spark.read.format("xml").options(rowTag=tag or record_tag(head(spark, path)) or "row", attributePrefix="@", valueTag="#text", inferSchema="false").load(path)
    if format == "avro":
        return spark.read.format("avro").load(path)
    if format == "bson":
        return read_bson(spark, path)
    if format in ("xls", "xlsx"):
        frame = pd.read_excel(path.removeprefix("file://"), dtype=str)
        return spark.createDataFrame(frame.fillna(""))
    raise FormatError(f"{path}: no format that is known")


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as a VARIANT column v, which keeps missing keys apart from nulls."""
    return spark.read.option("singleVariantColumn", "v").json(path)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """All files under a folder whose format is known, by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").orderBy("path").toLocalIterator()
    return [r.path for r in rows if is_supported(r.path)]


def read_table(spark: SparkSession, url: str, table: str, limit: int | None = 1000, batch_size: int = 1000, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table over JDBC; the limit is pushed down."""
    df = spark.read.jdbc(url, table, properties={"fetchsize": str(batch_size), **(properties or {})})
    return df if limit is None else df.limit(limit)


def database_tables(spark: SparkSession, url: str, schema: str | None = None, properties: dict[str, str] | None = None) -> list[str]:
    """Schema-qualified names of a database's tables."""
    if schema is not None and not schema.replace("_", "").replace(".", "").isalnum():
        raise ValueError(f"not a schema name: {schema!r}")
    rows = spark.read.jdbc(url, "information_schema.tables", properties=properties or {})
    rows = rows.where(F.col("table_schema") == schema) if schema else rows.where(~F.lower("table_schema").isin("information_schema", "pg_catalog"))
    return [f"{r.table_schema}.{r.table_name}" for r in rows.select("table_schema", "table_name").orderBy("table_schema", "table_name").collect()]


def mongo_uri(host: str = "localhost", port: int = 27017, user: str | None = None, password: str | None = None) -> str:
    if host.startswith("mongodb"):
        return host
    who = f"{quote(user, safe='')}:{quote(password or '', safe='')}@" if user else ""
    return f"mongodb://{who}{host}:{port}/"


def mongo_collections(spark: SparkSession, uri: str, database: str) -> list[str]:
    """All collections of a database, by the driver that the Spark connector brings."""
    client = spark._jvm.com.mongodb.client.MongoClients.create(uri)
    try:
        names = client.getDatabase(database).listCollectionNames().into(spark._jvm.java.util.ArrayList())
        return sorted(str(n) for n in names if not str(n).startswith("system."))
    finally:
        client.close()


def read_mongo(spark: SparkSession, uri: str, database: str, collection: str, limit: int | None = 1000) -> DataFrame:
    """A MongoDB collection; needs the Spark connector on the class path. The limit is part of the connector's pipeline, so no more is read."""
    pipeline = {} if limit is None else {"aggregation.pipeline": f"[{{'$limit': {limit}}}]"}
    return spark.read.format("mongodb").options(**{"connection.uri": uri, "database": database, "collection": collection, **pipeline}).load()


# Embedded databases: no server and no JDBC driver, so the driver reads the first rows of each table.


def embedded_tables(url: str, schema: str | None = None) -> list[str]:
    """Tables of a file of DuckDB (duckdb:///path) or SQLite (sqlite:///path); of DuckDB those of one schema, main if none is given."""
    kind, at = url.split(":///", 1)
    if kind == "duckdb":
        import duckdb

        with duckdb.connect(at, read_only=True) as con:
            return [r[0] for r in con.execute("select table_name from information_schema.tables where table_schema = ? order by 1", [schema or "main"]).fetchall()]
    import sqlite3

    with sqlite3.connect(at) as con:
        return [r[0] for r in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by 1")]


def read_embedded(spark: SparkSession, url: str, table: str, limit: int | None = 1000, schema: str | None = None, batch_size: int = 1000) -> DataFrame:
    """A table of such a file. Texts of SQLite that aren't UTF-8 have what can't be read replaced; its columns may hold values of any kind, so they are read as texts where kinds are mixed."""
    kind, at = url.split(":///", 1)
    name = '"' + table.replace('"', '""') + '"'
    most = "" if limit is None else f" limit {int(limit)}"
    if kind == "duckdb":
        import duckdb

        with duckdb.connect(at, read_only=True) as con:
            where = '"' + (schema or "main").replace('"', '""') + '".'
            return spark.createDataFrame(con.execute(f"select * from {where}{name}{most}").to_arrow_table())
    import sqlite3

    with sqlite3.connect(at) as con:
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        cur = con.execute(f"select * from {name}{most}")
        names = column_names([c[0] for c in cur.description])
        rows: list[tuple] = []
        while some := cur.fetchmany(batch_size):
            rows += some
    kinds = []
    for k in range(len(names)):
        found = {type(r[k]) for r in rows} - {type(None)}
        kinds.append("bigint" if found == {int} else "double" if found and found <= {int, float} else "binary" if found == {bytes} else "string")
    fit = {"bigint": lambda v: v, "double": float, "binary": lambda v: v, "string": lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)}
    rows = [tuple(None if v is None else fit[kind](v) for v, kind in zip(r, kinds)) for r in rows]
    return spark.createDataFrame(rows, ", ".join("`" + n.replace("`", "``") + f"` {kind}" for n, kind in zip(names, kinds)))


def copy_to_sqlite(source: str, target: str, schema: str | None = None, batch_size: int = 10_000) -> dict[str, int]:
    """All tables of a DuckDB file written to a SQLite file, in batches; the rows of each."""
    import sqlite3

    import duckdb

    out = {}
    with duckdb.connect(source, read_only=True) as con, sqlite3.connect(target) as to:
        for t in embedded_tables(f"duckdb:///{source}", schema):
            quoted = '"' + t.replace('"', '""') + '"'
            cur = con.execute(f'select * from "{schema or "main"}".{quoted}')
            columns = [c[0] for c in cur.description]
            kinds = {"BIGINT": "INTEGER", "INTEGER": "INTEGER", "SMALLINT": "INTEGER", "TINYINT": "INTEGER", "HUGEINT": "INTEGER", "BOOLEAN": "INTEGER", "DOUBLE": "REAL", "FLOAT": "REAL", "BLOB": "BLOB"}
            types = [kinds.get(str(c[1]).split("(")[0].upper(), "TEXT") for c in cur.description]
            to.execute(f"drop table if exists {quoted}")
            to.execute(f"create table {quoted} (" + ", ".join('"' + c.replace('"', '""') + f'" {k}' for c, k in zip(columns, types)) + ")")
            n = 0
            while rows := cur.fetchmany(batch_size):
                plain = [tuple(v if v is None or isinstance(v, (int, float, str, bytes)) else str(v) for v in r) for r in rows]
                to.executemany(f"insert into {quoted} values (" + ", ".join("?" * len(columns)) + ")", plain)
                n += len(rows)
            out[t] = n
    return out


def lenient_text(c):
    """Bytes as UTF-8 text, what can't be decoded replaced."""
    return F.make_valid_utf8(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
