"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches. A run is a sorted, hash-bucketed table of 128-bit
hashes of lines seen before. Each batch finds the first place of each of its
own lines (combined in the tasks before the shuffle, so a hot line is a row a
task), merge-anti-joins the runs bucket by bucket (the runs aren't shuffled: the
batch is shuffled into their buckets), and writes what is left as a run of
level 0. FANOUT runs of a level are compacted into one of the next, so a batch
meets at most FANOUT - 1 runs a level and levels grow with the logarithm of the
number of batches.

The runs live in a LineIndex: a folder with a manifest, which a later session
opens again to append its batch. A run counts once the manifest names it; the
manifest is replaced by a rename after the run is written, so a job that dies
leaves the index as it was. deduplicated() takes one table in BATCHES ranges of
doc_id through an index of its own.

A line's first place by (batch, doc_id, line number) stays; later ones go.
Lines are compared without the blanks (space, tab, carriage return) around
them; blank lines always stay, and so does the text of every line that stays.

Defined results: a null text stays null and an empty one empty, with nothing
removed; a document that loses all lines has an empty text; rows with a null
doc_id come last, in the last batch, and share their lines like any other;
identical repeated rows are one document and leave one row; different texts
under one doc_id are told apart by hash, in its order. doc_ids may be any 64-bit
numbers. A very long text is cut at its line feeds only. An empty table gives an
empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _file_system, cut, owned, scratch, settings, table, written

BATCHES = 8
FANOUT = 4
BLANKS = " \t\r"
BUCKET_ROWS = 4_000_000  # hashes in a bucket of the first run: about 64 MB
MANIFEST = "manifest.json"


class LineIndex:
    """Runs by level, in a folder; buckets and fanout are those it was made with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), {}
        found = self._read()
        self.buckets = found.get("buckets", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.fanout: int = found.get("fanout", fanout)
        self.levels: list[list[str]] = found.get("levels", [[]])

    def _read(self) -> dict:
        fs, p = _file_system(self.spark, f"{self.path}/{MANIFEST}")
        if not fs.exists(p):
            return {}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(str(p.toString())).collect()))  # one small file

    def _save(self) -> None:
        fs, p = _file_system(self.spark, f"{self.path}/{MANIFEST}")
        _, new = _file_system(self.spark, f"{self.path}/{MANIFEST}.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "fanout": self.fanout, "levels": self.levels}), "utf8"))
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(new, p)

    def _write(self, df: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        name = f"lines_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", f"{self.path}/{run}").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.tables[run] = name
        return run

    def _run(self, run: str) -> DataFrame:
        if run not in self.tables:
            name = f"lines_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {name} (h1 bigint, h2 bigint) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{self.path}/{run}'")
            self.tables[run] = name
        return self.spark.table(self.tables[run])

    def unseen(self, lines: DataFrame) -> DataFrame:
        """lines (h1, h2, at) without those of any run."""
        for run in (r for level in self.levels for r in level):
            old = self._run(run).selectExpr("h1 as r1", "h2 as r2")
            lines = lines.join(old.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        self.levels[0].append(self._write(lines.select("h1", "h2").repartition(self.buckets, "h1", "h2")))
        level, gone = 0, []
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self._run(old[0])
            for run in old[1:]:
                merged = merged.union(self._run(run))
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged.repartition(self.buckets, "h1", "h2")))
            self.levels[level] = []
            gone += old
            level += 1
        self._save()
        self._forget(gone)
        for run in gone:
            fs, p = _file_system(self.spark, f"{self.path}/{run}")
            fs.delete(p, True)

    def _forget(self, runs: Iterable[str]) -> None:
        for run in list(runs):
            if name := self.tables.pop(run, None):
                self.spark.sql(f"drop table if exists {name}")

    def close(self) -> None:
        """Forget the tables; the files and the manifest stay."""
        self._forget(list(self.tables))

    def first_places(self, lines: DataFrame, last: bool = False) -> DataFrame:
        """(doc_id, u, pos) of the lines that nothing before them has; they are added to the runs, unless this batch is the last."""
        # Nulls sort last, so a null doc_id is later than any other.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "u", "pos")).alias("at")
        with settings(self.spark, spark__sql__shuffle__partitions=str(self.buckets)):  # the shuffle of the groups makes the runs' buckets
            new = cut(self.unseen(lines.groupBy("h1", "h2").agg(first)), "new")
        if not last:
            self.add(new)
        return new.select("at.doc_id", "at.u", "at.pos")

    @owned
    def append(self, docs: DataFrame) -> DataFrame:
        """docs as one batch: what deduplicated() gives, against all lines of the batches before, which then hold these too."""
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        lines = cut(lines_of(docs), "lines")
        return rest(docs, self.first_places(lines))


def lines_of(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, u, pos, h1, h2, more...) of every line that isn't blank; u is the hash of the whole text."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("u"), *more, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(BLANKS))
    return lines.where(line != "").withColumns({"h1": F.xxhash64(line), "h2": F.xxhash64(line, F.lit(1))}).drop("line")


def rest(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of docs (doc_id, text), of which the lines at kept (doc_id, u, pos) stay."""
    kept = kept.groupBy("doc_id", "u").agg(F.array_sort(F.collect_list("pos")).alias("at"))  # the lines of one text
    # A byte for each line up to the last that stays, so looking one up takes no search.
    mask = "cast(array_join(transform(at, (p, i) -> concat(repeat('0', p - if(i = 0, -1, at[greatest(i - 1, 0)]) - 1), '1')), '') as binary)"
    kept = cut(kept.selectExpr("doc_id", "u", f"{mask} as stay"), "kept")
    whole = docs.withColumn("u", F.xxhash64("text"))
    same = whole["doc_id"].eqNullSafe(kept["doc_id"]) & (whole["u"] == kept["u"])
    out = whole.join(kept, same, "left").select(whole["doc_id"], whole["u"], "text", "stay").withColumn("parts", F.split("text", "\n"))
    out = out.withColumn("left", F.expr(f"filter(parts, (l, i) -> btrim(l, '{BLANKS}') = '' or substring(stay, i + 1, 1) <=> X'31')".replace("\t", "\\t").replace("\r", "\\r")))
    out = out.select("doc_id", "u", F.array_join("left", "\n").alias("text"), F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"), F.expr("cast(coalesce(size(parts) - size(left), 0) as long)").alias("n_removed"))
    return out.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).dropDuplicates(["doc_id", "u"]).drop("u")


@owned
def deduplicated(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, buckets: int | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): each document with the text that is left, its lines and how many of them went."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    lo, hi = lo or 0, hi or 0
    # Bounds of equal ranges; Python's whole numbers don't overflow.
    batch = sum((F.coalesce((F.col("doc_id") >= F.lit(lo + (hi - lo) * k // batches + 1)).cast("int"), F.lit(1)) for k in range(1, batches)), F.lit(0))
    path = scratch(spark, "lines")
    lines = lines_of(docs, batch.cast("int").alias("batch"))
    written(lines, path, by="batch")
    lines = spark.read.schema(lines.schema).parquet(path)
    rows = lines.count()
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // batches // BUCKET_ROWS + 1)
    index, kept = LineIndex(spark, scratch(spark, "runs"), buckets, fanout), None
    for k in range(batches):
        places = index.first_places(lines.where(F.col("batch") == k).drop("batch"), last=k == batches - 1)
        kept = places if kept is None else kept.union(places)
    out = rest(docs, kept)
    index.close()
    return out


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {
    "op6_line_dedup": r"""
with parts as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
lines as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from parts),
ranked as (select *, trim(line, ' ' || chr(9) || chr(13)) as t, row_number() over (partition by trim(line, ' ' || chr(9) || chr(13)) order by doc_id, pos) as k from lines)
select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where t = '' or k = 1), '') as text, count(*) as n_lines, count(*) filter (where t <> '' and k > 1) as n_removed from ranked group by doc_id"""
}
