"""Fields classified by a model that is shown the nearest entries of a registry; the persisted index of these.

All fields go through as one DataFrame: their texts are embedded, the nearest
entries joined, the prompts asked and the answers parsed in tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scan import BASE_URL
from . import registry, retrieve

TOP = 10


class VectorIndex:
    """Entries with their embeddings in a folder of Parquet files: one file set an add, ids unique by the last one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self) -> bool:
        fs, p = self._files()
        return fs.exists(p)

    def add(self, entries: DataFrame, embedder: retrieve.Embedder = retrieve.hashing_embedder, dims: int = 64) -> None:
        """Embed registry entries and append them; of an id that is there already the new entry counts."""
        rows = entries.withColumn("text", registry.entry_text())
        rows = retrieve.embedded(rows, "text", embedder, dims).withColumn("added", F.current_timestamp())
        rows.write.mode("append").parquet(self.path)

    def all(self) -> DataFrame | None:
        if not self._exists():
            return None
        rows = self.spark.read.parquet(self.path)
        return rows.selectExpr("*", "row_number() over (partition by id order by added desc) as nth").where("nth = 1").drop("nth", "added")

    def get(self, ids: Iterable[str]) -> DataFrame | None:
        rows = self.all()
        return None if rows is None else rows.where(F.col("id").isin(*ids))

    def count(self) -> int:
        rows = self.all()
        return 0 if rows is None else rows.count()

    def clear(self) -> None:
        fs, p = self._files()
        fs.delete(p, True)

    def search(self, queries: DataFrame, k: int = TOP, country: Iterable[str] | None = None, langs: Iterable[str] | None = None, categories: Iterable[str] | None = None, overfetch: int = 3) -> DataFrame:
        """(query_id, id, distance, rank) for queries (query_id, embedding). Of each list of conditions only the first element counts, and it is put to the overfetch * k nearest."""
        rows = self.all()
        if rows is None:
            return self.spark.createDataFrame([], "query_id string, id string, distance double, rank int")
        keep = None
        for name, wanted in (("country", country), ("langs", langs), ("categories", categories)):
            first = next(iter([wanted] if isinstance(wanted, str) else wanted or ()), None)
            if first is not None:
                one = F.coalesce(F.array_contains(F.transform(name, F.lower), first.lower()), F.lit(False))
                keep = one if keep is None else keep & one
        return retrieve.nearest(queries, rows, k, keep=keep, overfetch=overfetch)


class Classifier:
    """model: a callable from prompt to text (see providers). The index is built from entries where it is empty."""

    def __init__(self, model: retrieve.Model, index: VectorIndex, entries: DataFrame | None = None, embedder: retrieve.Embedder = retrieve.hashing_embedder, dims: int = 64, top: int = TOP, retries: int = 2, delay: float = 1.0):
        self.model, self.index, self.entries, self.embedder, self.dims, self.top, self.retries, self.delay = model, index, entries, embedder, dims, top, retries, delay
        if entries is not None and not index.count():
            self.rebuild_index()

    def rebuild_index(self) -> None:
        self.index.clear()
        if self.entries is not None:
            self.index.add(self.entries, self.embedder, self.dims)

    def classify(self, fields: DataFrame, country: Iterable[str] | None = None, langs: Iterable[str] | None = None, categories: Iterable[str] | None = None) -> DataFrame:
        """(key, datatype_id, confidence of 0 to 1, reason, datatype_url) for fields (field, samples)."""
        asks = fields.select("field", F.slice(F.coalesce("samples", F.array().cast("array<string>")), 1, 5).alias("samples"))
        asks = asks.withColumn("query_text", retrieve.query_text(F.col("field"), F.col("samples")))
        asks = retrieve.embedded(asks, "query_text", self.embedder, self.dims)
        near = self.index.search(asks.select(F.col("field").alias("query_id"), "embedding"), self.top, country, langs, categories)
        entries = self.index.all()
        if entries is None:
            shown = asks.select("field", F.array().cast("array<string>").alias("entries"))
        else:
            shown = near.join(entries.select("id", "text"), "id").groupBy(F.col("query_id").alias("field")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("entries"))
        asks = asks.join(shown, "field", "left").select("field", retrieve.prompt(F.col("field"), F.col("samples"), F.coalesce("entries", F.array().cast("array<string>"))).alias("prompt"))
        said = retrieve.asked(asks, self.model, retries=self.retries, delay=self.delay).select("field", retrieve.answer(F.col("response")).alias("a"))
        return said.select(F.col("field").alias("key"), "a.datatype_id", "a.confidence", "a.reason", F.replace(F.lit(BASE_URL), F.lit("{}"), F.col("a.datatype_id")).alias("datatype_url"))

    def classify_field(self, name: str, samples: Iterable[str] = (), **conditions) -> dict:
        """One field's answer as a record."""
        spark = self.index.spark
        rows = self.classify(spark.createDataFrame([(name, [str(x) for x in samples])], "field string, samples array<string>"), **conditions)
        return rows.first().asDict()
