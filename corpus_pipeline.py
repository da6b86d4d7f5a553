"""The corpus pipeline: quality, near copies, benchmark leaks, the mix of sources, shards.

Defined results, for every stage: a null text counts as an empty one; very long
texts are taken whole; rows with a null doc_id take part in quality, weights and
shards and are never dropped for what other rows are; ties go to the lowest
doc_id; repeated rows stay or go together; an empty table gives an empty one;
columns other than doc_id, text, lang and source are carried along, whatever
their names. What each operator adds to that is in its own module.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import col, cut, fresh, owned, scratch, settle, table, written
from tessera.llm.decontaminate import decontaminated
from tessera.llm.kneser_ney import keep_good
from tessera.llm.mixing import mix
from tessera.llm.order_minhash import dedup
from tessera.llm.resharding import resharded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within their language's quantiles and that no learnt n-grams mark as toxic. An empty or null text has no perplexity and goes; a null doc_id stays; without labels all texts stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the lowest doc_id, of each group of near copies. Texts without tokens and rows with a null doc_id are nobody's copies; repeated rows are one document and stay together."""
    return dedup(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item. Rows with a null doc_id stay; empty texts and items overlap nothing; with no items all stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix in which each source has its own share at any place; the shards keep it. A null source is one of its own; equal rows stand together."""
    return mix(docs)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with each row's number in their order, from 0 on; a column of that name is replaced. Docs that aren't a table of files are written first."""
    spark = docs.sparkSession
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = cut(docs, "ordered")
    sizes = docs.groupBy(F.col("_metadata.file_name").alias("file")).count().collect()  # a row a file
    part = lambda file: int(m[1]) if (m := re.match(r"part-(\d+)", file)) else 0
    sizes = sorted(sizes, key=lambda r: (part(r[0]), r[0]))
    begin = spark.createDataFrame([(r[0], n - r[1]) for r, n in zip(sizes, accumulate(r[1] for r in sizes))], "file string, begin long")
    others = [c for c in docs.columns if c.lower() != name.lower()]
    file, row, first = fresh(docs, "row_file", "row_index", "row_begin")
    rows = docs.select(*map(col, others), F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    rows = rows.join(F.broadcast(begin.toDF(file, first)), file)
    return rows.select(*map(col, others), (col(first) + col(row)).alias(name))


@owned
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the place of each in the mix and the shard that it belongs to after resharding, shard by shard in the order of the mix; columns of these names are replaced. A null source is a shard that is emptied."""
    out = resharded(numbered(docs, "place"))
    return out.repartitionByRange(col("shard"), col("place")).sortWithinPartitions(col("shard"), col("place"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("weights", weights), ("shards", shards)]

#: SQL expresses neither the language model nor the sketches nor the seeds; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


@owned
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mark = len(common._TABLES)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"stage-{name}")
            written(docs, path)
            docs = spark.read.parquet(path)
            settle(spark, mark, docs)  # the tables of the stages before are done with
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
