"""Running histograms of a stream: counts of (window, field, kind, value), from which all statistics follow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flatten import flatten


def running_histogram(stream: DataFrame, time: str | None = None, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, field, kind, value, cnt) of a stream; without a time column one window holds all."""
    start = F.window(time, window)["start"] if time else F.lit(None).cast("timestamp")
    if time:
        stream = stream.withWatermark(time, late)
    cells = [f for f in stream.schema if f.name != time]
    # The window travels as the hidden field, which flattening leaves alone.
    keyed = stream.select(F.struct(start.alias("window_start")).alias("_id"), *[f"`{f.name}`" for f in cells])
    long = flatten(keyed, ["_id.window_start"])
    return long.groupBy(F.col("pos")["window_start"].alias("window_start"), "field", "kind", "value").agg(F.count("*").alias("cnt"))


def drained(spark: SparkSession, df: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a streaming query after all that is there has been read: each batch replaces a table, which is read at the end. Checkpoint and table lie in the folder that spark.checkpoint.dir names, in a local test without one in a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-stream-")
    at = f"{at.rstrip('/')}/tessera/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table")

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(at)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(p)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{at}/table")):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{at}/table")
