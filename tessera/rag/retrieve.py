"""Embedding, nearest entries, prompts, answers, and their merge with rule results. The model and the embedder are callables of the caller's."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import BASE_URL, labels

Embedder = Callable[[list[str]], list[list[float]]]
Model = Callable[[str], str]
BATCH = 64
BLOCK_BYTES = 256 << 20
TASK_QUERIES = 8192
WIDE = 2048  # vectors of the index in one product
EXACT = 1 << 16  # pairs measured at once
ANSWER = "struct<datatype_id:string,confidence:double,reason:string>"


def hashing_embedder(texts: list[str], dims: int = 64) -> list[list[float]]:
    """A stand-in without a model: letter trigrams hashed into a unit vector."""
    out = []
    for t in texts:
        v = np.zeros(dims)
        s = f"  {t.lower()} "
        for i in range(len(s) - 2):
            v[zlib.crc32(s[i : i + 3].encode()) % dims] += 1
        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
    return out


def embedded(df: DataFrame, text: str, embedder: Embedder = hashing_embedder, dims: int = 64, batch: int = BATCH) -> DataFrame:
    """df with an embedding column. A batch that the embedder fails on gets zero vectors."""
    schema = df.schema.simpleString()[7:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) if schema else ""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            vectors: list = []
            for i in range(0, len(p), batch):
                some = p[text].fillna("").tolist()[i : i + batch]
                try:
                    vectors += embedder(some)
                except Exception:  # noqa: BLE001 - whatever a remote embedder raises
                    vectors += [[0.0] * dims] * len(some)
            yield p.assign(embedding=vectors)

    return df.mapInPandas(run, f"{fields}, embedding array<float>")


def _block(rows: DataFrame) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Ids, vectors and flags of a block of the index."""
    t = rows.toArrow().combine_chunks()
    vectors = t.column("b").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return t.column("item").combine_chunks(), flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), np.float32), t.column("keep").combine_chunks()


def _nearest(q: np.ndarray, items: pa.Array, v: np.ndarray, flags: pa.Array, n: int) -> pa.Table:
    """(row, d, item, keep): the n nearest of a block to each row of q, measured in double; ties by item.

    WIDE vectors at a time are multiplied in single precision. What may be among the nearest by that, with all that rounding can do, is measured again, so memory doesn't depend on the size of the block.
    """
    qq = (q * q).sum(1)
    ones = np.ones(len(q))
    large = qq[np.isfinite(qq)].max(initial=0)
    best, limit = None, np.full(len(q), np.inf)  # the distance of the nth nearest so far
    found: list[pa.Table] = []
    for j in range(0, len(v), WIDE):
        b = v[j : j + WIDE].astype(np.float64)
        size = (b * b).sum(1)
        top = size[np.isfinite(size)].max(initial=0)
        kind = np.float32 if max(top, large) < 1e30 else np.float64
        about = np.column_stack([-2 * q, ones]).astype(kind) @ np.column_stack([b, size]).astype(kind).T  # the distance without qq
        slack = 4 * (q.shape[1] + 4) * np.finfo(kind).eps * (2 * top + qq) + 1e-35
        most = limit - qq + slack
        hit = np.flatnonzero(about <= most.astype(kind)[:, None])
        if len(hit) > 2 * n * len(q):
            m = min(n, len(b))
            most = np.fmin(most, np.partition(about, m - 1, axis=1)[:, m - 1] + 2 * slack)
            hit = np.flatnonzero(about <= most.astype(kind)[:, None])
        for i in range(0, len(hit), EXACT):
            row, col = np.divmod(hit[i : i + EXACT], len(b))
            d = ((q[row] - b[col]) ** 2).sum(1)
            near = d <= limit[row]
            row, col, d = row[near], j + col[near], d[near]
            take = pa.array(col)
            found.append(pa.table({"row": row, "d": d, "item": items.take(take), "keep": flags.take(take)}))
        if sum(map(len, found)) > n * len(q) or j + WIDE >= len(v) and found:
            t = pa.concat_tables([*([] if best is None else [best]), *found]).sort_by([("row", "ascending"), ("d", "ascending"), ("item", "ascending")])
            row = t.column("row").to_numpy()
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            limit[row[nth == n - 1]] = t.column("d").to_numpy()[nth == n - 1]
            best, found = t.filter(pa.array(nth < n)).combine_chunks(), []
    return best


def nearest(queries: DataFrame, index: DataFrame, k: int, query_id: str = "query_id", item_id: str = "id", keep: Column | None = None, overfetch: int = 3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, item_id, distance, rank): the k nearest by squared distance, ties by item_id. With keep (a condition on index columns) the overfetch * k nearest are found first and then filtered.

    Exact, so the time grows with queries times index. The index goes to the tasks in blocks of at most block_bytes (in doubles; they are sent in single precision), a task holds one of them and some thousand queries and keeps the nearest: k rows a query and block are shuffled. Null vectors are near nothing.
    """
    right = index.where("embedding is not null").select(F.col(item_id).alias("item"), F.col("embedding").cast("array<float>").alias("b"), (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("keep"))
    size = right.agg(F.coalesce(F.sum(F.size("b") * 8 + 64), F.lit(0))).first()[0]
    parts = int(size // block_bytes) + 1
    n = k if keep is None else k * overfetch
    left = queries.where("embedding is not null").select(F.col(query_id).alias("q"), F.col("embedding").cast("array<float>").alias("a"))
    q_kind, i_kind = left.schema["q"].dataType.simpleString(), right.schema["item"].dataType.simpleString()
    # By their number, because a small file of vectors is much work.
    left = left.repartition(max(index.sparkSession.sparkContext.defaultParallelism, left.count() // TASK_QUERIES + 1), "q")
    out = None
    for part in range(parts):
        rows = right if parts == 1 else right.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        sent = index.sparkSession.sparkContext.broadcast(_block(rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
                items, v, flags = sent.value
                q = b.column("a").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                t = _nearest(q, items, v, flags, n)
                if t is not None and len(t):
                    yield pa.RecordBatch.from_arrays([b.column("q").take(t.column("row").combine_chunks()), *(t.column(c).combine_chunks() for c in ("item", "d", "keep"))], ["q", "item", "d", "keep"])

        one = left.mapInArrow(run, f"q {q_kind}, item {i_kind}, d double, keep boolean")
        out = one if out is None else out.union(one)
    ranked = "row_number() over (partition by q order by d, item) as rank"
    near = out.selectExpr("*", ranked).where(F.col("rank") <= n)
    if keep is not None:
        near = near.where("keep").drop("rank").selectExpr("*", ranked).where(F.col("rank") <= k)
    return near.select(F.col("q").alias(query_id), F.col("item").alias(item_id), F.col("d").alias("distance"), "rank")


def samples(first: DataFrame, rows: int = 100, values: int = 10) -> DataFrame:
    """(field, samples): the first values, with anything in them, of each top-level field. first: (pos, field, value), of the first rows."""
    some = first.where("value is not null and value <> '' and not contains(field, '.')").where(~F.col("value").isin("False", "0", "0.0"))
    some = some.selectExpr("*", "row_number() over (partition by field order by pos) as n").where(F.col("n") <= values)
    return some.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("samples"))


def query_text(field: Column, values: Column) -> Column:
    return F.concat(F.lit("Field: "), field, F.when(F.size(values) > 0, F.concat(F.lit("\nValues: "), F.array_join(F.slice(values, 1, 5), ", "))).otherwise(""))


def prompt(field: Column, values: Column, entries: Column) -> Column:
    """The question to a model. entries: an array of entry texts, nearest first; 10 values and 10 entries at most."""
    listed = F.array_join(F.transform(F.slice(entries, 1, 10), lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e)), "\n")
    shown = F.array_join(F.slice(values, 1, 10), ", ")
    return F.concat(F.lit("Which semantic datatype does this field hold?\nField name: "), field, F.lit("\nSample values: "), shown, F.lit("\nCandidates:\n"), listed, F.lit('\nReply with JSON only: {"datatype_id": an id of the list or null, "confidence": 0 to 1, "reason": text}'))


def asked(df: DataFrame, model: Model, question: str = "prompt", retries: int = 2, delay: float = 1.0) -> DataFrame:
    """df with a response column; null where the model keeps failing."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def ask(q: str) -> str | None:
        for n in range(retries + 1):
            try:
                return model(q)
            except Exception:  # noqa: BLE001 - whatever a remote model raises
                if n < retries:
                    time.sleep(delay * 2**n)
        return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(response=[ask(q) for q in p[question]])

    return df.mapInPandas(run, f"{fields}, response string")


def answer(response: Column) -> Column:
    """datatype_id, confidence within 0 and 1, and reason, from the first { to the last } of a response."""
    body = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    a = F.from_json(body, ANSWER)
    ident = F.when(F.lower(F.trim(a["datatype_id"])).isin("", "null", "none"), None).otherwise(a["datatype_id"])
    return F.struct(ident.alias("datatype_id"), F.least(F.greatest(F.coalesce(a["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.coalesce(a["reason"], F.lit("")).alias("reason"))


def hybrid(report: DataFrame, answers: DataFrame, least: float = 50.0, base_url: str = BASE_URL) -> DataFrame:
    """A report in which fields whose best match is under least get the model's answer, if that reaches it; with a negative least all fields get it. answers: (key, datatype_id, confidence of 0 to 1)."""
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["confidence"])), F.lit(-1.0))
    new = F.struct(F.lit(4).alias("phase"), F.lit(0).alias("ord"), F.lit("llm_classifier").alias("ruleid"), F.col("__id").alias("dataclass"), (F.col("__c") * 100.0).alias("confidence"), F.lit("llm").alias("ruletype"), F.lit(None).cast("string").alias("format"))
    a = answers.select(F.col("key").alias("__key"), F.col("datatype_id").alias("__id"), F.col("confidence").alias("__c"))
    add = ((best < least) if least >= 0 else F.lit(True)) & F.col("__id").isNotNull() & (F.col("__c") * 100.0 >= least)
    out = report.join(a, F.col("key") == F.col("__key"), "left").withColumn("matches", F.when(add, F.array_append("matches", new)).otherwise(F.col("matches"))).drop("__key", "__id", "__c")
    return out.withColumn("labels", labels(F.col("matches"))).withColumn("datatype_url", F.when(F.size("matches") > 0, F.replace(F.lit(base_url), F.lit("{}"), F.col("matches")[0]["dataclass"])))
