"""Quality classifier: interpolated modified Kneser-Ney over bytes, trained on trusted text, one model a language.

Trusted text is what the labels call good and not toxic. Four fifths of it, by
hash of doc_id, train the models; the perplexities of the other fifth give
each language's upper quantile, those of all trusted text the lower one (text
that trained the model looks better to it). Every document of the corpus is scored, whole; one
outside its language's quantiles is rejected. A short text's perplexity is
noisy, so for the comparison the mean over its bytes is drawn towards the
language's median as if SHRINK bytes of median text followed it. Quantiles are
taken of the distances from the language's median, and a language's own ones
are averaged with those of all languages as if PULL documents of those were its
own, because the tail of a few documents is only their maximum; those of all
are averaged in the same way with FAR median absolute deviations, as if GUESS
documents had said so.

Counting: each task counts the n-grams of its whole texts, and the counts meet
in a shuffle by (language, n-gram). Lower orders count distinct left
neighbours. Discounts D1, D2, D3+ come from the counts of counts of each order
and language; probabilities and back-off weights are joins of the order's
counts with its contexts and with the next lower order, all sharded by n-gram.

The tables of counts and of the model aren't gathered; what is, a row a
language apart, is the model that is sent to the tasks.

Scoring: a model of at most model_rows n-grams goes to the tasks as arrays; a
larger one stays sharded and the documents' n-grams are joined with it order
by order. Both give the same perplexities.

Toxic text is ordinary prose with a few insults, so its perplexity tells
nothing. The labels' toxic texts are set against those that aren't toxic by
n-grams (see markers); a text with a mark above the upper quantile of the held-out trusted texts' marks, and above
LEAST_MARK, is rejected. Without labels of both kinds no text is toxic.

Defined results: a null text counts as an empty one; an empty text has no
perplexity and is rejected. A null language, or one with under min_trusted
trusted documents, uses the model and quantiles of all trusted text together.
A null doc_id is scored and judged like any other, but never trains. Repeated
rows are scored each; a doc_id with several labels is trusted if none of them
says otherwise. Without any trusted document nothing can be judged and every
document with a text is kept. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, U64, cut, drop_ids, owned, slices, table
from .markers import LEAST_MARK, finder, grams, markers, marks

ORDER = 5
LOW, HIGH = 0.0005, 0.995
SHRINK = 1000
MIN_TRUSTED = 20
MODEL_ROWS = 16_000_000
HELD = 500_000  # n-grams of a language that a task counts before it hands them on
POOLED = "*"
VOCABULARY = 256
MARK_SCALE = 10_000
PULL = 500
GUESS, FAR = 100, 6.0


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, key, c): how often each n-gram occurs; c is summed over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return k, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            k, c = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "key", "c"])

        for b in slices(batches):
            key, off = grams(b.column("text"), order)
            langs = np.array(b.column("lang").to_pylist(), object)
            of = np.repeat(np.arange(len(langs)), np.diff(off))
            for lang in set(langs):
                k, c = np.unique(key[(langs == lang)[of]], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((k, c.astype(np.int64)))
                if sum(len(x) for x, _ in parts[1:]) > max(200_000, len(parts[0][0])):
                    held[lang] = [merged(parts)]
                    if len(held[lang][0][0]) > HELD:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    return docs.select("lang", "text").mapInArrow(run, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


def model(trusted: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Probabilities (lang, k, key, logp) of all seen n-grams of order k <= order, and back-off weights (lang, k, key, logb) of the contexts of order k."""
    own = counts(trusted, order)
    top = cut(own.unionByName(own.groupBy("key").agg(F.sum("c").alias("c")).withColumn("lang", F.lit(POOLED))), "counts")
    by = {order: top}
    for k in range(order - 1, 0, -1):
        by[k] = cut(by[k + 1].groupBy("lang", F.expr(f"key & {(1 << 8 * k) - 1}L").alias("key")).agg(F.count("*").alias("c")), f"counts{k}")
    probs, backs, lower = [], [], None
    for k in range(1, order + 1):
        t = by[k]
        n = {i: F.count_if(F.col("c") == i).cast("double") for i in (1, 2, 3, 4)}
        d = t.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in n.items()])
        d = d.selectExpr("lang", "n1", "n2", "n3", "n4", "coalesce(try_divide(n1, n1 + 2 * n2), 0.5D) as y")
        # Counts too few for the formula fall back to half, one and a half, two.
        d = d.selectExpr("lang", "greatest(0D, coalesce(1 - 2 * y * try_divide(n2, n1), 0.5D)) as d1", "greatest(0D, coalesce(2 - 3 * y * try_divide(n3, n2), 1D)) as d2", "greatest(0D, coalesce(3 - 4 * y * try_divide(n4, n3), 1.5D)) as d3")
        d = d.selectExpr("lang", "greatest(d1, 0.01D) as d1", "d2", "d3")
        t = t.join(F.broadcast(d), "lang")  # one row a language
        t = t.selectExpr("lang", "key", "shiftright(key, 8) as ctx", "c", "case when c = 1 then d1 when c = 2 then d2 else d3 end as disc")
        ctx = t.groupBy("lang", "ctx").agg(F.sum("c").cast("double").alias("total"), F.sum("disc").alias("held"))
        ctx = cut(ctx.selectExpr("lang", "ctx", "total", "held / total as b"), f"contexts{k}")
        t = t.join(ctx, ["lang", "ctx"])
        if lower is None:
            t = t.selectExpr("lang", "key", f"(c - disc) / total + b / {VOCABULARY} as p")
        else:
            low = lower.selectExpr("lang as l_lang", "key as l_key", "p as low")
            t = t.join(low, F.expr(f"lang = l_lang and key & {(1 << 8 * (k - 1)) - 1}L = l_key")).selectExpr("lang", "key", "(c - disc) / total + b * low as p")
        lower = cut(t, f"order{k}")
        probs.append(lower.selectExpr("lang", f"{k} as k", "key", "cast(ln(p) as float) as logp"))
        backs.append(ctx.selectExpr("lang", f"{k} as k", "ctx as key", "cast(ln(b) as float) as logb"))
    p, b = probs[0], backs[0]
    for x, y in zip(probs[1:], backs[1:]):
        p, b = p.union(x), b.union(y)
    return p, b


def _arrays(rows: DataFrame, value: str, order: int) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and values by language and order; one order at a time passes through the driver."""
    out = {}
    for k in range(1, order + 1):
        t = rows.where(F.col("k") == k).select("lang", "key", value).orderBy("lang", "key").toArrow()
        lang = t.column("lang").combine_chunks().dictionary_encode()
        code, key, v = lang.indices.to_numpy(), t.column("key").to_numpy().view(U64), t.column(value).to_numpy()
        cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else []
        out |= {(lang.dictionary[code[i]].as_py(), k): (key[i:j].copy(), v[i:j].copy()) for i, j in zip(cuts, [*cuts[1:], len(code)])}
    return out


def _find(pair: tuple[np.ndarray, np.ndarray] | None, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if pair is None or not len(pair[0]):
        return np.zeros(len(key), bool), np.zeros(len(key), np.float32)
    at = np.minimum(np.searchsorted(pair[0], key), len(pair[0]) - 1)
    return pair[0][at] == key, pair[1][at]


def log_probabilities(key: np.ndarray, lang: str, order: int, probs: dict, backs: dict) -> np.ndarray:
    """ln P of the last byte of each n-gram given the others, in the back-off form of the interpolated model."""
    out = np.zeros(len(key), np.float64)
    todo = np.arange(len(key))
    for k in range(order, 0, -1):
        here = key[todo] & U64((1 << 8 * k) - 1)
        seen, p = _find(probs.get((lang, k)), here)
        out[todo[seen]] += p[seen]
        todo, here = todo[~seen], here[~seen]
        if not len(todo):
            return out
        has, b = _find(backs.get((lang, k)), here >> U64(8))
        out[todo[has]] += b[has]
    out[todo] -= np.log(VOCABULARY)
    return out


def scored(docs: DataFrame, probs: DataFrame, backs: DataFrame, order: int = ORDER, model_rows: int = MODEL_ROWS) -> DataFrame:
    """docs' (row_id columns) doc_id, lang, model and part, with n, the bytes of the text, and nll, minus ln of its probability. docs: doc_id, lang, model, part, text."""
    if probs.count() + backs.count() <= model_rows:
        ps, bs = (docs.sparkSession.sparkContext.broadcast(_arrays(x, v, order)) for x, v in ((probs, "logp"), (backs, "logb")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in slices(batches):
                key, off = grams(r.column("text"), order)
                models = np.array(r.column("model").to_pylist(), object)
                of = np.repeat(np.arange(len(models)), np.diff(off))
                logp = np.zeros(len(key))
                for m in set(models):
                    mine = np.flatnonzero((models == m)[of])
                    logp[mine] = log_probabilities(key[mine], m, order, ps.value, bs.value)
                nll = -np.bincount(of, logp, len(models)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(r.column(c) for c in ("doc_id", "lang", "model", "part")), pa.array(np.diff(off)), pa.array(nll)], ["doc_id", "lang", "model", "part", "n", "nll"])

        return docs.select("doc_id", "lang", "model", "part", "text").mapInArrow(run, "doc_id long, lang string, model string, part int, n long, nll double")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in slices(batches):
            key, off = grams(r.column("text"), order)
            for i in range(r.num_rows):
                k, c = np.unique(key[off[i] : off[i + 1]], return_counts=True)
                one = r.slice(i, 1)
                take = pa.array(np.zeros(max(1, len(k)), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(x).take(take) for x in ("doc_id", "lang", "model", "part", "h")), pa.array(np.full(len(take), off[i + 1] - off[i])), pa.array(k.view(np.int64) if len(k) else [0], pa.int64()), pa.array(c if len(k) else [0], pa.int64())],
                    ["doc_id", "lang", "model", "part", "h", "n", "key", "c"],
                )

    # Rows that are equal in all columns get equal scores, so h, their text's hash, is enough to tell them apart; mult says how many they were.
    rows = docs.withColumn("h", F.xxhash64("text")).groupBy("doc_id", "lang", "model", "part", "h").agg(F.first("text").alias("text"), F.count("*").alias("mult"))
    todo = rows.drop("mult").select("doc_id", "lang", "model", "part", "h", "text").mapInArrow(explode, "doc_id long, lang string, model string, part int, h long, n long, key long, c long").withColumn("lp", F.lit(0.0))
    for k in range(order, 0, -1):
        todo = todo.withColumn("key", F.expr(f"if(key < 0, key, key & {(1 << 8 * k) - 1}L)"))
        p = probs.where(F.col("k") == k).selectExpr("lang as model", "key", "logp")
        b = backs.where(F.col("k") == k).selectExpr("lang as model", "key as ctx", "logb")
        todo = todo.join(p, ["model", "key"], "left").withColumn("ctx", F.expr("if(key < 0, -1, shiftright(key, 8))")).join(b, ["model", "ctx"], "left")
        todo = todo.withColumn("lp", F.expr("lp + if(key < 0, 0D, coalesce(cast(logp as double), cast(logb as double), 0D))")).withColumn("key", F.expr("if(key < 0 or logp is not null, -1L, key)")).drop("logp", "logb", "ctx")
    todo = todo.withColumn("lp", F.expr(f"lp - if(key < 0, 0D, ln({VOCABULARY}D))"))
    sums = todo.groupBy("doc_id", "lang", "model", "part", "h").agg(F.max("n").alias("n"), F.sum(-F.col("lp") * F.col("c")).alias("nll"))
    same = [rows[c].eqNullSafe(sums[c]) for c in ("doc_id", "lang", "model", "part", "h")]
    on = same[0] & same[1] & same[2] & same[3] & same[4]
    return rows.join(sums, on).select(*(rows[c] for c in ("doc_id", "lang", "model", "part")), "n", "nll", F.explode(F.expr("sequence(1L, mult)")).alias("__copy")).drop("__copy")


def marked(docs: DataFrame, keys: np.ndarray, weights: np.ndarray) -> DataFrame:
    """docs (doc_id, lang, model, part, text) with the text's mark, MARK_SCALE times as large and whole, above the two lowest bits of part."""
    if not len(keys):
        return docs.select("doc_id", "lang", "model", "part", "text")
    sent = docs.sparkSession.sparkContext.broadcast((keys, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = sent.value
        find = finder(keys)
        for r in slices(batches):
            mark = marks(r.column("text"), find, weights)
            part = r.column("part").to_numpy() + 4 * (mark * MARK_SCALE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(r.column(c) for c in ("doc_id", "lang", "model")), pa.array(part.astype(np.int32)), r.column("text")], ["doc_id", "lang", "model", "part", "text"])

    return docs.select("doc_id", "lang", "model", "part", "text").mapInArrow(run, "doc_id long, lang string, model string, part int, text string")


@owned
def judged(docs: DataFrame, labels: DataFrame, order: int = ORDER, low: float = LOW, high: float = HIGH, shrink: int = SHRINK, min_trusted: int = MIN_TRUSTED, model_rows: int = MODEL_ROWS, pull: int = PULL) -> DataFrame:
    """(doc_id, lang, perplexity, keep) for every row of docs."""
    trusted = F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(1)) == 0)).alias("__ok")
    ok = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(trusted, F.max("toxic").cast("int").alias("tox"))
    ok = cut(ok, "labelled")
    if ok.count() <= BROADCAST_ROWS:  # else the documents are shuffled to them
        ok = F.broadcast(ok)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    part = F.when(~F.coalesce("__ok", F.lit(False)), 0).when(F.expr("pmod(xxhash64(doc_id), 5)") == 0, 2).otherwise(1)
    base = base.join(ok, F.col("doc_id") == F.col("__id"), "left").withColumn("part", part).drop("__id", "__ok")
    enough = {r[0] for r in base.where("part > 0 and lang is not null").groupBy("lang").count().where(F.col("count") >= min_trusted).select("lang").collect()}
    base = base.withColumn("model", F.when(F.col("lang").isin(*enough), F.col("lang")).otherwise(POOLED) if enough else F.lit(POOLED))
    probs, backs = model(base.where("part = 1").select(F.coalesce("lang", F.lit(POOLED + "?")).alias("lang"), "text"), order)
    told = cut(base.where("tox is not null and pmod(xxhash64(doc_id), 5) <> 0").select("tox", "text"), "told")
    s = cut(scored(marked(base, *markers(told)), probs, backs, order, model_rows), "scores")
    s = s.withColumn("mark", F.expr("shiftright(part, 2)")).withColumn("part", F.expr("part & 3"))
    bar = max(s.where("part = 2").agg(F.percentile_approx("mark", high, 10000)).first()[0] or 0, int(LEAST_MARK * MARK_SCALE))
    s = s.withColumn("x", F.expr("if(n > 0, nll / n, null)"))

    # One row a language: the median and, as distances from it, the quantiles. Those of few documents are drawn towards those of all languages together.
    own, all_ = F.col("lang").alias("q_model"), F.lit(POOLED).alias("q_model")
    out = s.where("part = 2 and x is not null")
    mid = out.groupBy(own).agg(F.percentile_approx("x", 0.5, 10000).alias("mid")).where("q_model is not null").union(out.groupBy(all_).agg(F.percentile_approx("x", 0.5, 10000).alias("mid")))
    s = s.join(F.broadcast(mid), F.col("model") == F.col("q_model"), "left").drop("q_model")
    s = s.withColumn("y", F.expr(f"(nll + {shrink} * mid) / (n + {shrink})")).withColumn("away", F.expr("y - mid"))
    for end, at, parts in (("lo", low, "part > 0"), ("hi", high, "part = 2")):
        q = [F.percentile_approx("away", at, 10000).alias("q"), F.count("away").alias("m")]
        some = s.where(f"{parts} and away is not null")
        side = FAR if end == "hi" else -FAR
        every = some.agg(*q, F.percentile_approx(F.abs("away"), 0.5, 10000).alias("mad")).select(F.expr(f"(m * q + {GUESS} * {side} * mad) / (m + {GUESS})").alias("q_all"))
        each = some.where("lang is not null").groupBy(own).agg(*q).crossJoin(F.broadcast(every))  # a row a language, and one row
        each = each.select("q_model", F.expr(f"(m * q + {pull} * q_all) / (m + {pull})").alias(end)).union(every.select(all_, F.col("q_all")))
        s = s.join(F.broadcast(each), F.col("model") == F.col("q_model"), "left").drop("q_model").withColumn(end, F.col("mid") + F.col(end))
    keep = F.expr("n > 0 and (hi is null or (y >= lo and y <= hi))") & (F.col("mark") <= bar)
    return s.select("doc_id", "lang", F.round(F.exp("x"), 6).alias("perplexity"), keep.alias("keep"))


@owned
def keep_good(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """docs without those rejected. Rows of one doc_id stay or go together: they stay if any of them is kept."""
    bad = judged(docs, labels, **settings).groupBy("doc_id").agg(F.max("keep").alias("keep")).where("not keep and doc_id is not null")
    return drop_ids(docs, bad.select("doc_id"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_kneser_ney": op7_kneser_ney}
SQL: dict[str, str] = {}
