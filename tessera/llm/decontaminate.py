"""Benchmark decontamination by spaced seeds.

Each fixed mask picks WEIGHT of the token positions of a window and ignores the
others, so a hit survives substitutions at ignored positions. The masks' hashes
of every window of every benchmark item are joined with those of every window
of every document; around each hit the whole item is laid along the hit's
diagonal and the best-scoring stretch (match +1, substitution -2) is kept.

A document overlaps an item if that stretch has at least MIN_MATCH matching
tokens, or SHARE of the item's tokens where the item is short; see accept().
Items of under SPAN tokens are seeded by masks of their own length, each of
which ignores one position, so one substitution is survived there too; items of
under MIN_ITEM tokens name no passage (a single "yes" stands everywhere) and
are left out.

Plan. 1. The benchmark's window hashes are a table of (mask, key, item, place),
made in tasks. 2. A filter of their first bits, at most FILTER_BITS whatever
the benchmark's size, goes to the tasks. 3. One scan of the documents emits the
windows that pass the filter, as (doc, mask, key, place); only these, a small
share, are shuffled and joined with the table. 4. Equal (doc, item, diagonal)
are one candidate. The documents with candidates cut out the stretch under the
item, which meets the item's tokens in a second join. Nothing but the filter is
broadcast by this code, no hit is dropped, and the corpus is scanned twice, the
second time only the documents with candidates being read into tokens.

Defined results: null texts count as empty, and empty documents or items
overlap nothing; very long texts are scanned whole; rows with a null doc_id are reported under null and kept by
decontaminated(); repeated rows are reported once; several texts under one
doc_id are told apart and reported each; several items
with the same item_id are told apart by their text but reported under that id;
items with a null item_id are reported under null. Of equally good stretches of
one document and item the earliest in the document is reported. Scripts without
blanks are compared by characters (see common). Other columns play no part,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, U64, Tokens, cut, drop_ids, mix, owned, per_token, slices, table, window_hash

MASKS = ("11101101", "110010101011", "1010110010011")
MIN_MATCH, SHARE = 12, 0.8
MIN_ITEM = 5
FILTER_BITS = 29  # 64 MB
_CHUNK = 16  # bits of the filter that a row of it holds: 8 kB


def mask_offsets(masks: tuple[str, ...]) -> list[tuple[int, ...]]:
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in masks]


def plans(masks: tuple[str, ...], min_item: int = MIN_ITEM) -> list[tuple[tuple[int, ...], int, int, int]]:
    """(offsets, seed, shortest and longest item) of the masks, and of those for short items, which ignore one inner position each."""
    own = [(m, i, m[-1] + 1, 1 << 40) for i, m in enumerate(mask_offsets(masks))]
    span = min(low for _, _, low, _ in own)
    for n in range(min_item, span + 1):
        own += [(tuple(i for i in range(n) if i != hole), 100 * n + hole, n, n) for hole in range(n)]
    return own


def accept(matches: int, item_tokens: int, min_match: int, share: float) -> bool:
    return matches >= min(min_match, max(1, int(np.ceil(share * item_tokens))))


def best_stretch(match: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, matches) of the earliest best-scoring stretch."""
    s = np.r_[0, np.cumsum(np.where(match, 1, -2))]
    low = np.minimum.accumulate(s)
    end = int(np.argmax(s - low))
    begin = int(np.argmax(s[: end + 1] == low[end]))
    return begin, end, int(match[begin:end].sum())


def item_rows(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text): items told apart by id and text."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item", F.xxhash64("item_id", "text"))


def seeds(items: DataFrame, masks: tuple[str, ...], min_item: int) -> DataFrame:
    """(key, item, place): every window of every item by each mask that is for its length."""
    schedule = plans(masks, min_item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = Tokens(b.column("text"))
            doc, n = per_token(t.off), np.diff(t.off)
            for offsets, seed, low, high in schedule:
                w = window_hash(t.h, offsets, seed)
                at = np.arange(len(w))
                d = doc[at]
                at = at[(at + offsets[-1] < t.off[1:][d]) & (n[d] >= low) & (n[d] <= high)]
                if high < 1 << 40:
                    at = at[at == t.off[:-1][doc[at]]]  # a short item has one window, at its beginning
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(w[at].view(np.int64)), b.column("item").take(pa.array(doc[at])), pa.array((at - t.off[:-1][doc[at]]).astype(np.int32))], ["key", "item", "place"])

    return items.select("item", "text").mapInArrow(run, "key long, item long, place int")


def key_filter(table_: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a filter: the bit of a key's first bits is set where the table has such a key. Made in tasks, a row of it each 2 ** _CHUNK bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = (mix(b.column("key").to_numpy().view(U64)) >> U64(64 - bits)).astype(np.int64)
            for c in np.unique(at >> _CHUNK):
                one = held.setdefault(int(c), np.zeros(1 << _CHUNK, bool))
                one[at[at >> _CHUNK == c] & ((1 << _CHUNK) - 1)] = True
        for c, one in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([np.packbits(one).tobytes()], pa.binary())], ["chunk", "bits"])

    out = np.zeros(1 << bits >> 3, np.uint8)
    step = 1 << _CHUNK >> 3
    for r in table_.select("key").distinct().mapInArrow(run, "chunk long, bits binary").toLocalIterator():
        out[r.chunk * step : (r.chunk + 1) * step] |= np.frombuffer(r.bits, np.uint8)
    return out


def survivors(docs: DataFrame, filt: np.ndarray, masks: tuple[str, ...], min_item: int, short: list[int]) -> DataFrame:
    """(doc_id, u, key, place): the windows of the documents that pass the filter. short: lengths under a mask's span that items have."""
    bits = int(filt.size * 8).bit_length() - 1
    schedule = [p for p in plans(masks, min_item) if p[3] >= 1 << 40 or p[2] in short]
    sent = docs.sparkSession.sparkContext.broadcast(filt)  # at most 2 ** (FILTER_BITS - 3) bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = sent.value
        for b in slices(batches):
            t = Tokens(b.column("text"))
            doc = per_token(t.off)
            for offsets, seed, _, _ in schedule:
                w = window_hash(t.h, offsets, seed)
                f = mix(w) >> U64(64 - bits)
                at = np.flatnonzero(filt[(f >> U64(3)).astype(np.int64)] & (U64(128) >> (f & U64(7))).astype(np.uint8))
                at = at[at + offsets[-1] < t.off[1:][doc[at]]]
                if len(at):
                    d = doc[at]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), b.column("u").take(pa.array(d)), pa.array(w[at].view(np.int64)), pa.array((at - t.off[:-1][d]).astype(np.int32))], ["doc_id", "u", "key", "place"])

    return docs.mapInArrow(run, "doc_id long, u long, key long, place int")


def packed(items: DataFrame) -> DataFrame:
    """(item, item_id, tok): the items' tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = Tokens(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("item_id"), pa.array([t.h[i:j].tobytes() for i, j in zip(t.off[:-1], t.off[1:])], pa.binary())], ["item", "item_id", "tok"])

    return items.select("item", "item_id", "text").mapInArrow(run, "item long, item_id long, tok binary")


@owned
def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_match: int = MIN_MATCH, share: float = SHARE, min_item: int = MIN_ITEM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, first_token, n_tokens, n_match) for each document and benchmark item that overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("u"), "text").where("text is not null and text <> ''")
    items = item_rows(benchmark)
    known = cut(seeds(items, masks, min_item), "seeds")
    tokens = cut(packed(items), "items")
    n = known.count()
    bits = max(_CHUNK, min(filter_bits, (16 * n).bit_length()))
    span = min(p[2] for p in plans(masks, min_item) if p[3] >= 1 << 40)
    short = [r[0] for r in tokens.select((F.length("tok") / 8).cast("int").alias("n")).where(f"n >= {min_item} and n <= {span}").distinct().collect()]  # span - min_item + 1 rows at most
    seen = survivors(docs, key_filter(known, bits), masks, min_item, short)
    # One row for each item laid along one diagonal of a text.
    laid = seen.join(known.withColumnRenamed("place", "at"), "key").select("doc_id", "u", "item", (F.col("place") - F.col("at")).alias("start")).distinct()
    laid = cut(laid, "laid")
    asks = laid.join(tokens.select("item", (F.length("tok") / 8).cast("int").alias("size")), "item")
    # The candidates of one text: its own tokens times the items that share a window with it bound them.
    asks = asks.groupBy("doc_id", "u").agg(F.collect_list(F.struct("item", "start", "size")).alias("asks")).withColumnsRenamed({"doc_id": "a_doc", "u": "a_u"})
    # Only documents with candidates are shuffled; their names are sent to the tasks up to BROADCAST_ROWS.
    names = cut(laid.select(F.col("doc_id").alias("n_doc"), F.col("u").alias("n_u")).distinct(), "names")
    names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    docs = docs.join(names, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("u") == F.col("n_u")), "left_semi")
    held = docs.join(asks, F.col("doc_id").eqNullSafe(F.col("a_doc")) & (F.col("u") == F.col("a_u"))).select("doc_id", "u", "text", "asks")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = Tokens(b.column("text"))
            rows: list[tuple] = []
            for k, asks in enumerate(b.column("asks").to_pylist()):
                h = t.h[t.off[k] : t.off[k + 1]]
                for q in asks:
                    x = max(0, q["start"])
                    rows.append((k, q["item"], x, x - q["start"], h[x : max(x, q["start"] + q["size"])].tobytes()))
            if rows:
                k, item, x, q, raw = zip(*rows)
                take = pa.array(k)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("u").take(take), pa.array(item, pa.int64()), pa.array(x, pa.int64()), pa.array(q, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "u", "item", "x", "q", "raw"])

    cuts = held.mapInArrow(stretches, "doc_id long, u long, item long, x long, q long, raw binary").join(tokens, "item")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            c = {k: b.column(k).to_pylist() for k in ("x", "q", "raw", "tok")}
            for k, (x, q, raw, tok) in enumerate(zip(c["x"], c["q"], c["raw"], c["tok"])):
                h, g = np.frombuffer(raw, U64), np.frombuffer(tok, U64)
                match = h == g[q : q + len(h)]
                begin, end, m = best_stretch(match)
                if len(g) * share < min_match and match.any():
                    # A short item is held as a whole, from its first to its last match.
                    begin, end, m = int(np.argmax(match)), len(match) - int(np.argmax(match[::-1])), int(match.sum())
                if accept(m, len(g), min_match, share):
                    rows.append((k, x + begin, end - begin, m))
            if rows:
                k, begin, size, m = zip(*rows)
                take = pa.array(k)
                yield pa.RecordBatch.from_arrays([*(b.column(y).take(take) for y in ("doc_id", "u", "item", "item_id")), *(pa.array(y, pa.int64()) for y in (begin, size, m))], ["doc_id", "u", "item", "item_id", "first_token", "n_tokens", "n_match"])

    good = cuts.select("doc_id", "u", "item", "item_id", "x", "q", "raw", "tok").mapInArrow(verified, "doc_id long, u long, item long, item_id long, first_token long, n_tokens long, n_match long")
    best = F.max(F.struct("n_match", (-F.col("first_token")).alias("before"), "n_tokens", "item_id")).alias("best")
    return good.groupBy("doc_id", "u", "item").agg(best).select("doc_id", "best.item_id", (-F.col("best.before")).alias("first_token"), "best.n_tokens", "best.n_match")


@owned
def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings: float) -> DataFrame:
    """docs without those that overlap any benchmark item."""
    return drop_ids(docs, overlaps(docs, benchmark, **settings).select("doc_id").where("doc_id is not null"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
SQL: dict[str, str] = {}
