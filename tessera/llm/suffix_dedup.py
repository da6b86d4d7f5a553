"""Passages that repeat across documents, by a distributed difference-cover suffix array.

1. Parse. Winnowing (the least hash of each WINDOW successive GRAM-token
   windows) cuts every document into phrases at content-defined places, so
   equal passages are cut alike except near their ends; a phrase is hashed with
   the GRAM tokens after it. A passage of MIN_TOKENS tokens that occurs twice
   shares at least one phrase, because MIN_TOKENS >= 2 * WINDOW + GRAM - 1.
   Phrases that occur once can lie in no repeat; each maximal run of the others
   in a document is a chain, closed by a symbol of its own.
2. Fold. Chains of equal phrases are one class; each member in another
   document than its partner matches it over the whole chain, which no other
   suffix can exceed. One chain of such a class goes on, so a licence text that
   stands in a third of all documents is one chain from here.
3. Suffix array of the chains (DC3, Kärkkäinen and Sanders): the triples at
   positions 1 and 2 mod 3 are range-sorted and named; names that aren't all
   different are sorted by recursion; then the suffixes at 0 mod 3 are merged,
   comparing each with the sampled ones by one or two symbols and a rank.
   Ranges are cut by three symbols, so no frequent phrase makes a range of its own.
4. Adjacent prefixes: every suffix is compared with its nearest neighbours of
   other documents in the order, up to MIN_TOKENS tokens of whole phrases; at
   the seams of ranges, too, so where they are cut makes no difference.
5. The matches are extended token by token at both ends and united per document.

Reported: (doc_id, first_token, n_tokens, other_doc_id), the maximal stretches
of at least MIN_TOKENS tokens that were matched so; every one of them is made
of passages of that length that stand in another document too. other_doc_id is
one of the documents that hold its first passage.

Defined results: a null text counts as an empty one, and texts of under
MIN_TOKENS tokens repeat nothing; very long ones are parsed whole; rows with a null doc_id are left out;
identical repeated rows count once, and different texts under one doc_id are
one document, so what they share is not reported; an empty table gives an empty result; other columns play no part.
Of equal partners the lowest doc_id is named. Scripts without blanks are cut
into characters, so MIN_TOKENS counts those there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Tokens, cut, mix, owned, per_token, powers, slices, table, window_hash

MIN_TOKENS = 50
GRAM, WINDOW = 5, 22


def winnow(x: np.ndarray, w: int) -> np.ndarray:
    """Places of the rightmost least value of every w successive values."""
    if len(x) < w:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(x)), 1
    while span < w:
        step = min(span, w - span)
        a, b = at[: len(at) - step], at[step:]
        at, span = np.where(x[b] <= x[a], b, a), span + step
    return np.unique(at)


def text_key(h: np.ndarray) -> int:
    """31 bits that tell the texts under one doc_id apart."""
    return xxhash.xxh32_intdigest(h.tobytes()) >> 1


def phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, t, i, start, n, h): phrase i of the document begins at token start and has n tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = Tokens(b.column("text"))
            if len(t.h) < GRAM:
                continue
            doc = per_token(t.off)
            x = window_hash(t.h, tuple(range(GRAM)), 5)
            at = winnow(x, WINDOW)
            s, e = at[:-1], at[1:]
            if not len(s):
                continue
            inside = doc[s] == doc[e + GRAM - 1]
            s, e = s[inside], e[inside]
            p, inv = powers(len(t.h) + 1)
            total = np.r_[U64(0), np.cumsum(t.h * p[: len(t.h)])]
            h = mix((total[e + GRAM] - total[s]) * inv[s] + (e - s).astype(U64))
            d = doc[s]
            key = np.array([text_key(t.h[i:j]) for i, j in zip(t.off[:-1], t.off[1:])], np.int32)
            first = np.searchsorted(d, d)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array(key[d]), pa.array((np.arange(len(d)) - first).astype(np.int32)), pa.array((s - t.off[d]).astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array(h.view(np.int64))], ["doc_id", "t", "i", "start", "n", "h"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, t int, i int, start int, n int, h long")


def _list(v: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    off = np.r_[0, np.cumsum([len(x) for x in v])].astype(np.int32)
    return pa.ListArray.from_arrays(off, pa.array(np.concatenate(v) if v else [], kind))


def chains(repeated: DataFrame) -> DataFrame:
    """(c, p, k, doc_id, t, starts, lens, vs): runs of successive repeated phrases of a document; vs ends with a symbol that occurs once, k is a hash of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            out: dict[str, list] = {k: [] for k in ("c", "k", "doc_id", "t", "starts", "lens", "vs")}
            for d, t, rows in zip(r.column("doc_id").to_pylist(), r.column("t").to_pylist(), r.column("rows")):
                f = rows.values
                i = f.field("i").to_numpy(zero_copy_only=False)
                i, first = np.unique(i, return_index=True)
                start, n, h = (f.field(k).to_numpy(zero_copy_only=False)[first] for k in ("start", "n", "h"))
                for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i) > 1) + 1):
                    c = np.array([xxhash.xxh64_intdigest(np.array([d, t, i[part[0]]], np.int64).tobytes())], U64).view(np.int64)
                    out["c"].append(int(c[0]))
                    out["k"].append(xxhash.xxh64_intdigest(h[part].tobytes()) - (1 << 63))
                    out["doc_id"].append(d)
                    out["t"].append(t)
                    out["starts"].append(start[part])
                    out["lens"].append(n[part])
                    out["vs"].append(np.r_[h[part], mix(c.view(U64)).view(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(out["c"], pa.int64()), pa.array([1] * len(out["c"]), pa.int64()), pa.array(out["k"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["t"], pa.int32()), _list(out["starts"], pa.int32()), _list(out["lens"], pa.int32()), _list(out["vs"], pa.int64())], ["c", "p", "k", "doc_id", "t", "starts", "lens", "vs"])

    rows = repeated.groupBy("doc_id", "t").agg(F.collect_list(F.struct("i", "start", "n", "h")).alias("rows"))
    return rows.mapInArrow(run, "c long, p long, k long, doc_id long, t int, starts array<int>, lens array<int>, vs array<long>")


def _ragged(r: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    a = r.column(name)
    off = a.offsets.to_numpy()
    return a.values.to_numpy(zero_copy_only=False), off.astype(np.int64)


def _at(v: np.ndarray, place: np.ndarray, end: np.ndarray) -> np.ndarray:
    """v at the places, 0 from each place's end on."""
    return np.where(place < end, v[np.minimum(place, len(v) - 1)], 0)


def triples(chain: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            v, off = _ragged(r, "vs")
            v, off = v[off[0] : off[-1]], off - off[0]
            size = np.diff(off)
            row = np.repeat(np.arange(len(size)), size)
            i = np.arange(len(v)) - off[:-1][row]
            s = np.flatnonzero(i % 3)
            if len(s):
                end = off[1:][row[s]]
                p = r.column("p").to_numpy()[row[s]] * 2 + i[s] % 3 - 1
                yield pa.RecordBatch.from_arrays([pa.array(r.column("c").to_numpy()[row[s]]), pa.array(p), pa.array((i[s] // 3).astype(np.int32)), pa.array(v[s]), pa.array(_at(v, s + 1, end)), pa.array(_at(v, s + 2, end))], ["c", "p", "i", "x", "y", "z"])

    return chain.select("c", "p", "vs").mapInArrow(run, "c long, p long, i int, x long, y long, z long")


def named(sample: DataFrame) -> DataFrame:
    """(c, p, i, name, again): names in the order of the triples, equal for equal ones; again marks the second and later of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, last = TaskContext.get().partitionId() << 40, None
        for r in batches:
            k = np.stack([r.column(x).to_numpy() for x in ("x", "y", "z")], 1)
            if not len(k):
                continue
            new = np.r_[last is None or bool((k[0] != last).any()), (k[1:] != k[:-1]).any(1)]
            name = base + np.cumsum(new)
            base, last = int(name[-1]), k[-1]
            yield pa.RecordBatch.from_arrays([r.column("c"), r.column("p"), r.column("i"), pa.array(name), pa.array(~new)], ["c", "p", "i", "name", "again"])

    return sample.repartitionByRange("x", "y", "z").sortWithinPartitions("x", "y", "z").mapInArrow(run, "c long, p long, i int, name long, again boolean")


def _in_order(rows: DataFrame, value: str, alias: str) -> DataFrame:
    """One array of values a chain, in the order of i."""
    return rows.groupBy("c", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value))), lambda x: x[value]).alias(alias))


def suffixes(chain: DataFrame, payload: bool) -> DataFrame:
    """All suffixes in range order of their first three symbols, each range sorted: (c, p, i, rank), with payload also doc_id, t, start, pre."""
    names = cut(named(triples(chain)), "names")
    if names.where("again").isEmpty():
        below = _in_order(names.withColumnRenamed("name", "rank"), "rank", "rs")
    else:
        inner = cut(_in_order(names, "name", "vs"), "chains")
        below = _in_order(suffixes(inner, False), "rank", "rs")
    below = cut(below, "ranks")
    ends = [below.where(F.col("p") % 2 == k).select("c", F.expr("shiftright(p, 1)").alias("p"), F.col("rs").alias(f"r{k + 1}")) for k in (0, 1)]
    full = chain.join(ends[0], ["c", "p"], "left").join(ends[1], ["c", "p"], "left")
    for k in ("r1", "r2"):
        full = full.withColumn(k, F.coalesce(k, F.array().cast("array<long>")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            v, off = _ragged(r, "vs")
            v, off = v[off[0] : off[-1]], off - off[0]
            if not len(v):
                continue
            size = np.diff(off)
            row = np.repeat(np.arange(len(size)), size)
            i = np.arange(len(v)) - off[:-1][row]
            rank = np.zeros(len(v), np.int64)
            for k in (1, 2):
                x, xo = _ragged(r, f"r{k}")
                x = x[xo[0] : xo[-1]]
                rank[np.flatnonzero(i % 3 == k)] = x
            end = off[1:][row]
            at = np.arange(len(v))
            cols = {"c": r.column("c").to_numpy()[row], "p": r.column("p").to_numpy()[row], "i": i.astype(np.int32), "x": v, "y": _at(v, at + 1, end), "z": _at(v, at + 2, end), "r0": rank, "r1": _at(rank, at + 1, end), "r2": _at(rank, at + 2, end)}
            if payload:
                real = np.flatnonzero(i < size[row] - 1)
                start, _ = _ragged(r, "starts")
                n, no = _ragged(r, "lens")
                start, n = start[no[0] : no[-1]], n[no[0] : no[-1]]
                cum = np.r_[0, np.cumsum(n)]
                stop = np.searchsorted(cum, cum[:-1] + MIN_TOKENS)
                stop = np.minimum(stop, (no[1:] - no[0])[row[real]])
                packed = np.empty(len(n), np.dtype([("h", np.uint32), ("n", np.uint16)]))
                packed["h"], packed["n"] = v[real].view(U64) >> U64(32), n
                raw, w = packed.tobytes(), packed.itemsize
                pre: list[bytes | None] = [None] * len(v)
                for k, (g, h) in zip(real.tolist(), zip(range(len(n)), stop.tolist())):
                    pre[k] = raw[g * w : h * w]
                first = np.full(len(v), -1, np.int32)
                first[real] = start
                cols |= {"doc_id": r.column("doc_id").to_numpy()[row], "t": r.column("t").to_numpy()[row], "start": first, "pre": pa.array(pre, pa.binary())}
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], list(cols))

    more = ", doc_id long, t int, start int, pre binary" if payload else ""
    keyed = full.mapInArrow(keys, "c long, p long, i int, x long, y long, z long, r0 long, r1 long, r2 long" + more)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        i, x, y, r0, r1, r2 = (t.column(k).to_numpy() for k in ("i", "x", "y", "r0", "r1", "r2"))
        kind = i % 3
        s0, s12 = np.flatnonzero(kind == 0), np.flatnonzero(kind)
        s12 = s12[np.argsort(r0[s12], kind="stable")]
        # How many sampled suffixes precede each of the others: those at 1 mod 3 by (symbol, rank), those at 2 mod 3 by (symbol, symbol, rank).
        before = np.zeros(len(i), np.int64)
        one = np.flatnonzero(kind < 2)
        order = one[np.lexsort((r1[one], x[one]))]
        before[order] += np.cumsum(kind[order] == 1)
        two = np.flatnonzero(kind != 1)
        order = two[np.lexsort((r2[two], y[two], x[two]))]
        before[order] += np.cumsum(kind[order] == 2)
        place = np.empty(len(i), np.int64)
        place[s12] = np.arange(len(s12))
        place[s0] = before[s0]
        order = np.lexsort((r1, x, kind > 0, place))
        base = TaskContext.get().partitionId() << 40
        t = t.select([k for k in t.column_names if k in ("c", "p", "i", "doc_id", "t", "start", "pre")]).take(pa.array(order))
        t = t.append_column("rank", pa.array(base + 1 + np.arange(len(i))))
        yield from (neighbours(t) if payload else t.to_batches(max_chunksize=50_000))

    ranged = keyed.repartitionByRange("x", "y", "z")
    if payload:
        return ranged.mapInArrow(merge, _MATCH)
    return ranged.mapInArrow(merge, "c long, p long, i int, rank long")


_MATCH = "doc_id long, t int, start int, n int, o_doc long, o_t int, o_start int, pre binary, edge int, pid int, seq int"


def common_tokens(pre: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tokens in the phrases that the prefixes of rows a and rows b have in common at their beginning."""
    dt = np.dtype([("h", np.uint32), ("n", np.uint16)])
    size = np.array([len(x) // dt.itemsize for x in pre], np.int64)
    off = np.r_[0, np.cumsum(size)]
    flat = np.frombuffer(b"".join(pre), dt)
    out, live, k = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(live):
        live = live[(size[a[live]] > k) & (size[b[live]] > k)]
        x, y = flat[off[a[live]] + k], flat[off[b[live]] + k]
        same = (x["h"] == y["h"]) & (x["n"] == y["n"])
        live = live[same]
        out[live] += x["n"][same]
        k += 1
    return out


def neighbours(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each suffix of a sorted range the longer match with the nearest suffix of another document above or below. Also, for the seams between ranges, the suffixes at either end of the range that are of one document, and the next one of another."""
    t = t.filter(pa.compute.is_valid(t.column("pre")))
    if not t.num_rows:
        return
    doc, key, start = (t.column(k).to_numpy() for k in ("doc_id", "t", "start"))
    pre = t.column("pre").to_pylist()
    n, at = len(doc), np.arange(len(doc))
    new = np.r_[True, doc[1:] != doc[:-1]]
    first = np.maximum.accumulate(np.where(new, at, 0))
    last = np.minimum.accumulate(np.where(np.r_[new[1:], True], at, n)[::-1])[::-1]
    best, other = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o, ok in ((first - 1, first > 0), (last + 1, last < n - 1)):
        rows = at[ok]
        m = common_tokens(pre, rows, o[ok])
        better = (m > best[rows]) | ((m == best[rows]) & (m > 0) & (doc[o[ok]] < doc[other[rows]]))
        best[rows[better]], other[rows[better]] = m[better], o[ok][better]
    pid = TaskContext.get().partitionId()
    hit = np.flatnonzero(best)
    head, tail = np.arange(min(n, last[0] + 2)), np.arange(max(0, first[-1] - 1), n)
    edges = np.r_[head, tail]
    rows = np.r_[hit, edges]
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc[rows]), pa.array(key[rows]), pa.array(start[rows]), pa.array(best[rows].astype(np.int32)), pa.array(doc[other[rows]]), pa.array(key[other[rows]]), pa.array(start[other[rows]]), pa.array([None] * len(hit) + [pre[i] for i in edges], pa.binary()), pa.array(np.repeat([0, 1, 2], [len(hit), len(head), len(tail)]).astype(np.int32)), pa.array(np.full(len(rows), pid, np.int32)), pa.array(rows.astype(np.int32))],
        [c.split()[0] for c in _MATCH.split(", ")],
    )


def seams(edges: list) -> list[tuple]:
    """Matches across the seams: of each suffix at an end of its range that has only its own document between it and the end, with the nearest of another document beyond."""
    out = []
    for edge, step in ((2, 1), (1, -1)):
        # Going on upwards from the ends of ranges, then downwards from their beginnings.
        ends: dict[int, list] = {}
        for r in edges:
            ends.setdefault(r.pid, [[], []])[r.edge - 1].append(r)
        order = sorted(ends)[::step]
        near = {p: sorted(ends[p][2 - edge], key=lambda r: step * r.seq) for p in order}
        for k, p in enumerate(order):
            own = ends[p][edge - 1]
            d = max(own, key=lambda r: step * r.seq).doc_id
            beyond = next((r for q in order[k + 1 :] for r in near[q] if r.doc_id != d), None)
            if beyond is None:
                continue
            for r in own:
                if r.doc_id == d and (n := int(common_tokens([bytes(r.pre), bytes(beyond.pre)], np.array([0]), np.array([1]))[0])):
                    out.append((r.doc_id, r.t, r.start, n, beyond.doc_id, beyond.t, beyond.start))
    return out


def folded(chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matches of chains with equal ones of other documents, and the chains that the suffix array needs: one of each such class, and all others."""
    own = F.struct("doc_id", "t", F.col("starts")[0].alias("start"), "c")
    classes = cut(chain.groupBy("k").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo.doc_id <> hi.doc_id"), "classes")
    both = chain.join(classes, "k")
    partner = F.when(F.col("doc_id") == F.col("lo.doc_id"), F.col("hi")).otherwise(F.col("lo"))
    n = F.aggregate("lens", F.lit(0), lambda s, x: s + x)
    direct = both.select("doc_id", "t", F.col("starts")[0].alias("start"), n.alias("n"), partner.alias("o")).select("doc_id", "t", "start", "n", F.col("o.doc_id").alias("o_doc"), F.col("o.t").alias("o_t"), F.col("o.start").alias("o_start"))
    one = chain.join(classes.select("k", F.col("lo.c").alias("rep")), "k", "left").where("rep is null or c = rep").drop("k", "rep")
    return direct, one


def requests(matches: DataFrame, min_tokens: int) -> DataFrame:
    """Per document: what is certain, matches of at least min_tokens united (rid null), and the matches whose ends have to be extended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            out: list[tuple] = []
            for d, t, rows in zip(r.column("doc_id").to_pylist(), r.column("t").to_pylist(), r.column("rows").to_pylist()):
                rows.sort(key=lambda x: (x["start"], -x["n"], x["o_doc"], x["o_start"]))
                spans: list[list] = []
                for x in rows:
                    x["end"] = x["start"] + x["n"] + GRAM
                    if x["n"] + GRAM >= min_tokens:
                        if spans and x["start"] <= spans[-1][1]:
                            if x["end"] > spans[-1][1]:
                                spans[-1][1], spans[-1][3] = x["end"], x
                        else:
                            spans.append([x["start"], x["end"], x, x])
                ask = {id(x): x for s in spans for x in s[2:]}
                k, reach = 0, -1
                for x in rows:
                    while k < len(spans) and spans[k][1] < x["end"]:
                        k += 1
                    covered = k < len(spans) and spans[k][0] <= x["start"]
                    if x["n"] + GRAM < min_tokens and not covered and x["end"] > reach:
                        ask[id(x)] = x
                    reach = x["end"]
                out += [(d, t, s[0], s[1], s[2]["o_doc"], None, None) for s in spans]
                out += [(d, t, x["start"], x["end"], x["o_doc"], x["o_t"], x["o_start"]) for x in ask.values()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "t", "a", "b", "o_doc", "o_t", "o_a"])

    rows = matches.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "n", "o_doc", "o_t", "o_start")).alias("rows"))
    return rows.mapInArrow(run, "doc_id long, t int, a int, b int, o_doc long, o_t int, o_a int").withColumn("rid", F.expr("if(o_t is null, null, xxhash64(doc_id, t, a, b, o_doc, o_t, o_a))"))


def extended(docs: DataFrame, ask: DataFrame, min_tokens: int) -> DataFrame:
    """(doc_id, t, a, b, o_doc): the asked matches, grown at both ends as far as both documents agree, min_tokens at most."""
    sides = ask.selectExpr("rid", "0 as role", "doc_id", "t", "a", "b").union(ask.selectExpr("rid", "1", "o_doc", "o_t", "o_a", "o_a + b - a")).distinct()
    sides = sides.groupBy("doc_id").agg(F.collect_list(F.struct("rid", "role", "t", "a", "b")).alias("asks"))

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in slices(batches):
            tok = Tokens(r.column("text"))
            out: list[tuple] = []
            for k, asks in enumerate(r.column("asks").to_pylist()):
                h = (own := tok.h[tok.off[k] : tok.off[k + 1]]) >> U64(32)
                key, h = text_key(own), h.astype(np.uint32)
                for q in asks:
                    if q["t"] == key:
                        out.append((q["rid"], q["role"], h[max(0, q["a"] - min_tokens) : q["a"]][::-1].tobytes(), h[q["b"] : q["b"] + min_tokens].tobytes()))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["rid", "role", "before", "after"])

    near = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sides, "doc_id").mapInArrow(context, "rid long, role int, before binary, after binary").dropDuplicates(["rid", "role"])

    def agree(x: bytes, y: bytes) -> int:
        p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        n = min(len(p), len(q))
        off = np.flatnonzero(p[:n] != q[:n])
        return int(off[0]) if len(off) else n

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            c = {k: r.column(k).to_pylist() for k in ("l0", "l1", "g0", "g1")}
            left = np.array([agree(x, y) for x, y in zip(c["l0"], c["l1"])], np.int32)
            right = np.array([agree(x, y) for x, y in zip(c["g0"], c["g1"])], np.int32)
            yield pa.RecordBatch.from_arrays([r.column("doc_id"), r.column("t"), pa.array(r.column("a").to_numpy() - left), pa.array(r.column("b").to_numpy() + right), r.column("o_doc")], ["doc_id", "t", "a", "b", "o_doc"])

    both = ask.dropDuplicates(["rid"]).select("rid", "doc_id", "t", "a", "b", "o_doc")
    for k in (0, 1):
        both = both.join(near.where(F.col("role") == k).selectExpr("rid", f"before as l{k}", f"after as g{k}"), "rid")
    return both.drop("rid").mapInArrow(grow, "doc_id long, t int, a int, b int, o_doc long").where(f"b - a >= {min_tokens}")


@owned
def repeats(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, first_token, n_tokens, other_doc_id) for each passage of at least min_tokens tokens that another document has too."""
    if min_tokens < 2 * WINDOW + GRAM - 1:
        raise ValueError(f"min_tokens must be at least {2 * WINDOW + GRAM - 1}")
    spark = docs.sparkSession
    seen = phrases(docs).selectExpr("*", "min(struct(doc_id, t)) over (partition by h) as lo", "max(struct(doc_id, t)) over (partition by h) as hi").where("lo <> hi").drop("lo", "hi")
    direct, one = folded(cut(chains(seen), "chains"))
    found = cut(suffixes(cut(one, "distinct"), True), "matches")
    columns = ["doc_id", "t", "start", "n", "o_doc", "o_t", "o_start"]
    matches = found.where("edge = 0").select(columns).union(direct)
    extra = seams(found.where("edge > 0").collect())  # a few rows a range
    if extra:
        matches = matches.union(spark.createDataFrame(extra, "doc_id long, t int, start int, n int, o_doc long, o_t int, o_start int"))
    asked = cut(requests(matches, min_tokens), "requests")
    sure = asked.where("rid is null").select("doc_id", "t", "a", "b", "o_doc")
    all_spans = sure.union(extended(docs, asked.where("rid is not null"), min_tokens))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            out: list[tuple] = []
            for d, spans in zip(r.column("doc_id").to_pylist(), r.column("spans").to_pylist()):
                spans = sorted((s["t"], s["a"], s["b"], s["o_doc"]) for s in spans)
                held = None
                for t, a, b, o in spans:
                    if held and held[0] == t and a <= held[2]:
                        held[2] = max(held[2], b)
                    else:
                        if held:
                            out.append((d, held[1], held[2] - held[1], held[3]))
                        held = [t, a, b, o]
                out.append((d, held[1], held[2] - held[1], held[3]))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "first_token", "n_tokens", "other_doc_id"])

    return all_spans.groupBy("doc_id").agg(F.collect_list(F.struct("t", "a", "b", "o_doc")).alias("spans")).mapInArrow(unite, "doc_id long, first_token long, n_tokens long, other_doc_id long")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
SQL: dict[str, str] = {}
