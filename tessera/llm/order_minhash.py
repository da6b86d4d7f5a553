"""Near-duplicate groups by Order MinHash, verified by banded alignment.

Sketch: every k-mer of tokens is labelled with its occurrence number within
the document; for each of m hash functions the l labelled k-mers with the
smallest hashes are kept in text order, and the hash of that ordered tuple is
one sketch entry. Two documents agree in an entry with a probability that
follows their edit similarity (Order MinHash), not only their sets. Documents
with equal token sequences are folded into one first.

Candidates: all pairs of texts that have an entry in common, whatever the size of
its group. Each text carries a bag, a table of bits that tells which of its
hashed tokens stand in it once and which twice; what one bag has and the other
lacks is a lower bound of the edit distance, so a pair over the threshold is
rejected for certain without its texts. In a first round every member of a group is
aligned with the lowest id among those that its bag doesn't reject, and texts
that are linked make classes. Where a group holds more such pairs, a last round
aligns all of them whose texts aren't of one class yet. So a group of n copies
costs about n alignments, and every pair of a group is aligned, or rejected by a
bound, or of one class: no candidate is dropped. A group of over PAIRED members is
laid out in tiles, each a task's work of at most PAIRED squared bags, so a hot
group needs no task of its own; the number of bags compared grows with its
square, that of alignments with the pairs that the bags leave.

Verification: edit distance over tokens, restricted to the diagonal band that
the similarity threshold allows; exact within the band, so a pair is accepted if
and only if 1 - distance / longer length >= threshold. Pairs of a batch are
aligned together, first in a narrow band, which is enough for most copies; wide
bands are bit-parallel. Texts of over LONG tokens are cut at anchors (8-grams
that stand once in each, in the same order) and aligned between them, which gives
an upper bound of their distance; only if that is over the threshold they are aligned whole.

Defined results: a null text counts as an empty one; documents without tokens
(null, empty, only punctuation) carry no evidence and are never duplicates;
rows with a null doc_id are compared with nothing and dedup() keeps them. Rows
that repeat a doc_id are further texts of that document: it is a near copy if
any of them is, and dedup() keeps or drops them together. Other columns play
no part, whatever their names. An empty table gives an empty result. Of equal claims the lowest
doc_id stays. Scripts without blanks are compared by characters (see common).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Tokens, cut, drop_ids, mix, mix_in, mix_int, only_ids, owned, slices, table, window_hash

K, L, M = 3, 2, 32
SIMILARITY = 0.8
PIVOT_ROUNDS, PAIRED = 1, 4096
LEAST_BAG = 128  # buckets, of which a bag has at least as many as its text has tokens
ROWS = 20_000  # members of groups that are compared together
NARROW, WIDE, LONG, ANCHOR = 16, 300, 200_000, 8  # half bands, tokens
CELLS = 20_000  # of one row of all tables that are computed together; small enough for the cache
LIKELY = 16  # k-mers of a document that are looked at for an entry, on average
_TOP = U64(2**64 - 1)


def occurrence(keys: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each key: how many equal ones stand before it in its document."""
    doc = np.repeat(np.arange(len(off) - 1, dtype=U64), np.diff(off))
    joint = mix(keys + doc * U64(0x9E3779B97F4A7C15))
    order = np.argsort(joint, kind="stable")
    s = joint[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0)) if len(s) else np.zeros(0, np.int64)
    out = np.empty(len(s), U64)
    out[order] = (np.arange(len(s)) - first).astype(U64)
    return out


def sketch(h: np.ndarray, off: np.ndarray, k: int = K, l: int = L, m: int = M) -> np.ndarray:
    """m entries for each document with a token; documents of under k tokens are one k-mer."""
    n = np.diff(off)
    size = np.maximum(n - k + 1, 1)
    o2 = np.r_[0, np.cumsum(size)]
    km = np.empty(o2[-1], U64)
    whole = window_hash(np.r_[h, np.zeros(k, U64)], tuple(range(k)))
    at = np.arange(o2[-1]) - np.repeat(o2[:-1], size) + np.repeat(off[:-1], size)
    km[:] = whole[at]
    for i in np.flatnonzero(n < k):
        km[o2[i]] = window_hash(h[off[i] : off[i + 1]], tuple(range(n[i])), 77)[0]
    km = mix(km + occurrence(km, o2) * U64(0xD6E8FEB86659FD93))
    out = np.empty((len(n), m), U64)
    starts = o2[:-1]
    # Few k-mers can be among a document's l least: those under a bound that some LIKELY of them meet. Documents with fewer than l of them there are taken whole.
    bound = np.repeat(np.where(size <= LIKELY, _TOP, (LIKELY / np.maximum(size, LIKELY + 1) * 2.0**64).astype(U64)), size) if len(n) else km
    h1, spare, low = np.empty_like(km), np.empty_like(km), np.empty(len(km), bool)  # memory is touched once, not for each entry
    for j in range(m):
        x = np.bitwise_xor(km, U64(mix_int(j + 31)), out=h1)
        mix_in(x, spare)
        np.less_equal(x, bound, out=low)
        count = np.add.reduceat(low, starts, dtype=np.int64)
        if (few := count < np.minimum(l, size)).any():
            low |= np.repeat(few, size)
            count = np.where(few, size, count)
        at = np.flatnonzero(low)
        x, doc, first_at = x[at], np.repeat(np.arange(len(n)), count), np.r_[0, np.cumsum(count)[:-1]]
        chosen, places = [], []
        for i in range(l):
            least = np.minimum.reduceat(x, first_at)
            where = np.flatnonzero(x == least[doc])
            d = doc[where]
            first = np.r_[True, d[1:] != d[:-1]]
            where = where[first]
            x[where] = _TOP
            where = at[where]
            if i:
                short = size <= i
                where = np.where(short, np.iinfo(np.int64).max, where)
                least = np.where(short, U64(0), least)
            chosen.append(least)
            places.append(where)
        order = np.argsort(np.stack(places, 1), axis=1, kind="stable")
        got = np.take_along_axis(np.stack(chosen, 1), order, 1)
        e = np.full(len(n), mix_int(j), U64)
        for i in range(l):
            e = mix(e * U64(0x9E3779B97F4A7C15) + got[:, i])
        out[:, j] = e
    return out


def banded_distance(a: list[int], b: list[int], limit: int) -> int:
    """Edit distance of two sequences, or limit + 1 if it is above limit.

    Common ends are cut off; then Myers' bit-vector recurrence runs over the
    window of 2 * limit + 1 diagonals, which slides down one row a step.
    """
    n = min(len(a), len(b))
    p = 0
    while p < n and a[p] == b[p]:
        p += 1
    q = 0
    while q < n - p and a[-1 - q] == b[-1 - q]:
        q += 1
    a, b = a[p : len(a) - q], b[p : len(b) - q]
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if not a or not b:
        return max(len(a), len(b))
    if len(a) > len(b):
        a, b = b, a
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    low = {x: 0 for x in places}
    w = 2 * limit + 1
    full = (1 << w) - 1
    # In column j bit r of the window is row j - limit + r of a; rows above the first cost nothing downwards.
    vp, vn = full & ~((1 << limit) - 1), 0
    n_a = len(a)
    score = min(limit, n_a)  # followed along the lowest diagonal, then along the last row
    top = 1 << (w - 1)
    for j, y in enumerate(b):
        eq = 0
        if (ps := places.get(y)) is not None:
            base = j - limit
            i = low[y]
            while i < len(ps) and ps[i] < base:
                i += 1
            low[y] = i
            while i < len(ps) and (r := ps[i] - base) < w:
                eq |= 1 << r
                i += 1
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        x = d0 >> 1
        vn = x & hp
        vp = hn | (full & ~(x | hp))
        if j + limit < n_a:
            score += 0 if d0 & top else 1
        else:
            r = n_a - 1 - (j - limit)  # the last row in this column's window
            if hp >> r & 1:
                score += 1
            elif hn >> r & 1:
                score -= 1
    return score if score <= limit else limit + 1


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b without their common ends, the shorter one first."""
    n = min(len(a), len(b))
    off = np.flatnonzero(a[:n] != b[:n])
    p = int(off[0]) if len(off) else n
    off = np.flatnonzero(a[len(a) - n + p :][::-1] != b[len(b) - n + p :][::-1])
    q = int(off[0]) if len(off) else n - p
    a, b = a[p : len(a) - q], b[p : len(b) - q]
    return (a, b) if len(a) <= len(b) else (b, a)


def batch_distances(pairs: list[tuple[np.ndarray, np.ndarray]], half: int) -> np.ndarray:
    """Edit distances of pairs (shorter, longer) in a band of half diagonals to either side; exact where they are at most half, else some larger number. All rows of all pairs' tables are computed together."""
    n, far = len(pairs), np.int32(1 << 24)
    la, lb = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    out = np.full(n, half + 1, np.int64)
    live = np.flatnonzero(lb - la <= half)
    w, rows = 2 * half + 1, int(la[live].max(initial=0))
    if not len(live):
        return out
    # Cells beyond a text's end are never followed, so it doesn't matter what fills it up.
    x = np.zeros((n, rows), np.uint32)
    y = np.zeros((n, max(rows, int(lb[live].max())) + 2 * w), np.uint32)
    for k in live:
        x[k, : la[k]] = pairs[k][0]
        y[k, half : half + lb[k]] = pairs[k][1]
    x, y, k = x[live], y[live], np.arange(w, dtype=np.int32)
    d = np.tile(np.where(k >= half, k - half, far), (len(live), 1)).astype(np.int32)
    for i in range(rows + 1):
        if i:
            t = d + (x[:, i - 1 : i] != y[:, i - 1 : i - 1 + w])
            t[:, :-1] = np.minimum(t[:, :-1], d[:, 1:] + 1)
            if i <= half:
                t[:, : half - i] = far
            d = np.minimum.accumulate(t - k, axis=1) + k
        over = la[live] == i
        if over.any():
            out[live[over]] = d[over, lb[live[over]] - i + half]
        if over.any() or i % 16 == 0:
            stay = ~over & (d.min(1) <= half)
            if not stay.all():
                live, x, y, d = live[stay], x[stay], y[stay], d[stay]
                if not len(live):
                    break
    return out


def anchored(a: np.ndarray, b: np.ndarray, limit: int, longest: int = LONG) -> int:
    """An upper bound of the edit distance of two long texts, or limit + 1 above that: the sum over the stretches between anchors."""
    keys = [window_hash(x.astype(U64), tuple(range(ANCHOR)), 9) for x in (a, b)]
    once = []
    for h in keys:
        v, first, c = np.unique(h, return_index=True, return_counts=True)
        once.append((v[c == 1], first[c == 1]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    at = np.stack([once[0][1][i], once[1][1][j]], 1)
    at = at[np.argsort(at[:, 0])]
    at = at[np.r_[True, np.diff(at[:, 0] // 64) > 0]] if len(at) else at  # one anchor in 64 tokens is enough
    # The longest chain that rises in both texts.
    ends: list[int] = []
    last: list[int] = []
    before = np.full(len(at), -1)
    for r, place in enumerate(at[:, 1].tolist()):
        k = bisect_left(ends, place)
        before[r] = last[k - 1] if k else -1
        ends[k : k + 1] = [place]
        last[k : k + 1] = [r]
    chain, r = [], last[-1] if last else -1
    while r >= 0:
        chain.append(at[r])
        r = before[r]
    total, p, q = 0, 0, 0
    for x, y in [*chain[::-1], (len(a), len(b))]:
        s, t = trimmed(a[p:x], b[q:y])
        total += max(len(s), len(t)) if max(len(s), len(t)) > longest else banded_distance(s.tolist(), t.tolist(), min(limit - total, len(t)))
        if total > limit:
            return limit + 1
        p, q = x, y
    return total


def unmatched(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens of one text have no partner in the other."""
    both, sign = np.concatenate([a, b]), np.ones(len(a) + len(b), np.int32)
    sign[len(a) :] = -1
    order = np.argsort(both, kind="stable")
    s = both[order]
    gap = np.add.reduceat(sign[order], np.flatnonzero(np.r_[True, s[1:] != s[:-1]]))
    return max(int(gap[gap > 0].sum()), int(-gap[gap < 0].sum()))


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """Whether 1 - edit distance / longer length >= least, for each pair; cheap lower bounds of the distance come first."""
    ok, todo = np.zeros(len(pairs), bool), []
    for k, (a, b) in enumerate(pairs):
        n = max(len(a), len(b))
        limit = int(n * (1 - least) + 1e-9)
        if abs(len(a) - len(b)) > limit:
            continue
        if np.array_equal(a, b):
            ok[k] = True
            continue
        if unmatched(a, b) > limit:
            continue
        if n > LONG:
            ok[k] = anchored(a, b, limit) <= limit or banded_distance(*(x.tolist() for x in trimmed(a, b)), limit) <= limit
        else:
            todo.append((k, limit, *trimmed(a, b)))
    for half in (NARROW, WIDE):
        # In the narrow band a pair is decided if its limit lies in it, or its distance does.
        todo.sort(key=lambda x: len(x[2]))
        rest, at = [], 0
        while at < len(todo):
            band, to, size = min(half, todo[at][1]), at, 0
            while to < len(todo) and (to - at + 1) * (2 * max(band, min(half, todo[to][1])) + 1) <= CELLS and size < 4_000_000:
                band = max(band, min(half, todo[to][1]))
                size += len(todo[to][3]) + 2 * band
                to += 1
            some = todo[at : max(to, at + 1)]
            at += len(some)
            d = batch_distances([x[2:] for x in some], band)
            for (k, limit, a, b), x in zip(some, d):
                if x <= min(limit, band):
                    ok[k] = True
                elif limit > band:
                    rest.append((k, limit, a, b))
        todo = [x for x in rest if x[1] <= WIDE]
        for k, limit, a, b in rest:
            if limit > WIDE:
                ok[k] = banded_distance(a.tolist(), b.tolist(), limit) <= limit
    return ok


def bags(tok: np.ndarray, off: np.ndarray) -> list[bytes]:
    """For each text two planes of bits, of the buckets that hold a token of it, and of those that hold two. tok: 32-bit tokens, as they are aligned."""
    n = np.diff(off)
    size = np.maximum(LEAST_BAG, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    at = np.r_[0, np.cumsum(size)]
    count = np.bincount(np.repeat(at[:-1], n) + (tok.astype(np.int64) & np.repeat(size - 1, n)), minlength=at[-1])
    one, two = (np.packbits(count >= k, bitorder="little").tobytes() for k in (1, 2))
    return [one[i:j] + two[i:j] for i, j in zip((at[:-1] // 8).tolist(), (at[1:] // 8).tolist())]


class Bags:
    """Bags by the number of words of a plane, those of somewhat longer texts folded to the same size."""

    def __init__(self, bags: pa.Array, least: float):
        bags = bags.cast(pa.large_binary())
        off = np.frombuffer(bags.buffers()[1], np.int64)[bags.offset : bags.offset + len(bags) + 1]
        words = np.frombuffer(bags.buffers()[2], np.uint64, (off[-1] - off[0]) // 8, off[0])
        first, self.size = (off[:-1] - off[0]) // 8, np.diff(off) // 16
        self.tables = {}
        upper = np.zeros(0, np.int64), np.zeros((0, 0), U64)
        sizes = np.unique(self.size)
        w = int(sizes[-1]) if len(sizes) else 0
        while w >= (int(sizes[0]) if len(sizes) else 1):
            rows, planes = upper
            if len(rows):
                near = self.size[rows] * least <= 2 * w  # longer ones are never compared with these
                rows, planes = rows[near], planes[near]
                a, b, c, d = (planes[:, i * w : (i + 1) * w] for i in range(4))
                planes = np.hstack([a | b, c | d | a & b])
            own = np.flatnonzero(self.size == w)
            rows = np.r_[rows, own]
            planes = np.vstack([planes.reshape(-1, 2 * w), words[first[own][:, None] + np.arange(2 * w)]])
            place = np.full(len(self.size), -1)
            place[rows] = np.arange(len(rows))
            self.tables[w] = place, planes, np.bitwise_count(planes).sum(1, dtype=np.int64)
            upper = rows, planes
            w //= 2

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A lower bound of the edit distance of each text i and j, j not being shorter."""
        out = np.empty(len(i), np.int64)
        for w in np.unique(self.size[i]):
            place, planes, held = self.tables[int(w)]
            mine = np.flatnonzero(self.size[i] == w)
            for at in np.split(mine, range(step := max(1, 250_000 // int(w)), len(mine), step)):
                x, y = place[i[at]], place[j[at]]
                out[at] = np.maximum(held[x], held[y]) - np.bitwise_count(planes[x] & planes[y]).sum(1, dtype=np.int64)
        return out


def sketches(docs: DataFrame, k: int = K, l: int = L, m: int = M) -> DataFrame:
    """(doc_id, key, n, entries, bag) for every document with a token; key is a 128-bit hash of the n tokens in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = Tokens(b.column("text"))
            n = np.diff(t.off)
            has = np.flatnonzero(n)
            if not len(has):
                continue
            off = np.r_[0, np.cumsum(n[has])]
            e = sketch(t.h, off, k, l, m)
            key = [xxhash.xxh128_digest(t.h[t.off[i] : t.off[i + 1]].tobytes()) for i in has]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(has)), pa.array(key, pa.binary()), pa.array(n[has].astype(np.int32)), pa.ListArray.from_arrays(np.arange(0, e.size + 1, m, dtype=np.int32), pa.array(e.view(np.int64).ravel())), pa.array(bags(t.h >> U64(32), off), pa.binary())],
                ["doc_id", "key", "n", "entries", "bag"],
            )

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key binary, n int, entries array<long>, bag binary")


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, tok): the tokens as packed 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = Tokens(b.column("text"))
            h = (t.h >> U64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([h[i:j].tobytes() for i, j in zip(t.off[:-1], t.off[1:])], pa.binary())], ["doc_id", "tok"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tok binary")


def verified(pairs: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """(a, b, ok) for each pair (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            sides = zip(r.column("ta"), r.column("tb"))
            ok = similar([(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) for x, y in sides], least)
            yield pa.RecordBatch.from_arrays([r.column("a"), r.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    one = pairs.join(tokens.select(F.col("doc_id").alias("a"), F.col("tok").alias("ta")), "a")
    two = one.join(tokens.select(F.col("doc_id").alias("b"), F.col("tok").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, ok boolean").groupBy("a", "b").agg(F.max("ok").alias("ok"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that is connected with each node of the edges (a, b)."""
    e = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    lab = cut(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = e.join(lab.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = lab.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        lab = new.select("node", "label")


def compared(t: pa.Table, least: float, every: bool) -> pa.RecordBatch:
    """(g, a, b) of pairs of one group that their bags don't reject; t: g, side, doc_id, label, n, bag, by g and n, whole groups. Without every only the lowest partner of each member, and a row without a and b for each group that has more pairs."""
    g, side, ident, label, n = (t.column(c).to_numpy() for c in ("g", "side", "doc_id", "label", "n"))
    bag = Bags(t.column("bag").combine_chunks(), least)
    most = np.floor(n * (1 - least) + 1e-9).astype(np.int64)
    group = np.cumsum(np.r_[0, g[1:] != g[:-1]])
    best, found = np.full(len(g), np.iinfo(np.int64).max), np.zeros(group[-1] + 1, np.int64)
    out, i, step = [], np.arange(len(g)), 0
    while len(i):
        step += 1
        i = i[i + step < len(g)]
        j = i + step
        stay = (g[i] == g[j]) & (n[j] - n[i] <= most[j])  # those further on are longer still
        i, j = i[stay], j[stay]
        some = np.flatnonzero((label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j])))
        some = some[bag.apart(i[some], j[some]) <= most[j[some]]]
        x, y = i[some], j[some]
        x, y = np.where(ident[x] > ident[y], x, y), np.where(ident[x] > ident[y], y, x)
        if every:
            out.append(np.stack([g[x], ident[x], ident[y]]))
        else:
            np.minimum.at(best, x, ident[y])
            found += np.bincount(group[x], minlength=len(found))
    if every:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.hstack(out)], ["g", "a", "b"])
    has = np.flatnonzero(best < np.iinfo(np.int64).max)
    more = np.flatnonzero(found > np.bincount(group[has], minlength=len(found)))
    more = g[np.searchsorted(group, more)]
    none = pa.nulls(len(more), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.r_[g[has], more]), *(pa.concat_arrays([pa.array(x[has]), none]) for x in (ident, best))], ["g", "a", "b"])


def candidates(groups: DataFrame, texts: DataFrame, labels: DataFrame | None, least: float, every: bool) -> DataFrame:
    """What compared() gives for the groups (g, side, doc_id) of texts (doc_id, n, bag); documents of one label (node, label) are linked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                g = t.column("g").to_numpy()
                if whole := int(np.searchsorted(g, g[-1])):
                    yield compared(t.slice(0, whole), least, every)
                held = t.slice(whole).to_batches()
        if sum(x.num_rows for x in held):
            yield compared(pa.Table.from_batches(held), least, every)

    t = groups.join(texts, "doc_id")
    if labels is None:
        t = t.withColumn("label", F.col("doc_id"))
    else:
        t = t.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    t = t.select("g", F.col("side").cast("long").alias("side"), "doc_id", "label", F.col("n").cast("long").alias("n"), "bag")
    return t.repartition("g").sortWithinPartitions("g", "n", "doc_id").mapInArrow(run, "g long, a long, b long")


def tiled(groups: DataFrame, paired: int) -> DataFrame:
    """(g, side, doc_id): the groups (e, doc_id, size), those of over paired members as tiles. Members of one group that meet in no other tile are of different sides, or all of side -1."""
    g = groups.withColumn("parts", F.ceil(F.col("size") / paired)).withColumn("own", F.expr("pmod(xxhash64(doc_id, 5), parts)"))
    g = g.withColumn("other", F.explode(F.expr("if(parts = 1, array(0L), sequence(0L, parts - 1))")))
    tile = F.when(F.col("parts") == 1, F.col("e")).otherwise(F.xxhash64("e", F.least("own", "other"), F.greatest("own", "other")))
    return g.select(tile.alias("g"), F.expr("case when own = other then -1 when own < other then 0 else 1 end").alias("side"), "doc_id")


def near_pairs(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, l: int = L, m: int = M, pivot_rounds: int = PIVOT_ROUNDS, paired: int = PAIRED) -> tuple[DataFrame, DataFrame]:
    """Accepted pairs of different token sequences (a, b) that link all texts that a chain of such pairs with entries in common links, and equal sequences (a, b); a > b."""
    sk = cut(sketches(docs, k, l, m), "sketches")
    reps = cut(sk.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("entries").alias("entries"), F.first("bag").alias("bag")), "texts")
    same = sk.select("key", "doc_id").join(reps.select("key", "rep"), "key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    texts = reps.select(F.col("rep").alias("doc_id"), "n", "bag")
    firsts = reps.select(F.col("rep").alias("doc_id"), F.explode("entries").alias("e"))
    ends = firsts.groupBy("e").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("other"), F.count("*").alias("size")).where("least <> other").select("e", "size")
    left = cut(tiled(firsts.join(ends, "e").distinct(), paired), "groups")
    done = labels = tokens = None
    for turn in range(pivot_rounds + 1):
        last = turn == pivot_rounds
        found = cut(candidates(left, texts, labels, similarity, last), "found")
        pairs = found.where("a is not null").select("a", "b").distinct()
        left = cut(left.join(found.where("a is null").select("g").distinct(), "g", "left_semi"), "left")
        if tokens is None:
            ids = pairs.select("a").union(pairs.select("b")).union(left.select("doc_id")).toDF("id")
            tokens = cut(token_table(only_ids(docs, ids)), "tokens")
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        new = cut(verified(pairs, tokens, similarity), "verified")
        done = new if done is None else done.union(new)
        if last or left.isEmpty():
            break
        labels = components(done.where("ok"))
    return done.where("ok").select("a", "b"), same


@owned
def duplicates(docs: DataFrame, similarity: float = SIMILARITY, **sizes: int) -> DataFrame:
    """(doc_id, keep_id): each document that is a near copy, with the lowest doc_id of its group."""
    near, same = near_pairs(docs, similarity, **sizes)
    return components(near.union(same)).where("node <> label").select(F.col("node").alias("doc_id"), F.col("label").alias("keep_id"))


@owned
def dedup(docs: DataFrame, similarity: float = SIMILARITY, **sizes: int) -> DataFrame:
    """docs with one document of each group."""
    return drop_ids(docs, duplicates(docs, similarity, **sizes).select("doc_id"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op5_order_minhash": op5_order_minhash}
SQL: dict[str, str] = {}
