"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash of their doc_id, form blocks of
block_docs. A source of weight w (the weights sum to 1) releases its block j
(from 1) at slot floor((j - 1) / w) and has to be done with it by slot
ceil(j / w); every slot takes, of the released blocks, the one with the
earliest deadline (ties: the source first by name). On one line of slots this
meets all deadlines, so at any slot each source is less than one block away
from its exact share.

Weights are whole parts of PARTS (more where there are many sources), so the
schedule repeats after one period: only that, PARTS steps whatever the data, is
simulated on the driver, and every block's slot follows from its number. The
default target is each source's own share of the documents; any other may be
given, or, only when asked for, a cap on a source's share.

Without a target or a cap no document is left out: the mix ends when all
sources are used up. Whole parts round the weights (a source worth under two
parts gets one), so a source may be done before others; it then leaves the
schedule, its slots stay empty, and the others go on in theirs. With a target
or cap the mix is as large as the exact weights allow: the source that is
scarcest by its weight is used up, and every other gives its weight's share of
that size, in whole blocks. Ranks within a source come from counts of hash
ranges and a rank within each range, so a hot source needs no task of its own.

Defined results: a null source is a source of its own (named by null), last in
ties; rows with a null doc_id take part, ordered by hash of the text, and equal
doc_ids are ordered by it too; identical repeated rows take successive places.
Null, empty and very long texts count as documents. A source with target 0, or
without a given target, takes no part; a target of a source without documents
is left out and the others share its part. An empty table gives an empty mix.
Other columns play no part, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, col, cut, fresh, owned, table

BLOCK_DOCS = 8
PARTS = 10_000
RANGE_ROWS = 50_000


def capped(counts: Mapping[str | None, int], cap: float = 1.0) -> dict[str | None, float]:
    """Shares in proportion to counts, none above cap unless there are too few sources for that."""
    cap = max(cap, 1 / max(1, len(counts)))
    fixed: set = set()
    while True:
        rest = sum(n for s, n in counts.items() if s not in fixed)
        free = 1 - cap * len(fixed)
        shares = {s: cap if s in fixed else free * n / rest for s, n in counts.items()}
        over = {s for s, x in shares.items() if x > cap + 1e-12 and s not in fixed}
        if not over:
            return shares
        fixed |= over


def by_name(s: str | None) -> tuple[bool, str]:
    return s is None, s or ""


def whole_parts(weights: Mapping[str | None, float], parts: int = PARTS) -> dict[str | None, int]:
    """Largest remainders. A source worth under two parts gets one, the others share the rest; parts is at least four for each source."""
    weights = {s: w for s, w in weights.items() if w > 0}
    if not weights:
        return {}
    parts = max(parts, 4 * len(weights))
    total = sum(weights.values())
    small = {s for s, w in weights.items() if w * parts < 2 * total}
    rest, left = sum(w for s, w in weights.items() if s not in small), parts - len(small)
    if not rest:
        return dict.fromkeys(weights, 1)
    exact = {s: w * left / rest for s, w in weights.items() if s not in small}
    out = dict.fromkeys(small, 1) | {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], by_name(s)))[: parts - sum(out.values())]:
        out[s] += 1
    return out


def period(parts: Mapping[str | None, int]) -> list[str | None]:
    """The source of each slot of one period: earliest deadline first among the released blocks."""
    n = sum(parts.values())
    names = sorted(parts, key=by_name)
    waiting = [(0, k, 1) for k in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(n):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * n // parts[names[k]]), k, j))
        _, k, j = heapq.heappop(ready)
        out.append(names[k])
        if j < parts[names[k]]:
            heapq.heappush(waiting, (j * n // parts[names[k]], k, j + 1))
    return out


def ranked(docs: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, dict[str | None, int]]:
    """(doc_id, source, th, rank from 0 within the source), th being the text's hash, and the documents of each source."""
    ident = F.col("doc_id").cast("long")
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    base = docs.select(ident.alias("doc_id"), "source", F.coalesce(F.md5(ident.cast("string")), text).alias("h"), F.xxhash64("text").alias("th"))
    base = cut(base, "order")
    ranges = max(1, base.count() // range_rows)
    base = base.withColumn("r", F.expr(f"coalesce(cast(conv(substr(h, 1, 8), 16, 10) as bigint) * {ranges} div 4294967296L, 0)"))
    sizes = cut(base.groupBy("source", "r").count(), "ranges")
    before = sizes.selectExpr("source as b_source", "r as b_r", "sum(count) over (partition by source order by r) - count as before")
    counts = {r[0]: r[1] for r in sizes.groupBy("source").agg(F.sum("count")).collect()}  # a row a source
    own = base.selectExpr("doc_id", "source", "r", "th", "row_number() over (partition by source, r order by h, doc_id, th) - 1 as own")
    on = (F.col("r") == F.col("b_r")) & F.col("source").eqNullSafe(F.col("b_source"))
    return own.join(before, on).selectExpr("doc_id", "source", "th", "before + own as rank"), counts


def last_blocks(counts: Mapping[str | None, int], weights: Mapping[str | None, float], block_docs: int = BLOCK_DOCS) -> dict[str | None, int]:
    """The blocks that each source gives to the largest mix at these weights, which don't have to sum to 1."""
    size = min((counts[s] / w for s, w in weights.items() if w > 0), default=0.0)
    return {s: min(-(-counts[s] // block_docs), max(1, ceil(w * size / block_docs - 1e-9))) for s, w in weights.items() if w > 0}


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, sent to the tasks if its rows are few enough for that."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def placed(docs: DataFrame, target: Mapping[str | None, float] | None = None, block_docs: int = BLOCK_DOCS, parts: int = PARTS, cap: float | None = None) -> DataFrame:
    """What mixed() gives, with th, the hash of the text."""
    spark = docs.sparkSession
    rows, counts = ranked(docs)
    free = target is None and cap is None
    weights = ({s: float(n) for s, n in counts.items()} if free else capped(counts, cap)) if target is None else {s: w for s, w in target.items() if counts.get(s)}
    share = whole_parts(weights, parts)
    line = period(share)
    n = len(line)
    at: dict[str | None, list[int]] = {s: [] for s in share}
    for slot, s in enumerate(line):
        at[s].append(slot)
    last = {s: -(-counts[s] // block_docs) for s in share} if free else last_blocks(counts, weights, block_docs)
    plan = [(s, j, slot, share[s], last[s]) for s in share for j, slot in enumerate(at[s])]
    plan = spark.createDataFrame(plan, "p_source string, j int, p_slot int, own int, last long")  # one row a slot of the period
    wanted = spark.createDataFrame([(s, w) for s, w in share.items()], "w_source string, w int")
    rows = rows.withColumn("block", F.expr(f"rank div {block_docs}"))
    rows = rows.join(small(wanted, len(share)), F.col("source").eqNullSafe(F.col("w_source")))
    on = F.col("source").eqNullSafe(F.col("p_source")) & (F.expr("block % w") == F.col("j")) & (F.col("block") < F.col("last"))
    out = rows.join(small(plan, n), on).withColumn("slot", F.expr(f"block div own * {n} + p_slot"))
    return out.selectExpr("doc_id", "th", "source", "block", "slot", f"block * {n} div own as release", f"((block + 1) * {n} + own - 1) div own as deadline", f"slot * {block_docs} + rank % {block_docs} as place")


@owned
def mixed(docs: DataFrame, target: Mapping[str | None, float] | None = None, **settings: float) -> DataFrame:
    """(doc_id, source, block, slot, release, deadline, place): the mix; place orders the documents, from 0 on with gaps after short blocks and in the slots of sources that are done."""
    return placed(docs, target, **settings).drop("th")


@owned
def mix(docs: DataFrame, target: Mapping[str | None, float] | None = None, **settings: float) -> DataFrame:
    """The documents of the mix, with docs' columns, in its order. Rows of one doc_id and text stand together at the first one's place."""
    ident, text, place = fresh(docs, "mix_id", "mix_text", "mix_place")
    m = placed(docs, target, **settings).groupBy(F.col("doc_id").alias(ident), F.col("th").alias(text)).agg(F.min("place").alias(place))
    on = col("doc_id").cast("long").eqNullSafe(col(ident)) & (F.xxhash64("text") == col(text))
    return docs.join(m, on).repartitionByRange(col(place)).sortWithinPartitions(col(place)).select(*map(col, docs.columns))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pfair_mix": op4_pfair_mix}
SQL = {
    "op4_pfair_mix": f"""
with recursive counts as (select source, count(*)::double as n from documents group by source),
total as (select *, sum(n) over () as t, greatest({PARTS}, 4 * count(*) over ())::bigint as p from counts),
exact as (select *, n * p < 2 * t as small, count(*) filter (where n * p < 2 * t) over () as k from total),
shared as (select *, case when not small then n * (p - k) / sum(case when small then 0 else n end) over () end as x from exact),
parts as (select source, n, p, case when small then 1 else floor(x)::bigint + case when row_number() over (order by floor(x) - x nulls last, source) <= p - k - sum(floor(x)) over () then 1 else 0 end end as w from shared),
listed as (select list(w order by source) as ws, list(source order by source) as names, max(p) as p from parts),
line(slot, ws, names, p, js, pick) as (
  select -1, ws, names, p, list_transform(ws, lambda w: 1::bigint), 0 from listed
  union all
  select slot + 1, ws, names, p, list_transform(js, lambda j, i: j + (i = q)::bigint), q from (
    select *, list_position(due, list_min(due)) as q from (
      select *, list_transform(js, lambda j, i: case when j <= ws[i] and (j - 1) * p // ws[i] <= slot + 1 then (j * p + ws[i] - 1) // ws[i] else 1000000000 end) as due from line where slot + 1 < p))
),
plan as (select slot as p_slot, names[pick] as source, js[pick] - 2 as j from line where slot >= 0),
ranked as (select doc_id, source, row_number() over (partition by source order by md5(doc_id::varchar), doc_id) - 1 as rank from documents),
placed as (select doc_id, r.source, rank, rank // {BLOCK_DOCS} as block, w, q.p, (rank // {BLOCK_DOCS}) // w * q.p + p_slot as slot from ranked r join parts q using (source) join plan p on p.source = r.source and p.j = (rank // {BLOCK_DOCS}) % w)
select doc_id, source, block, slot, block * p // w as release, ((block + 1) * p + w - 1) // w as deadline, slot * {BLOCK_DOCS} + rank % {BLOCK_DOCS} as place from placed"""
}
