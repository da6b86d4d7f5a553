"""Resharding by minimum-cost flow.

Every old shard's documents fall into blocks by a hash of doc_id; one
aggregation gives the bytes of each block. On the driver, whose work is linear
in blocks and shards and doesn't grow with documents, bytes flow from the old
shards to the new ones: staying costs nothing, moving one per byte (all moves
pass one hub, so the graph has as many edges as shards). Cycles of shortest
paths and blocking flows, one for each path cost there is, give the cheapest
flow, which moves the fewest bytes. The flow is then rounded to whole blocks:
each donor gives up the blocks that exceed its outflow least, and each goes to
the receiver of the flow with the most room, so a donor moves less than one
block more than the optimum. Documents learn their shard from the plan, a row
for each moved block; only the files of shards that lose blocks are rewritten,
and receivers get an added file.

With more than PLAN_ROWS blocks neighbouring ones are joined, so the plan stays
of that size; it is sent to the tasks up to BROADCAST_ROWS rows.

Defined results: a null shard is an old shard that must be emptied, as is one
without a capacity; a null or empty text has 0 bytes, a very long one makes a
large block; documents with equal doc_id share a block and stay together, those
with a null one are told apart by their text; repeated rows are
moved together. An existing column of the new name is replaced; other columns
are kept, whatever their names. Capacities that the corpus doesn't fit in, or whose room is too
scattered for whole blocks, raise ValueError. An empty table gives an empty result.
Of equal blocks the lowest number moves, of equal receivers the first by name.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, col, cut, fresh, owned, scratch, table, written

BLOCKS = 256
EXTRA_SHARDS = 4
SLACK = 1.05
PLAN_ROWS = 4_000_000


def cheapest_flow(nodes: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost): the cheapest of the largest flows; costs aren't negative. Primal-dual: for each cost of a shortest path all flow at that cost is sent by blocking flows."""
    graph: list[list[int]] = [[] for _ in range(nodes)]
    to, room, cost = [], [], []
    for a, b, cap, c in edges:
        for x, y, r, k in ((a, b, cap, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)
    potential = [0] * nodes
    while True:
        dist: list[float] = [math.inf] * nodes
        dist[source], queue = 0, [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > dist[x]:
                continue
            for e in graph[x]:
                if room[e] and (n := d + cost[e] + potential[x] - potential[to[e]]) < dist[to[e]]:
                    dist[to[e]] = n
                    heapq.heappush(queue, (n, to[e]))
        if dist[sink] == math.inf:
            return [room[2 * i + 1] for i in range(len(edges))]
        potential = [p + (int(d) if d < math.inf else 0) for p, d in zip(potential, dist)]
        free = lambda x, e: room[e] and cost[e] + potential[x] == potential[to[e]]
        while True:
            level, line = [-1] * nodes, deque([source])
            level[source] = 0
            while line:
                x = line.popleft()
                for e in graph[x]:
                    if level[to[e]] < 0 and free(x, e):
                        level[to[e]] = level[x] + 1
                        line.append(to[e])
            if level[sink] < 0:
                break
            arc, path, x = [0] * nodes, [], source
            while True:
                if x == sink:
                    push = min(room[e] for e in path)
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    path, x = [], source
                    continue
                while arc[x] < len(graph[x]):
                    e = graph[x][arc[x]]
                    if level[to[e]] == level[x] + 1 and free(x, e):
                        path.append(e)
                        x = to[e]
                        break
                    arc[x] += 1
                else:
                    if x == source:
                        break
                    x = to[path.pop() ^ 1]
                    arc[x] += 1


def flows(sizes: Mapping[str | None, int], capacities: Mapping[str, int]) -> tuple[dict[str | None, int], dict[str, int]]:
    """Bytes that leave each old shard and bytes that reach each new one, for the fewest moved bytes."""
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError(f"{sum(sizes.values())} bytes don't fit in {sum(capacities.values())}")
    old, new = sorted(sizes, key=lambda s: (s is None, s or "")), sorted(capacities)
    at_new = {s: 3 + len(old) + j for j, s in enumerate(new)}
    edges = []
    for i, s in enumerate(old):
        edges.append((0, 3 + i, sizes[s], 0))
        edges.append((3 + i, 1, sizes[s], 1))
        if s in at_new:
            edges.append((3 + i, at_new[s], sizes[s], 0))
    edges += [(1, at_new[s], capacities[s], 0) for s in new] + [(at_new[s], 2, capacities[s], 0) for s in new]
    flow = cheapest_flow(3 + len(old) + len(new), edges, 0, 2)
    out = {old[a - 3]: f for (a, b, _, _), f in zip(edges, flow) if b == 1}
    into = {new[b - 3 - len(old)]: f for (a, b, _, _), f in zip(edges, flow) if a == 1}
    return out, into


def transfers(blocks: Mapping[tuple[str | None, int], int], capacities: Mapping[str, int]) -> dict[tuple[str | None, int], str]:
    """The new shard of each block that moves. blocks: bytes by (old shard, block). Each block and each shard is looked at a constant number of times, but for sorting and a heap."""
    own: dict[str | None, list[tuple[int, int]]] = {}
    for (s, k), n in blocks.items():
        own.setdefault(s, []).append((n, k))
    sizes = {s: sum(n for n, _ in mine) for s, mine in own.items()}
    out, into = flows(sizes, capacities)
    chosen: list[tuple[int, str | None, int]] = []
    for s, mine in own.items():
        # A shard that isn't among the new ones gives up even its blocks of no bytes.
        if s not in capacities:
            chosen += [(n, s, k) for n, k in mine]
            continue
        need, keep = out[s], []
        for n, k in sorted(mine, key=lambda x: (-x[0], x[1])):
            if 0 < n <= need:
                chosen.append((n, s, k))
                need -= n
            else:
                keep.append((n, k))
        if need > 0:
            n, k = min((x for x in keep if x[0] >= need), key=lambda x: (x[0], x[1]))
            chosen.append((n, s, k))
    room = {s: c - sizes.get(s, 0) for s, c in capacities.items()}
    for n, s, _ in chosen:
        if s in room:
            room[s] += n
    # The flow's receivers come first, the one with the most room at the top; then all shards.
    heaps = [[(-room[s], s) for s in room if into.get(s)], [(-room[s], s) for s in room]]
    for h in heaps:
        heapq.heapify(h)
    moves: dict[tuple[str | None, int], str] = {}
    for n, s, k in sorted(chosen, key=lambda x: (-x[0], x[1] is None, x[1] or "", x[2])):
        for h in heaps:
            aside = []
            while h and (-h[0][0] != room[h[0][1]] or h[0][1] == s):
                r, t = heapq.heappop(h)
                if t == s:
                    aside.append((-room[t], t))
                else:
                    heapq.heappush(h, (-room[t], t))  # its room has changed in the other heap
            best = h[0][1] if h and room[h[0][1]] >= n else None
            if best is not None:
                room[best] -= n
                heapq.heapreplace(h, (-room[best], best))
            for x in aside:
                heapq.heappush(h, x)
            if best is not None:
                moves[s, k] = best
                break
        else:
            raise ValueError(f"no shard has room for a block of {n} bytes; use more blocks or more room")
    return moves


def block_of(doc_id: str, blocks: int) -> F.Column:
    return F.expr(f"pmod(cast(conv(substr(md5(coalesce(cast(cast({doc_id} as bigint) as string), text, '')), 1, 8), 16, 10) as bigint), {blocks})")


def default_capacities(blocks: Mapping[tuple[str | None, int], int], extra: int = EXTRA_SHARDS, slack: float = SLACK) -> dict[str, int]:
    """The old shards and extra new ones, of equal capacity: their share with slack and room for one more block, so that whole blocks always fit."""
    names = sorted({s for s, _ in blocks if s is not None}) + [f"new{k}" for k in range(extra)]
    return {s: math.ceil(sum(blocks.values()) * slack / len(names)) + max(blocks.values(), default=0) for s in names}


@owned
def resharded(docs: DataFrame, capacities: Mapping[str, int] | None = None, shard: str = "source", blocks: int = BLOCKS, name: str = "shard", plan_rows: int = PLAN_ROWS) -> DataFrame:
    """docs with a column that names the new shard, after its other columns."""
    spark = docs.sparkSession
    if name != shard:
        docs = docs.select(*(col(c) for c in docs.columns if c.lower() != name.lower()))
    old = col(shard).cast("string")
    sizes = cut(docs.groupBy(old.alias("s"), block_of("doc_id", blocks).alias("b")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")), "sizes")
    while blocks % 2 == 0 and sizes.count() > plan_rows:
        blocks //= 2
        sizes = cut(sizes.groupBy("s", (F.col("b") % blocks).alias("b")).agg(F.sum("n").alias("n")), "sizes")
    t = sizes.toArrow()  # at most plan_rows rows, or one a shard
    by_block = dict(zip(zip(t.column("s").to_pylist(), t.column("b").to_pylist()), t.column("n").to_pylist()))
    if capacities is None:
        capacities = default_capacities(by_block)
    ps, pb, pt = fresh(docs, "plan_shard", "plan_block", "plan_target")
    moves = [(s, b, t) for (s, b), t in transfers(by_block, capacities).items()] if by_block else []
    plan = spark.createDataFrame(moves, f"{ps} string, {pb} long, {pt} string")
    on = old.eqNullSafe(col(ps)) & (block_of("doc_id", blocks) == col(pb))
    kept = [col(c) for c in docs.columns if c != name]
    return docs.join(F.broadcast(plan) if len(moves) <= BROADCAST_ROWS else plan, on, "left").select(*kept, F.coalesce(col(pt), old).alias(name))


def rewrite(docs: DataFrame, path: str, shard: str = "source", name: str = "shard") -> DataFrame:
    """Write what has to be written of resharded docs under path, by shard: moved documents, and the rest of the shards they left. Gives the documents that were left as they are."""
    moved = ~col(name).eqNullSafe(col(shard))
    (d,) = fresh(docs, "donor")
    donors = cut(docs.where(moved).select(col(shard).alias(d)).distinct(), "donors")  # a row a shard
    if donors.count() <= BROADCAST_ROWS:
        donors = F.broadcast(donors)  # else all documents of a hot shard would meet in one task
    touched = docs.join(donors, col(shard).eqNullSafe(col(d)), "left_semi")
    written(touched.hint("rebalance", name), path, by=name)
    return docs.join(donors, col(shard).eqNullSafe(col(d)), "left_anti")


@owned
def op10_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = resharded(table(spark, sf_dir, "documents"))
    path = scratch(spark, "shards")
    left = rewrite(docs, path)
    new = spark.read.schema(docs.schema).parquet(path)
    one = lambda d, again: d.select("doc_id", F.col("source").alias("old_shard"), "shard", F.lit(again).alias("rewritten"))
    return one(left, False).union(one(new, True))


QUERIES = {"op10_reshard": op10_reshard}
SQL: dict[str, str] = {}
