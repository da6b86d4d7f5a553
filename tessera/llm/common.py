"""What the corpus operators share: the shared folder, cut lineage, and vectorised tokenising.

Tokens are maximal runs of bytes that are neither white space nor punctuation
(ASCII, and U+2000-206F, U+3000-303F, U+00A0), of the lower-cased UTF-8 text;
each is represented by a 64-bit hash. Scripts that part no words with blanks
(Han, kana, Thai) give a token a character. All of it is numpy over whole Arrow
buffers, so the cost is a few nanoseconds a byte and no Python object is made
per token.

Tables that an operator writes on its way lie in the shared folder. Those that
its result doesn't read are dropped when the operator returns (see owned), the
others when the session's file system is closed.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES = 1 << 18
ARROW_ROWS = 1000  # that go to Python at a time
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TABLES: list[str] = []  # paths that were handed out and not dropped


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where that is unset and the master is local (a test), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, dropped with its owner or at the session's end."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    _TABLES.append(path)
    return path


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as __) for the time of a block."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, path: str, **how: str) -> None:
    """Write df as Parquet; its shuffle files go when that is done."""
    spark = df.sparkSession
    with settings(spark, **{_CLEANUP.replace(".", "__"): "true"}, spark__sql__execution__arrow__maxRecordsPerBatch=str(ARROW_ROWS)):
        w = df.write
        if "by" in how:
            w = w.partitionBy(how["by"])
        w.parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and survives the loss of executors."""
    at = scratch(df.sparkSession, name)
    written(df, at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_table(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)
    if path in _TABLES:
        _TABLES.remove(path)


def roots(df: DataFrame) -> set[str]:
    """Last parts of the paths of all file tables that df reads."""
    out, leaves = set(), df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            continue
        relation = leaf.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation":
            paths = relation.location().rootPaths()
            out |= {paths.apply(k).getName() for k in range(paths.size())}
    return out


def settle(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Drop the tables handed out since there were mark of them, but for those that the frames read."""
    needed = set().union(*map(roots, keep)) if keep else set()
    for path in _TABLES[mark:]:
        if path.rsplit("/", 1)[-1] not in needed:
            drop_table(spark, path)


def owned(f: Callable) -> Callable:
    """An operator whose tables go when it returns, but for those that its result (a frame, or several) reads."""

    @functools.wraps(f)
    def call(*args, **kwargs):
        mark = len(_TABLES)
        out = f(*args, **kwargs)
        frames = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
        if len(_TABLES) > mark:
            settle(frames[0].sparkSession, mark, *frames)
        return out

    return call


def col(name: str) -> Column:
    """A column by its exact name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place on a fresh array."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def mix_in(h: np.ndarray, spare: np.ndarray) -> None:
    """mix() over h itself, with an array of the same size to work in."""
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0)):
        np.right_shift(h, U64(by), out=spare)
        np.bitwise_xor(h, spare, out=h)
        if times:
            np.multiply(h, U64(times), out=h)


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def separators(punctuation: bool) -> np.ndarray:
    t = np.zeros(256, bool)
    t[:33] = True
    t[127] = True
    if punctuation:
        for c in range(33, 127):
            t[c] = not chr(c).isalnum()
    return t


SPACES, WORD_BREAKS = separators(False), separators(True)


def wide(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where characters begin that make a token each, or (blank) part tokens; their bytes; and which of them are blank."""
    at = np.flatnonzero((buf >= 0xE0) | (buf == 0xC2))
    if not len(at):
        return at, at, np.zeros(0, bool)
    lead = buf[at].astype(np.int64)
    size = np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2))
    byte = lambda k: np.where(k < size, buf[np.minimum(at + k, len(buf) - 1)].astype(np.int64) & 63, 0)
    code = np.where(size == 2, (lead & 31) << 6 | byte(1), np.where(size == 3, (lead & 15) << 12 | byte(1) << 6 | byte(2), (lead & 7) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)))
    within = lambda a, b: (code >= a) & (code <= b)
    blank = (code == 0xA0) | within(0x2000, 0x206F) | within(0x3000, 0x303F)
    alone = within(0x0E00, 0x0E7F) | within(0x3040, 0x30FF) | within(0x3400, 0x9FFF) | within(0xF900, 0xFAFF) | within(0x20000, 0x3FFFF)
    some = blank | alone
    return at[some], size[some], blank[some]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


class Tokens:
    """h: 64-bit hash of each token; off: where each text's tokens begin, with the end; start, end: byte range in buf."""

    __slots__ = ("h", "off", "start", "end", "buf", "text_off")

    def __init__(self, texts: pa.Array, lower: bool = True, breaks: np.ndarray = WORD_BREAKS):
        if lower:
            texts = pc.utf8_lower(texts.cast(pa.large_string()))
        buf, toff = text_buffer(texts)
        n = len(buf)
        word = ~breaks[buf]
        first, size, blank = wide(buf)
        for k in range(4):
            at = first[blank & (size > k)] + k
            word[at] = False
        first, size = first[~blank], size[~blank]
        edges = np.r_[toff[:-1], first, first + size]  # a text, and a character of such a script, begins and ends a token
        prev = np.empty(n, bool)
        if n:
            prev[0] = False
            prev[1:] = word[:-1]
            prev[edges[edges < n]] = False
        start = np.flatnonzero(word & ~prev)
        nxt = np.empty(n, bool)
        if n:
            nxt[-1] = False
            nxt[:-1] = word[1:]
            ends = np.r_[toff[1:], first, first + size]
            nxt[ends[(ends > 0)] - 1] = False
        end = np.flatnonzero(word & ~nxt) + 1
        p, inv = powers(n + 1)
        total = np.zeros(n + 1, U64)
        if n:
            np.cumsum((buf.astype(U64) + U64(1)) * p[:n], out=total[1:])
        self.h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(U64))
        self.off = np.searchsorted(start, toff).astype(np.int64)
        self.start, self.end, self.buf, self.text_off = start, end, buf, toff


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches between rows to about limit bytes of text; a longer text makes a slice of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield b.slice(at, to - at)
            at = to
    give_back()


def per_token(off: np.ndarray) -> np.ndarray:
    """The text's number for each token."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def window_hash(h: np.ndarray, offsets: tuple[int, ...], seed: int = 0) -> np.ndarray:
    """For each position p with p + offsets[-1] inside the array: a hash of the tokens at p + o, o in offsets."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, mix_int(seed + 1), U64)
    for i, o in enumerate(offsets):
        out += h[o : o + n] * U64(mix_int(1000 * seed + i + 7) | 1)
    return mix(out)


def column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


#: Ids that are sent to the tasks at most; a hashed one takes about 30 bytes.
BROADCAST_ROWS = 6_000_000


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the doc_ids of ids (one column); rows with a null doc_id stay. Up to BROADCAST_ROWS ids are sent to the tasks, more are shuffled."""
    (name,) = fresh(docs, "__gone")
    gone = cut(ids.toDF(name).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, col("doc_id").cast("long") == col(name), "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_ids are among ids (one column), which are sent or shuffled as in drop_ids."""
    (name,) = fresh(docs, "__held")
    held = cut(ids.toDF(name).distinct(), "held")
    return docs.join(F.broadcast(held) if held.count() <= BROADCAST_ROWS else held, col("doc_id").cast("long") == col(name), "left_semi")
