"""Shared pieces: written tables, joins that bear hot keys, components, text hashing.

Executor functions and what is broadcast for them (``sent``) are pickled by value, so executors need no copy of this package.
"""

from __future__ import annotations

import ctypes
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tessera

cloudpickle.register_pickle_by_value(tessera)

MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def sent(spark: SparkSession, thing: Any) -> Callable[[], Any]:
    """A broadcast of bytes that hold the thing with its classes; the function gives it back on an executor."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(data.value)


def trim() -> None:
    """Gives free memory of this process back."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives back free memory at its end: workers live on, and what they hold adds up."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return one


def sampled(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The rows of about n of the table's distinct keys (all, if fewer), those with the smallest hashes: a count of the keys gives the bound, so
    no task and no driver sorts more. The same rows each time."""
    total = df.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    share = min(1.0, n / max(1, total))
    return df if share >= 0.95 else df.where(F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << 40)) < int(share * (1 << 40)))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, right: DataFrame, keys: list[str], count: str, spread: Column, hot: int = 256) -> DataFrame:
    """Left join with a table of one row per key, when a key may hold a third of ``left``.

    ``right[count]`` says how many left rows each key has. Keys with more than 1/``hot`` of them (so fewer than ``hot``
    keys, whatever the input's size) are broadcast; their left rows are spread by ``spread`` for the other join.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    limit = max(2000, total // hot)
    vals = [c for c in right.columns if c not in keys and c != count]
    named = lambda tag: [*[F.col(k).alias(f"{tag}{k}") for k in keys], *[F.col(c).alias(f"{tag}{c}") for c in vals]]
    big = right.where(F.col(count) > limit).select(*named("b__"), F.lit(True).alias("hot__"))
    small = right.where(F.col(count) <= limit).select(*named("s__"), F.hash(*keys).cast("long").alias("g__"), F.lit(False).alias("f__"))
    x = left.join(F.broadcast(big), [F.col(k) == F.col(f"b__{k}") for k in keys], "left").withColumn("hot__", F.coalesce("hot__", F.lit(False)))
    x = x.withColumn("h__", F.when(F.col("hot__"), F.xxhash64(spread)).otherwise(F.hash(*keys).cast("long")))
    on = [F.col("h__") == F.col("g__"), F.col("hot__") == F.col("f__"), *[F.col(k) == F.col(f"s__{k}") for k in keys]]
    y = x.join(small, on, "left")
    return y.select(*[F.col(c) for c in left.columns], *[F.coalesce(f"b__{c}", f"s__{c}").alias(c) for c in vals])


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars: each node once, with the least node that it reaches here."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(p, p)
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = [x for x in list(up) if top(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): a row (id, comp) for each linked id, comp the least id reached.

    Each partition first shrinks its links to stars. Then, until no link is left: each node takes its least neighbour as
    parent, parents are followed to the roots by pointer doubling, and links are drawn between roots. All tables stay
    distributed; only counts reach the driver. Null ids and self links are dropped.
    """
    cur = written(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(_local_forest, "a long, b long").distinct(), "links")
    labels = None
    while cur.limit(1).count():
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        par = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p")), "parents")
        while True:
            r = par.select(F.col("id").alias("p"), F.col("p").alias("q"))
            nxt = written(par.join(r, "p").select("id", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "parents")
            par = nxt.select("id", "p")
            if not nxt.where("moved").limit(1).count():
                break
        pa_, pb = par.select(F.col("id").alias("a"), F.col("p").alias("x")), par.select(F.col("id").alias("b"), F.col("p").alias("y"))
        cur = written(cur.join(pa_, "a").join(pb, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
        if labels is None:
            labels = par.select("id", F.col("p").alias("comp"))
        else:
            step = par.select(F.col("id").alias("comp"), "p")
            labels = written(labels.join(step, "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")), "labels")
    if labels is None:
        return links.sparkSession.createDataFrame([], "id long, comp long")
    return labels


# --- words of whole batches, with numpy ---------------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, one after another, and each text's start (n + 1 offsets). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


BLOCK = 1 << 18


def _blocks(raw: np.ndarray, off: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of about BLOCK bytes that end where a text or (by ``ends``, a table of bytes) a word or line ends, with the
    texts' edges in them: byte arrays of eight bytes each stay small however long a text is."""
    lo, n = 0, len(raw)
    while lo < n:
        at = min(n, lo + BLOCK)
        hi = int(off[np.searchsorted(off, at)])
        while at < hi:
            stop = np.flatnonzero(ends[raw[at : min(at + 4096, hi)]])
            if len(stop):
                hi = at + int(stop[0])
            at += 4096
        yield lo, hi, off[np.searchsorted(off, lo) : np.searchsorted(off, hi, side="right")] - lo
        lo = hi


def words_of(raw: np.ndarray, off: np.ndarray, lines: bool = False) -> tuple[np.ndarray, ...]:
    """Words ([^ \\t-\\r]+, A-Z as a-z) of all texts: 64-bit hash, text's index, start and end byte; with ``lines`` a line's index too."""
    parts, base = [], 0
    for lo, hi, edges in _blocks(raw, off, SPACE):
        h, start, end, brk, base = _words(raw[lo:hi], edges, base if lines else None)
        parts.append((h, start + lo, end + lo, brk))
    z = np.zeros(0, np.int64)
    h, start, end, brk = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (z.astype(np.uint64), z, z, z)
    doc = np.searchsorted(off, start, side="right") - 1
    return (h, doc, start, end, brk) if lines else (h, doc, start, end)


def _words(raw: np.ndarray, edges: np.ndarray, base: int | None) -> tuple:
    """A block's words: hash, start, end, line (counted from ``base``), and the count of lines up to the block's end."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    solid = ~SPACE[raw]
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    start = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    size = end - start
    if not len(start):
        h = np.zeros(0, np.uint64)
    else:
        at = np.flatnonzero(solid)
        first = np.zeros(len(start), np.int64)
        np.cumsum(size[:-1], out=first[1:])
        place = np.arange(len(at)) - np.repeat(first, size)
        h = np.add.reduceat(BYTE[raw[at]] * powers(int(size.max()))[place], first)
        h = mix(h ^ size.astype(np.uint64))
    if base is None:
        return h, start, end, start, None
    brk = np.cumsum((raw == 10) | edge[:-1])
    return h, start, end, brk[start] + base, base + int(brk[-1])


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of a text column with about ``most`` bytes each, so that working memory is bounded by one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    off = bytes_of(texts)[1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, len(texts))
        i = min(j, len(texts))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def small_batches(spark: SparkSession, rows: int = 2000, most: int = 4 << 20) -> None:
    """Arrow batches of texts small enough for a Python worker's memory: so many rows, and no more once they hold ``most``
    bytes. A session's setting that holds for plans run later too; it bears on memory, never on results."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
