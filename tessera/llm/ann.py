"""Approximate nearest neighbours by inner product: shifted space-filling curves.

Vectors are projected to a few dimensions, once per curve with other directions and another shift, and every row gets its
place on a Hilbert curve. Rows are range-partitioned by (curve, place) and sorted; a query's candidates are its neighbours
within a key window on each curve; windows merge and the original vectors rerank them.

Where data have no structure that a few dimensions show (random directions in 64 dimensions), windows alone can't reach a
recall of 0.9 short of holding most rows. So a window's yield is used as a bound: the k-th best score that the merged windows
gave each query. Then each stripe of queries passes over each stripe of rows in blocks along the curve, a block whose
centre and radius can't reach the bound of any query of the stripe is skipped, and a stripe sends at most k rows a query,
none under its bound. That stage is exact, so recall is 1; its cost is queries x rows that can't be excluded.

Only the projection's scale is fitted, on a sample of at most ``sample`` rows; every row is indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts take no part, nor do null ids; vectors
of different lengths are never neighbours; equal scores: smaller id first; repeated rows count once, and an id that comes
with several vectors counts with the best of them (as a query: each of its vectors asks); other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, written
from tessera.llm.vectors import matrix, usable

DIMS, ORDER = 6, 10


def hilbert(x: np.ndarray, order: int) -> np.ndarray:
    """Place on a Hilbert curve of points with coordinates in [0, 2**order): axes are untangled bit by bit from the
    highest, each level by exchanges and inversions of the lower bits, and the bits interleaved as a Gray code."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (order - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (order - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(order - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


class Curves:
    """The projections, shifts and scales of some curves, for vectors of one length."""

    def __init__(self, dim: int, curves: int, spread: float, seed: int = 5):
        rng = np.random.default_rng(seed + dim)
        self.p = rng.standard_normal((curves, dim, DIMS))
        self.shift = rng.random((curves, DIMS))
        self.spread = spread or 1.0

    def places(self, m: np.ndarray) -> np.ndarray:
        cells = (1 << ORDER) - 1
        out = []
        for p, s in zip(self.p, self.shift, strict=True):
            y = m @ p / (6 * self.spread) + 0.25 + s / 2
            out.append(hilbert(np.clip(y * cells, 0, cells), ORDER))
        return np.stack(out, axis=1)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=-1)


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best, ties to smaller ids."""
    if len(score) > 4 * k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def search(emb: DataFrame, is_query: Column, k: int = 20, curves: int = 4, window: int = 64, sample: int = 10_000, stripe: int = 4096, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest among all rows but itself, nearest first. ``is_query`` is a
    condition on a column ``id``."""
    spark = emb.sparkSession
    small_batches(spark, 5000)
    vecs = written(usable(emb, id_col, col).where("id is not null").dropDuplicates(["id", "v"]).withColumn("q", is_query), "vectors")
    rows = vecs.select("v").limit(sample).toArrow().column(0).to_pylist()
    spreads: dict[int, float] = {}
    for d in {len(v) // 8 for v in rows}:
        m = np.stack([np.frombuffer(v, "<f8") for v in rows if len(v) == 8 * d])
        spreads[d] = float(np.sqrt((m * m).sum(axis=1).mean()))
    total, asked = vecs.agg(F.count(F.lit(1)), F.count_if("q")).first()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) // 8 for x in b.column(1).to_pylist()])
            for d in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == d))
                at = Curves(d, curves, spreads.get(d, 1.0)).places(matrix(part.column(1), d))
                for c in range(curves):
                    yield pa.record_batch([pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), c, np.int32)), pa.array(at[:, c]), *part.columns], names=["dim", "curve", "place", "id", "v", "q"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = vecs.mapInArrow(place, "dim int, curve int, place long, id long, v binary, q boolean")
    dealt = placed.repartitionByRange(n, "dim", "curve", "place", "id").sortWithinPartitions("dim", "curve", "place", "id")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None
        for b in batches:
            # a batch overlaps the one before by a window on either side; queries seen twice merge later
            b = pa.Table.from_batches([tail, b]).combine_chunks().to_batches()[0] if tail is not None and b.num_rows else b
            if not b.num_rows:
                continue
            tail = b.slice(max(0, b.num_rows - 2 * window))
            run = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            for r in np.unique(run):
                at = np.flatnonzero(run == r)
                ids, isq = b.column(3).to_numpy()[at], b.column(5).to_numpy(zero_copy_only=False)[at]
                m = matrix(b.column(4).take(pa.array(at)), int(r >> 32))
                qs, vs, ss = [], [], []
                for i in np.flatnonzero(isq):
                    lo, hi = max(0, i - window), i + window + 1
                    s, own = _dot(m[lo:hi], m[i]), ids[lo:hi]
                    ok = np.flatnonzero(own != ids[i])
                    best = ok[_top(s[ok], own[ok], k)]
                    qs.append(np.full(len(best), ids[i]))
                    vs.append(own[best])
                    ss.append(s[best])
                if qs:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in (qs, vs, ss)], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = written(dealt.mapInArrow(windows, "query_id long, vec_id long, score double").distinct(), "windows")
    bound = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))

    # stripes: queries by hash, rows by place on the first curve, so that a stripe's blocks are compact
    q_parts = max(1, -(-asked // stripe))
    r_parts = max(spark.sparkContext.defaultParallelism, -(-total // (8 * stripe)))
    left = vecs.where("q").join(bound, "id", "left").select(F.pmod(F.xxhash64("id"), F.lit(q_parts)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(r_parts - 1))).alias("j"), F.lit(None).cast("long").alias("place"), "id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    first = placed.where("curve = 0")
    cuts = np.array(first.approxQuantile("place", [x / r_parts for x in range(1, r_parts)], 0.1 / r_parts) if r_parts > 1 and total else [])

    @F.arrow_udf("int")
    def stripe_of(places: pa.Array, spread: pa.Array) -> pa.Array:
        """A place's stripe; a place that makes up several cuts holds the rows of several stripes, which are dealt by id."""
        x = places.to_numpy()
        lo, hi = np.searchsorted(cuts, x, "left"), np.searchsorted(cuts, x, "right")
        return pa.array((lo + spread.to_numpy() % (hi - lo + 1)).astype(np.int32))

    j = stripe_of("place", F.pmod(F.xxhash64("id"), F.lit(1 << 31))) if len(cuts) else F.lit(0)
    right = first.withColumn("j", j).select(F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("i"), "j", "place", "id", "v", F.lit(None).cast("double").alias("bound"))

    def scan(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], []]
        qv, rv = queries["v"].to_pylist(), rows["v"].to_pylist()
        ql, rl = np.array([len(v) for v in qv], np.int64), np.array([len(v) for v in rv], np.int64)
        qi, qb, ri, rp = queries["id"].to_numpy(), queries["bound"].to_numpy(), rows["id"].to_numpy(), rows["place"].to_numpy()
        for size in np.intersect1d(ql, rl):
            a = np.flatnonzero(ql == size)
            b = np.flatnonzero(rl == size)
            b = b[np.argsort(rp[b], kind="stable")]
            x = np.frombuffer(b"".join(qv[t] for t in a), "<f8").reshape(len(a), -1)
            y = np.frombuffer(b"".join(rv[t] for t in b), "<f8").reshape(len(b), -1)
            norm, bound = np.sqrt(_dot(x, x)), qb[a].copy()
            held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in a]
            for lo in range(0, len(b), 1024):
                block, own = y[lo : lo + 1024], ri[b[lo : lo + 1024]]
                centre = block.mean(axis=0)
                radius = np.sqrt(_dot(block - centre, block - centre).max())
                live = np.flatnonzero(x @ centre + norm * radius >= bound - 1e-9)
                for c in range(0, len(live), 512):
                    some = live[c : c + 512]
                    s = x[some] @ block.T
                    near_ = s >= bound[some][:, None] - 1e-9
                    near_ &= own[None, :] != qi[a[some]][:, None]
                    for t in np.flatnonzero(near_.any(axis=1)):
                        hit = np.flatnonzero(near_[t])
                        held[some[t]].append((_dot(block[hit], x[some[t]]), own[hit]))
                        if sum(len(h[0]) for h in held[some[t]]) > 4 * k:
                            sc, iv = (np.concatenate(z) for z in zip(*held[some[t]], strict=True))
                            best = _top(sc, iv, k)
                            held[some[t]] = [(sc[best], iv[best])]
                            bound[some[t]] = max(bound[some[t]], sc[best[-1]])
            for t, h in enumerate(held):
                if h:
                    sc, iv = (np.concatenate(z) for z in zip(*h, strict=True))
                    best = _top(sc, iv, k)
                    for o, v in zip(out, (np.full(len(best), qi[a[t]]), iv[best], sc[best]), strict=True):
                        o.append(v)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({c: pa.array(np.concatenate(o) if o else np.zeros(0, t)) for c, o, t in zip(("query_id", "vec_id", "score"), out, kinds, strict=True)})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(scan, "query_id long, vec_id long, score double")
    merged = found.union(near).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
