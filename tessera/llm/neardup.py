"""Embedding near-dedup: sorted projection passes.

In each pass a vector's key is 62 sign bits of random projections, one after another, and rows are range-sorted by it:
vectors at a small angle share a long prefix of bits in some pass. Each is held against its next ``window`` neighbours with
the exact cosine; pairs that reach the threshold are united within the task, so a task sends a star of its groups however
many pairs it has seen, and passes are united as components.

A window is bounded, and where many vectors share a rough direction their leading bits agree and windows miss links. So the
passes are followed by an exact one (``missing_links``): every stripe of vectors against every other, in compact blocks of
which those whose centre and radius can't reach the threshold are skipped, for links between what the passes left apart.
Links are then counted exactly, by blocks of a component against blocks of the same component, whose sizes are bounded and
which spread over the cluster. So recall is 1; the cost is that of all pairs that bounds can't exclude, which on vectors
without structure is nearly all. ``recall_of`` measures recall against brute force.

Defined results: null, zero, empty and non-finite vectors have no links and are their own component; vectors of different
lengths never link; rows with the same id and vector count once for links and come back as often as they came; null ids
link with nothing, have a null component and are kept; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, small_batches, written
from tessera.llm.vectors import matrix, usable

BITS = 62


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (least index) of each of n items: labels fall to the least over the pairs until none moves."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        new = lab[lab]
        while not np.array_equal(new, lab):
            lab, new = new, new[new]
        if np.array_equal(lab[a], lab[b]):
            break
    return lab


def candidate_links(vecs: DataFrame, threshold: float, passes: int, window: int, seed: int = 11) -> DataFrame:
    """Links (a, b) that unite what the passes found; every link is a chain of verified pairs."""
    spark = vecs.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        place = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            sizes = np.array([len(x) // 8 for x in b.column(1).to_pylist()])
            for d in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == d))
                if d not in planes:
                    planes[d] = np.random.default_rng(seed).standard_normal((d, passes * BITS))
                m = _unit(matrix(part.column(1), d))
                bits = (m @ planes[d] > 0).reshape(len(m), passes, BITS)
                key = (bits * place).sum(axis=2)
                for p in range(passes):
                    yield pa.record_batch([pa.array(np.full(len(m), p, np.int32)), pa.array(np.full(len(m), d, np.int32)), pa.array(key[:, p]), part.column(0), pa.array([x.tobytes() for x in m.astype("<f4")], pa.binary())], names=["pass", "dim", "key", "id", "v"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = vecs.mapInArrow(keys, "pass int, dim int, key long, id long, v binary").repartitionByRange(n, "pass", "dim", "key", "id").sortWithinPartitions("pass", "dim", "key", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None
        for b in batches:
            b = pa.Table.from_batches([tail, b]).combine_chunks().to_batches()[0] if tail is not None and tail.num_rows and b.num_rows else b
            if not b.num_rows:
                continue
            tail = b.slice(max(0, b.num_rows - window))
            run = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            ids = b.column(3).to_numpy()
            for r in np.unique(run):
                at = np.flatnonzero(run == r)
                m = np.frombuffer(b"".join(b.column(4).take(pa.array(at)).to_pylist()), "<f4").reshape(len(at), -1)
                pairs = []
                for o in range(1, min(window, len(at) - 1) + 1):
                    # single precision is only a sieve; what lies near the threshold is looked at exactly below
                    hit = np.flatnonzero(np.einsum("ij,ij->i", m[:-o], m[o:]) >= threshold - 1e-5)
                    pairs.append((hit, hit + o))
                i, j = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
                own = ids[at]
                # stars are drawn over sure pairs only; unsure ones go on as they are, to be verified
                sure = np.einsum("ij,ij->i", m[i], m[j]) >= threshold + 1e-5
                lab = _union(len(at), i[sure], j[sure])
                k = np.flatnonzero(lab != np.arange(len(at)))
                yield pa.record_batch([pa.array(np.minimum(own[k], own[lab[k]])), pa.array(np.maximum(own[k], own[lab[k]])), pa.array(np.ones(len(k), bool))], names=["a", "b", "sure"])
                u, w = i[~sure], j[~sure]
                yield pa.record_batch([pa.array(np.minimum(own[u], own[w])), pa.array(np.maximum(own[u], own[w])), pa.array(np.zeros(len(u), bool))], names=["a", "b", "sure"])

    return written(dealt.mapInArrow(compare, "a long, b long, sure boolean").where("a <> b").distinct(), "found")


def cosines(pairs: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision reaches the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = (_unit(np.frombuffer(v, "<f8")[None, :])[0] for v in (x, y))
                keep.append(len(x) == len(y) and float((x * y).sum()) >= threshold)
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = pairs.select("a", "b").join(vecs.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(vecs.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
    return x.select("a", "b", "x", "y").mapInArrow(test, "a long, b long").distinct()


def compact_blocks(m: np.ndarray, size: int = 512) -> list[np.ndarray]:
    """Row indexes in blocks of at most ``size``: halved along the direction of most spread until they fit."""
    todo, out = [np.arange(len(m))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        x = m[at] - m[at].mean(axis=0)
        v = x[np.argmax(np.einsum("ij,ij->i", x, x))]
        for _ in range(3):
            v = v @ x.T @ x
            v = v / (np.sqrt((v * v).sum()) or 1.0)
        order = np.argsort(x @ v, kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def missing_links(vecs: DataFrame, comp: DataFrame, threshold: float, stripe: int = 1 << 20) -> DataFrame:
    """Links (a, b) of component ids that complete the components exactly: stripes of at most about ``stripe`` numbers, dealt
    by hash and so of even size, each against each; a pair of stripes sends a star of the components it unites."""
    spark = vecs.sparkSession
    total = vecs.agg(F.sum(F.octet_length("v"))).first()[0] or 0
    # so many that there is a pair for each core at least
    k = max(int(np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism))), -(-total // (8 * stripe)))
    one = vecs.join(comp, "id", "left").select("id", "v", F.coalesce("comp", "id").alias("comp"), F.pmod(F.xxhash64("id", "v"), F.lit(k)).cast("int").alias("mine"))
    cells = F.expr(f"transform(sequence(0, {k - 1}), o -> struct(least(o, mine) as i, greatest(o, mine) as j))")
    dealt = one.select("id", "v", "comp", "mine", F.explode(cells).alias("c")).select("c.i", "c.j", "mine", "id", "comp", "v")

    def scan(rows: pa.Table) -> pa.Table:
        i, mine, ids, vs = rows["i"][0].as_py(), rows["mine"].to_numpy(), rows["id"].to_numpy(), rows["v"].to_pylist()
        inner = i == rows["j"][0].as_py()
        names, lab = np.unique(rows["comp"].to_numpy(), return_inverse=True)
        top = np.arange(len(names))
        size = np.array([len(v) for v in vs])
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            m = _unit(np.frombuffer(b"".join(vs[t] for t in at), "<f8").reshape(len(at), -1))
            f, own, g = m.astype(np.float32), ids[at], lab[at]
            # a bound on what single precision may be off by in a sum of products of unit vectors
            off = max(1e-5, f.shape[1] * 1.2e-7)
            a = np.arange(len(at)) if inner else np.flatnonzero(mine[at] == i)
            b = a if inner else np.flatnonzero(mine[at] != i)
            if not len(a) or not len(b):
                continue
            left, right = ([x[p] for p in compact_blocks(f[x])] for x in (a, b))
            centres = np.stack([f[q].mean(axis=0) for q in right])
            radii = np.array([np.sqrt(((f[q] - c) ** 2).sum(axis=1).max()) for q, c in zip(right, centres, strict=True)])
            for s, p in enumerate(left):
                reach = f[p] @ centres.T + radii >= threshold - 2 * off
                for t in range(s if inner else 0, len(right)):
                    if not reach[:, t].any():
                        continue
                    x, y = p[reach[:, t]], right[t]
                    u, w = np.divmod(np.flatnonzero(f[x] @ f[y].T >= threshold - off), len(y))
                    u, w = x[u], y[w]
                    apart = (top[g[u]] != top[g[w]]) & (own[u] != own[w])
                    u, w = u[apart], w[apart]
                    near = np.concatenate([(m[u[o : o + 4096]] * m[w[o : o + 4096]]).sum(axis=1) >= threshold for o in range(0, len(u), 4096)] or [np.zeros(0, bool)])
                    if near.any():
                        q = _union(len(names), np.concatenate([top[g[u[near]]], top]), np.concatenate([top[g[w[near]]], np.arange(len(names))]))
                        top = q[top]
        out = np.flatnonzero(top != np.arange(len(names)))
        return pa.table({"a": pa.array(names[top[out]]), "b": pa.array(names[out])})

    return dealt.groupBy("i", "j").applyInArrow(scan, "a long, b long")


def link_counts(vecs: DataFrame, comp: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(id, n): for each linked vector its links within its component, exactly, block by block."""
    spark = vecs.sparkSession
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    one = comp.join(sizes, "comp").withColumn("nb", F.ceil(F.col("size") / block).cast("int"))
    one = one.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    # cells (i, j) with i <= j: a vector of block m goes to (i, m) for i <= m and to (m, j) for j > m
    cells = F.expr("transform(sequence(0, nb - 1), o -> struct(least(o, mine) as i, greatest(o, mine) as j))")
    dealt = one.select("comp", "id", "mine", F.explode(cells).alias("c")).join(vecs, "id")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = dealt.select("comp", "c.i", "c.j", "mine", "id", "v").repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell(rows: pa.Table) -> pa.RecordBatch:
            i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
            mine, ids, vs = rows["mine"].to_numpy(), rows["id"].to_numpy(), rows["v"].to_pylist()
            size = np.array([len(v) for v in vs])
            got = np.zeros(len(ids), np.int64)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                m = _unit(np.frombuffer(b"".join(vs[k] for k in at), "<f8").reshape(len(at), -1))
                a, b = (np.arange(len(at)),) * 2 if i == j else (np.flatnonzero(mine[at] == i), np.flatnonzero(mine[at] == j))
                for lo in range(0, len(a), 512):
                    rows_ = a[lo : lo + 512]
                    s = m[rows_] @ m[b].T
                    near = s >= threshold
                    for x, y in np.argwhere(np.abs(s - threshold) < 1e-12):  # a product of matrices may round otherwise
                        near[x, y] = (m[rows_[x]] * m[b[y]]).sum() >= threshold
                    near &= ids[at[rows_]][:, None] != ids[at[b]][None, :]
                    got[at[rows_]] += near.sum(axis=1)
                    if i != j:
                        got[at[b]] += near.sum(axis=0)
            return pa.record_batch([pa.array(ids), pa.array(got)], names=["id", "n"])

        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            key = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                if hi == lo:
                    continue
                if last is not None and tuple(key[lo]) != last:
                    yield cell(pa.Table.from_batches(held))
                    held = []
                last = tuple(key[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield cell(pa.Table.from_batches(held))

    return dealt.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(emb: DataFrame, threshold: float = 0.95, passes: int = 14, window: int = 32, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept)."""
    small_batches(emb.sparkSession, 5000)
    vecs = written(usable(emb, id_col, col).where("id is not null").dropDuplicates(["id", "v"]), "vectors")
    found = candidate_links(vecs, threshold, passes, window)
    links = found.where("sure").select("a", "b")
    unsure = found.where("not sure")
    if unsure.limit(1).count():
        links = links.union(cosines(unsure, vecs, threshold))
    comp = written(components(links), "components")
    more = written(missing_links(vecs, comp, threshold), "missing")
    if more.limit(1).count():
        comp = written(components(comp.select(F.col("comp").alias("a"), F.col("id").alias("b")).union(more)), "components")
    n = link_counts(vecs.join(comp.select("id"), "id", "left_semi"), comp, threshold)
    out = emb.select(F.col(id_col).cast("long").alias("vec_id")).join(comp.join(n, "id", "left").select(F.col("id").alias("vec_id"), "comp", "n"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"), F.coalesce(F.coalesce("comp", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def recall_of(found: DataFrame, emb: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", col: str = "embedding") -> float:
    """Share of all true links that the result counts; brute force, so for small tables."""
    rows = usable(emb, id_col, col).toPandas()
    m = _unit(np.stack([np.frombuffer(v, "<f8") for v in rows["v"]]))
    true = int((m @ m.T >= threshold).sum()) - len(m)
    return (found.agg(F.sum("n_links")).first()[0] or 0) / true if true else 1.0
