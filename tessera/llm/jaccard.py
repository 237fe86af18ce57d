"""N-gram Jaccard join: grouped prefix join of shingle sets.

Two documents link when their sets' Jaccard similarity reaches num/den. With sets in one common order, rarest shingle
first, linked sets share one of their first n - ceil(n*num/den) + 1 shingles (the prefix) and their sizes differ little.

1. Counts: a fixed number of counters over all shingles of all documents; a shingle's rank is its counter, then its hash.
   Any order gives the same links; counters only keep frequent passages out of prefixes.
2. Classes: documents with the same set. Groups: classes with the same prefix and size, one posting list for all of them.
3. Group pairs that share a prefix shingle and have fitting sizes. First each group is only held against the least group
   of the shingle and size range, and each member against its group's least: a row for each, however large the group.
   Members that are linked by then need no further test. Then what still lies in different components is paired in full.
   A pair counts at a shingle that can be the first it shares: the rest of both sets must hold all that it needs.
4. Pairs whose prefixes don't agree enough go; the rest is verified on whole sets, computed again for the documents concerned (a fixed-size filter of their ids goes to the
   scan; an exact join follows). Links make components.

No cap anywhere: counters, filter and first round only save work. Sets hold 64-bit hashes of shingles of 64-bit hashes of
words; a wrong link needs a collision among about two documents' shingles. A class goes by its least id and a hash of its
set, so an id that comes with several texts has them all compared.

Hot keys: a shingle's postings are counted before they are joined, and joined by ``attach``; what is paired in full is dealt to
blocks of at most BLOCK rows a side under each shingle or group, so a pair of blocks is one task's work at most; joins by
class are skew joins, which Spark splits.

Defined results: null, empty or blank text: no shingles, no links, its own component; fewer words than the shingle: the
whole sequence is the one shingle; repeated rows give repeated rows; rows with one id and different texts are one document
that has the links of all of them; null ids link with nothing and keep a row with a null component; other columns are not
carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import attach, bytes_of, components, lean, mix, signed, slices, small_batches, words_of, written

COUNTER_BITS = 20
SLICE_BITS = 14
FILTER_BITS = 21
BLOCK = 4096


def shingles_of(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a batch, ordered by text and hash: (text's index, hash)."""
    raw, off = bytes_of(texts)
    h, doc, _, _ = words_of(raw, off)
    n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = np.zeros(len(h), np.uint64)
    for i in range(k):
        shifted = np.zeros(len(h), np.uint64)
        shifted[: len(h) - i] = h[i:]
        same = np.zeros(len(h), bool)
        same[: len(h) - i] = doc[i:] == doc[: len(h) - i]
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + np.where(same, shifted, np.uint64(0)))
    left = np.cumsum(n)[doc] - np.arange(len(h))  # words from here to the end
    keep = (left >= k) | ((n[doc] < k) & (left == n[doc]))
    doc, s = doc[keep], s[keep]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    return doc[new], s[new]


def set_hashes(s: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each text's set; at: where each text's shingles start (n + 1 places)."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(x)))]) for x in (0x1234567, 0xFEDCBA9876543)]
    return [x[at[1:]] - x[at[:-1]] for x in sums]


def counters(docs: DataFrame, k: int) -> np.ndarray:
    """2**COUNTER_BITS counters of all shingles of all documents (4 MB, whatever the input). Tasks send slices of
    their counters, each slice is summed by streaming."""
    part = 1 << SLICE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in batches:
            for i, j in slices(b.column(0)):
                _, s = shingles_of(b.column(0).slice(i, j - i), k)
                c += np.bincount((s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(c))
        for i in range(0, len(c), part):
            if c[i : i + part].any():
                yield pa.record_batch([pa.array([i // part]), pa.array([c[i : i + part].astype(np.uint32).tobytes()], pa.binary())], names=["part", "c"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        for i, x in sums.items():
            yield pa.record_batch([pa.array([i]), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["part", "c"])

    got = docs.mapInArrow(lean(count), "part long, c binary").repartition(16, "part").mapInArrow(total, "part long, c binary").collect()
    out = np.zeros(1 << COUNTER_BITS, np.uint32)
    for r in got:
        out[r.part * part : (r.part + 1) * part] = np.frombuffer(r.c, np.uint32)
    return out


def prefixes(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, s1, s2, p, prefix): set size, two hashes of the set, a hash of the prefix, the prefix itself."""
    spark = docs.sparkSession
    seen = spark.sparkContext.broadcast(counters(docs.select(text_col), k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = seen.value
        for b in batches:
            for i, j in slices(b.column(1)):
                doc, s = shingles_of(b.column(1).slice(i, j - i), k)
                m = j - i
                n = np.bincount(doc, minlength=m)
                at = np.zeros(m + 1, np.int64)
                np.cumsum(n, out=at[1:])
                s1, s2 = set_hashes(s, at)
                order = np.lexsort((s, c[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], doc))
                s = s[order]
                size = np.where(n > 0, n - (n * num + den - 1) // den + 1, 0)
                ends = np.cumsum(size)
                pick = np.repeat(at[:-1] - ends + size, size) + np.arange(ends[-1] if m else 0)
                pre = s[pick]
                place = np.arange(len(pre)) - np.repeat(ends - size, size)
                hashed = np.concatenate([[np.uint64(0)], np.cumsum(mix(pre + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))])
                p = hashed[ends] - hashed[ends - size]
                offs = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.record_batch([b.column(0).slice(i, m), pa.array(n.astype(np.int64)), pa.array(signed(s1)), pa.array(signed(s2)), pa.array(signed(p)), pa.ListArray.from_arrays(offs, pa.array(signed(pre)))], names=["id", "n", "s1", "s2", "p", "prefix"])

    return written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "id long, n long, s1 long, s2 long, p long, prefix array<long>"), "prefixes")


def promising(pairs: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose prefixes (heads: key, n, prefix) agree enough. Up to the prefix that ends first in the common
    order, common shingles lie in both prefixes; beyond, there are at most the shingles that this set has left."""
    x, y = (heads.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("prefix").alias(f"p{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b")
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(num) / F.lit(num + den) - F.lit(1e-9))
    left = F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    return both.where(F.size(F.array_intersect("pa", "pb")) >= need - left).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the similarity."""
    keys = written(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct(), "keys")
    cells = 1 << FILTER_BITS
    got = keys.select(F.pmod(F.xxhash64("key.id"), F.lit(cells)).cast("int").alias("c")).distinct().toArrow()
    bits = np.zeros(cells, bool)
    bits[got.column(0).to_numpy()] = True
    mask = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.unpackbits(mask.value).astype(bool)
        for b in batches:
            b = b.filter(pa.array(hit[b.column(2).to_numpy(zero_copy_only=False)]))
            for i, j in slices(b.column(1)):
                doc, s = shingles_of(b.column(1).slice(i, j - i), k)
                at = np.searchsorted(doc, np.arange(j - i + 1))
                data = s.tobytes()
                own = pa.StructArray.from_arrays([b.column(0).slice(i, j - i), pa.array(signed(set_hashes(s, at)[0]))], names=["id", "s1"])
                yield pa.record_batch([own, pa.array([data[8 * x : 8 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["key", "s"])

    some = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(cells)).cast("int").alias("c"))
    s = written(some.mapInArrow(lean(sets), "key struct<id:long,s1:long>, s binary").join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = pairs.join(s.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(s.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
    kind = "struct<id:long,s1:long>"
    return written(x.select("a", "b", "x", "y").mapInArrow(lean(test), f"a {kind}, b {kind}"), "verified")


def in_blocks(rows: DataFrame, key: str, blocks: str) -> tuple[DataFrame, DataFrame]:
    """Left and right sides of a join by cells: under each key, a row's block on its own side by every block of the other side,
    so that any two rows meet in one cell. ``key`` is hashed, ``blocks`` says how many there are."""
    mine = F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    return rows.select("*", mine.alias("row_block"), every.alias("col_block")), rows.select("*", every.alias("row_block"), mine.alias("col_block"))


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): class_id is the least id with the same set."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    d = prefixes(docs, k, num, den, id_col, text_col)
    sets = d.where("n > 0 and id is not null")
    own = ["n", "s1", "s2"]
    classes = written(sets.groupBy(*own).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("cnt")), "classes")
    narrow = d.select("id", *own)
    reps = sets.join(classes.select("id", *own), ["id", *own], "left_semi").dropDuplicates(["id", "s1", "s2"])
    reps = written(reps.select(F.struct("id", "s1").alias("key"), "n", "p", "prefix"), "reps")
    groups = written(reps.groupBy("n", "p").agg(F.min("key").alias("gid"), F.count(F.lit(1)).alias("cnt")), "groups")
    members = written(attach(reps.select(F.col("key").alias("cls"), "n", "p"), groups, ["n", "p"], "cnt", F.col("cls")).select("cls", "n", "gid"), "members")

    posts = reps.join(groups.select(F.col("gid").alias("key")), "key", "left_semi").select(F.col("key").alias("gid"), "n", F.posexplode("prefix").alias("pos", "tok"))
    tokens = written(posts.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("m", F.col("c")), "tokens")
    # sizes that may link lie in the same or in neighbouring ranges
    span = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    shared = written(attach(posts, tokens, ["tok"], "c", F.col("gid")).where("m is not null").select("gid", "n", "pos", "tok", "m", span.alias("span")), "postings")
    fits = lambda x, y: F.least(x, y) * F.lit(den) >= F.greatest(x, y) * F.lit(num)

    def enough(a: str, b: str) -> Column:
        """Whether this can be the first shingle, in the common order, that two linked sets share: what stands before it in
        either set is not in the other, so the rest of both must be as large as their overlap has to be."""
        na, nb = F.col(f"{a}n"), F.col(f"{b}n")
        rest = F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos"))
        return fits(na, nb) & (rest >= F.ceil((na + nb) * F.lit(num) / F.lit(num + den) - F.lit(1e-9)))

    firsts = written(shared.groupBy("tok", "span").agg(F.min(F.struct("gid", "n", "pos")).alias("f"), F.max("m").alias("c")), "firsts")
    near = attach(shared.select("gid", F.struct("n", "pos").alias("o"), "tok", F.explode(F.array("span", F.col("span") - 1)).alias("span")), firsts, ["tok", "span"], "c", F.col("gid"))
    first = near.where((F.col("gid") != F.col("f.gid")) & enough("o.", "f.")).select(F.least("gid", "f.gid").alias("a"), F.greatest("gid", "f.gid").alias("b"))
    first = written(first.union(members.where("cls <> gid").select(F.col("gid").alias("a"), F.col("cls").alias("b"))).distinct(), "pairs")
    heads = reps.select("key", "n", "prefix")
    ids = lambda x: x.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    # ids with several sets are linked with the ids that stand for these
    many = sets.groupBy("id").agg(F.min(F.struct(*own)).alias("lo"), F.max(F.struct(*own)).alias("hi")).where("lo <> hi").select("id")
    several = sets.select("id", *own).join(many, "id", "left_semi").join(classes.select(F.col("id").alias("b"), *own), own).select(F.col("id").alias("a"), "b")
    links = written(ids(verified(promising(first, heads, num, den), docs, k, num, den, id_col, text_col)).union(several), "links")
    comp = components(links)

    # what the first round has not joined
    of = members.join(comp.select(F.col("id").alias("cid"), "comp"), F.col("cls.id") == F.col("cid"), "left").select("cls", "gid", F.coalesce("comp", "cls.id").alias("comp"))
    of = written(of, "members")
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("blocks")
    spread = written(of.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")), "spread")
    apart = shared.join(spread.select("gid", "lo", "hi"), "gid").groupBy("tok").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("tok")
    open_ = written(shared.join(apart, "tok", "left_semi").select("gid", "n", "pos", "tok", "span").join(of, "gid").select("tok", "span", F.struct("cls", "comp", "n", "pos").alias("o")), "open")
    open_ = open_.join(open_.groupBy("tok").agg(F.count(F.lit(1)).alias("m")).select("tok", blocks), "tok")
    x, y = in_blocks(open_, "o.cls", "blocks")
    left = x.select("tok", F.col("o").alias("x"), F.explode(F.array(F.col("span") - 1, "span", F.col("span") + 1)).alias("span"), "row_block", "col_block")
    right = y.select("tok", F.col("o").alias("y"), "span", "row_block", "col_block")
    rest = left.join(right, ["tok", "span", "row_block", "col_block"]).where((F.col("x.cls") < F.col("y.cls")) & (F.col("x.comp") != F.col("y.comp")) & enough("x.", "y."))
    rest = rest.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    inside = of.join(spread.where("lo < hi").select("gid", blocks), "gid")
    x, y = in_blocks(inside, "cls", "blocks")
    same = x.select("gid", F.col("cls").alias("a"), F.col("comp").alias("ca"), "row_block", "col_block").join(y.select("gid", F.col("cls").alias("b"), F.col("comp").alias("cb"), "row_block", "col_block"), ["gid", "row_block", "col_block"]).where("a < b and ca <> cb").select("a", "b")
    rest = written(promising(written(rest.union(same).distinct(), "pairs").join(first, ["a", "b"], "left_anti"), heads, num, den), "pairs")
    if rest.limit(1).count():
        comp = components(links.union(ids(verified(rest, docs, k, num, den, id_col, text_col))))
    final = classes.join(comp.select("id", "comp"), "id", "left").select(*own, "cnt", F.col("id").alias("cls"), F.coalesce("comp", "id").alias("comp"))
    out = attach(narrow, written(final, "final"), own, "cnt", F.col("id"))
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("comp", "id")).otherwise(F.col("id")).alias("component_id"), F.when(linked, F.coalesce("cls", "id")).otherwise(F.col("id")).alias("class_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents whose id is their component's least; rows with a null id or no words stay. All columns as they were."""
    got = jaccard_components(docs, k, num, den)
    gone = got.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
