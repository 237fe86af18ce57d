"""Line dedup: repeated runs of lines, found by hashes of short windows of lines; later copies go.

A document is a sequence of its lines that hold words; a line's name is a 128-bit hash of the line without white space at
its ends. The blocks of 2, 4, ... lines that start at each line are named from the names of their halves, within a record
batch; a window is named by its length and its two longest blocks, which overlap. Windows of one name are one group, in which
the first place, by document id and line, stays, and later ones are deleted. This stands in for prefix doubling over a suffix
array's intervals, which would find the same lines: there is no suffix array and no doubling across the cluster.

A repeated run counts when it has at least ``min_words`` words. Every line of such a run lies in a least window of that many
words within the run, which starts or ends there, and each such window repeats with the run; so the runs' union is that of
the repeated least windows, two a line at most. They have at most ``min_words`` lines, which bounds the levels of doubling
whatever the documents' lengths, and all go through one grouping.

Defined results: null and empty texts stay as they are; blank lines belong to no run and stay; a text loses whole lines with
the line break after them (the last line: before it); rows with the same id and text are one document and change alike;
null ids come last in the order; other columns stay as they are, but in ``dedup_lines`` an input column removed_lines gives way
to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm.common import SPACE, attach, bytes_of, lean, mix, powers, signed, slices, small_batches, written

_g = np.random.default_rng(99)
EXACT = [_g.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
ODD = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def lines_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines that hold words: text's index, line number, words, two hashes."""
    n = len(raw)
    solid = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[:1] = True
    np.logical_not(solid[:-1], out=before[1:])
    start = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = True
    np.logical_not(solid[1:], out=after[:-1])
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    doc = np.searchsorted(off, start, side="right") - 1
    breaks = np.zeros(n + 1, np.int64)
    np.cumsum(raw == 10, out=breaks[1:])
    number = breaks[start] - breaks[off[doc]]
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    a, b = start[first], end[first + count - 1]
    size = b - a
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    chars = raw[np.repeat(a, size) + place]
    step = powers(int(size.max()))[place]
    names = [mix(np.add.reduceat(t[chars] * step, ends - size) ^ size.astype(np.uint64)) for t in EXACT]
    return doc[first], number[first], count, *names


def windows_of(doc: np.ndarray, words: np.ndarray, names: tuple[np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """Least windows with enough words: first line, lines, two names. From each line on and up to each line there is one at
    most. Doubling names blocks of 2**k lines; a window is named by its length and the two longest blocks at its ends."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    s = np.arange(n)
    e = np.searchsorted(total, total[:-1] + least) - 1
    ok = (e < n) & (doc[np.minimum(e, n - 1)] == doc)
    back = np.searchsorted(total, total[1:] - least, side="right") - 1
    ok2 = (back >= 0) & (doc[np.maximum(back, 0)] == doc)
    both = np.unique(np.concatenate([s[ok] * (least + 1) + (e - s + 1)[ok], back[ok2] * (least + 1) + (s - back + 1)[ok2]]))
    first, size = both // (least + 1), both % (least + 1)
    out = [np.zeros(len(first), np.uint64) for _ in names]
    k, h = 0, 1
    while len(size) and h <= size.max():
        at = np.flatnonzero((size >= h) & (size < 2 * h))
        for o, t, odd in zip(out, names, ODD, strict=True):
            o[at] = mix(t[first[at]] * odd + mix(t[first[at] + size[at] - h] + size[at].astype(np.uint64)))
        k, h = k + 1, 2 * h
        names = tuple(mix(t[: n - h + 1] * odd + mix(t[h // 2 : n - h // 2 + 1] + np.uint64(k))) if n >= h else t for t, odd in zip(names, ODD, strict=True))
    return first, size, *out


def repeated_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, th, lines): by document (its id and its text's hash) the numbers of the lines that later copies hold."""
    small_batches(docs.sparkSession, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(2)):
                doc, number, words, h1, h2 = lines_of(*bytes_of(b.column(2).slice(i, j - i)))
                rid, th = (b.column(c).slice(i, j - i).to_numpy() for c in (0, 1))
                if len(doc):
                    p, size, a, c = windows_of(doc, words, (h1, h2), min_words)
                    ends = np.cumsum(size)
                    every = number[np.repeat(p - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(every.astype(np.int32)))
                    yield pa.record_batch([pa.array(rid[doc[p]]), pa.array(th[doc[p]]), pa.array(number[p].astype(np.int32)), lists, pa.array(signed(a)), pa.array(signed(c))], names=["rid", "th", "at", "lines", "n1", "n2"])

    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    some = docs.where(F.col(text_col).isNotNull()).select(key.alias("rid"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows = written(some.mapInArrow(lean(run), "rid long, th long, at int, lines array<int>, n1 long, n2 long"), "blocks")
    first = written(rows.groupBy("n1", "n2").agg(F.min(F.struct("rid", "th", "at")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "intervals")
    later = attach(rows, first, ["n1", "n2"], "c", F.struct("rid", "at")).where(F.struct("rid", "th", "at") > F.col("first"))
    return later.groupBy("rid", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("lines"))


@F.pandas_udf(StringType())
def _without(text, lines):  # noqa: ANN001
    """Texts without the numbered lines; null where there is nothing to do."""
    import pandas as pd

    def one(t, gone):  # noqa: ANN001, ANN202
        if t is None or gone is None:
            return None
        gone = set(map(int, gone))
        return "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)

    return pd.Series([one(t, g) for t, g in zip(text, lines, strict=True)], dtype=object)


def _cut(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """docs with later copies of repeated runs cut out of ``text_col``, and removed__."""
    gone = repeated_lines(docs, min_words, id_col, text_col)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    own = docs.select("*", key.alias("rid__"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th__"))
    gone = gone.select(F.col("rid").alias("rid__"), F.col("th").alias("th__"), F.col("lines").alias("lines__"))
    both = own.join(gone, ["rid__", "th__"], "left")
    cut = _without(F.when(F.col("lines__").isNotNull(), F.col(text_col)), F.col("lines__"))
    text = F.coalesce(cut, F.col(text_col)).alias(text_col)
    return both.select(*[text if c == text_col else F.col(c) for c in docs.columns], F.coalesce("lines__", F.expr("cast(array() as array<int>)")).alias("removed__"))


def dedup_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of repeated runs cut out of ``text_col``, and removed_lines array<int> (empty if none)."""
    out = _cut(docs, min_words, id_col, text_col)
    return out.select(*[c for c in docs.columns if c != "removed_lines"], F.col("removed__").alias("removed_lines"))


def drop_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """The pipeline's form: the columns of documents, n_chars anew where lines went; documents of which no word is left
    go, unless they had none before."""
    out = _cut(docs, min_words, "doc_id", "text")
    hit = F.size("removed__") > 0
    cols = [F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.where(~hit | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*cols)
