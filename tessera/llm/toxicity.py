"""Toxicity: cumulative-link ordinal regression over sparse words.

Severity has ordered grades 0..K; P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all thresholds
t_0 < t_1 < ... A text's features are its distinct words, hashed, longer ones by their first HEAD bytes, and the beginnings of
STEMS bytes of longer words, so that forms of a word which no label has count too; a feature counts once however long the text.
Trained on a bounded sample of labelled rows (``sample``, about: those whose hashed ids are smallest), here by proximal AdaGrad
with a penalty that keeps weights of features which few texts bear out at zero. Expected severity is the sum of P(grade > k).

What reaches the driver has a bound: features that at most TEXTS or over COMMON of the sample's texts have are left out on the
executors, and of a text's others the MOST_FEATURES with the smallest hashes stay: 16 KB a sampled text, however long texts are.

Grades come from labels: 0 where toxic = 0, 1 for a toxic text of good quality, 2 for a toxic text of low quality. The
threshold for rejection is the one that does best on the sample's rows, each scored by a model of the other FOLDS - 1 parts.

Scoring is one pass over all texts, whole, with no shuffle; the model (two numbers a feature, a fixed table) is broadcast.

Defined results: null, empty and wordless texts have expected severity 0 and grade 0; repeated rows score alike; a label
counts once per document, contradictory ones as the worst; of several texts of one id training takes the one whose hash is
least; labels without a document, null labels and null ids are left out of training; without any label, or with labels of
one kind, nothing is rejected; other columns stay as they are, but input columns named expected_severity, grade or rejected
give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE, bytes_of, lean, mix, powers, sampled, sent, slices, small_batches, trim, words_of, written

BITS = 20
LEAST = -0.1
HEAD = 8
STEMS = (4, 5, 6, 7)
TEXTS, COMMON, MOST_FEATURES, FOLDS = 3.0, 0.3, 4000, 4


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, feature), distinct, ordered by text: words without marks at their ends, no more than HEAD bytes of
    each, and the shorter beginnings of STEMS bytes of longer ones, hashed to BITS bits."""
    raw, off = bytes_of(texts)
    # marks and digits count as spaces, so that "word," and "word" are one feature
    plain = raw.copy()
    plain[(raw < 128) & ~_ALPHA[raw]] = 32
    h, doc, start, end = words_of(plain, off)
    size = end - start
    stems, docs = [], []
    p = powers(HEAD)
    head, longest = np.zeros(len(start), np.uint64), size > HEAD
    for i in range(HEAD):
        at = np.flatnonzero(size > i)
        head[at] += BYTE[plain[start[at] + i]] * p[i]
        if i + 1 in STEMS:
            at = np.flatnonzero(size > i + 1)
            stems.append(mix(head[at] ^ np.uint64(i + 1 + 256)))
            docs.append(doc[at])
    h[longest] = mix(head[longest] ^ np.uint64(HEAD))
    h, doc = np.concatenate([h, *stems]), np.concatenate([doc, *docs])
    f = np.unique(doc << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
    return f >> BITS, f & ((1 << BITS) - 1)


_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Ordinal:
    """Weights of features and the ordered thresholds; cut: expected severity from which a text is rejected."""

    w: np.ndarray
    t: np.ndarray
    cut: float = float("inf")

    def raw(self, doc: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.w[f], minlength=n) if len(doc) else np.zeros(n)

    def above(self, doc: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        p = _sigmoid(self.raw(doc, f, n)[:, None] - self.t[None, :])
        p[np.bincount(doc, minlength=n) == 0] = 0
        return p


def fit(doc: np.ndarray, f: np.ndarray, y: np.ndarray, texts: float = TEXTS) -> Ordinal:
    """Ordinal regression; y are grades 0..K. First the features are chosen: one must explain what is left of more than
    ``texts`` examples to have a weight, so texts aren't learnt by heart; those that a few rounds leave at zero go at once, which
    makes the other rounds cheap. Then the chosen features' weights are fitted anew."""
    for rounds, rate in ((30, 0.1), (250, 0.2)):
        chosen = (_descend(doc, f, y, texts, rounds, rate).w != 0)[f]
        doc, f = doc[chosen], f[chosen]
    return _descend(doc, f, y, texts / 12)


def _sums(values: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[at] between consecutive starts, about a million at a time, so that working memory stays small."""
    edges = np.append(starts, len(at))
    out, i = np.empty(len(starts)), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + (1 << 20), side="right")) - 1)
        out[i:j] = np.add.reduceat(values[at[edges[i] : edges[j]]], edges[i:j] - edges[i])
        i = j
    return out


def _descend(doc: np.ndarray, f: np.ndarray, y: np.ndarray, texts: float, rounds: int = 250, rate: float = 0.5) -> Ordinal:
    """Proximal AdaGrad over all examples (doc ascending), with a penalty of ``texts`` / examples on absolute weights; none is below LEAST."""
    top = int(y.max())
    df = sum((np.bincount(f[i : i + (1 << 20)], minlength=1 << BITS) for i in range(0, len(f), 1 << 20)), np.zeros(1 << BITS, np.int64))
    keep = (df > texts)[f]
    used = np.flatnonzero(df > texts)
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    doc, f = doc[keep].astype(np.int32), place[f[keep]]
    above = y[:, None] > np.arange(top)[None, :]
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    w, t = np.zeros(len(used)), -np.log(share / (1 - share))
    gw, gt = np.full(len(used), 1e-12), np.full(top, 1e-12)
    n = len(y)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    some = doc[starts]
    by_word = doc[np.argsort(f, kind="stable")]
    firsts = np.cumsum(df[used]) - df[used]
    s = np.zeros(n)
    for _ in range(rounds):
        s[some] = _sums(w, f, starts)
        err = _sigmoid(s[:, None] - t[None, :]) - above
        g = _sums(err.sum(axis=1), by_word, firsts) / n
        gw += g**2
        step = rate / np.sqrt(gw)
        w = w - step * g
        # words that speak for a text weigh little, so that length doesn't outweigh insults
        w = np.maximum(np.sign(w) * np.maximum(np.abs(w) - step * texts / n, 0), LEAST)
        g = -err.mean(axis=0)
        gt += g**2
        t = np.maximum.accumulate(t - rate / 3 * g / np.sqrt(gt))
    m = Ordinal(np.zeros(1 << BITS), t)
    m.w[used] = w
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> Ordinal | None:
    """The model, from about ``sample`` labelled documents, those with the smallest hashed ids; None if labels are of one kind."""
    lab = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("x"), F.min("quality").alias("g"))
    chosen = sampled(lab, F.col("doc_id"), sample)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "x", "g").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = joined.select("doc_id", F.when(F.col("x") == 0, 0).otherwise(F.when(F.coalesce("g", F.lit(0)) > 0, 1).otherwise(2)).cast("long").alias("y"), "text")
    small_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(2)):
                doc, f = features_of(b.column(2).slice(i, j - i))
                at = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.record_batch([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(f.astype(np.int32)))], names=["doc_id", "y", "f"])

    rows = written(got.mapInArrow(lean(run), "doc_id long, y long, f array<int>"), "features")
    n = rows.count()
    often = rows.select(F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > TEXTS) & (F.col("n") <= max(COMMON * n, TEXTS + 1)))
    known = np.zeros(1 << BITS, bool)
    known[often.select("f").toArrow().column(0).to_numpy()] = True
    held = sent(docs.sparkSession, np.packbits(known))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(held()).astype(bool)
        for b in batches:
            fs = [x[keep[x]][:MOST_FEATURES] for x in (v.values.to_numpy() for v in b.column(2))]
            at = np.cumsum([0, *map(len, fs)]).astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *fs])))], names=["doc_id", "y", "f"])

    t = rows.mapInArrow(lean(thin), "doc_id long, y long, f array<int>").toArrow().combine_chunks()
    ids, y = t.column(0).to_numpy(), t.column(1).to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    order = np.argsort(ids, kind="stable")
    lists = t.column(2).combine_chunks().take(pa.array(order))
    y = y[order]
    f = lists.flatten().to_numpy()
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    del t
    y = np.unique(y, return_inverse=True)[1]  # grades without examples close up
    p = np.zeros(len(y))
    for k in range(FOLDS):
        own = np.arange(len(y)) % FOLDS != k
        if own.all() or y[own].min() == y[own].max():
            continue
        place, mine = (np.cumsum(own) - 1).astype(np.int32), own[doc]
        inner = fit(place[doc[mine]], f[mine], np.unique(y[own], return_inverse=True)[1])
        p[~own] = inner.above(doc, f, len(y)).sum(axis=1)[~own]
    tries = np.linspace(0.04, 1.0, 49)
    # a clean text lost weighs as much as two toxic ones kept
    cost = [((p < c) & (y > 0)).sum() + 2 * ((p >= c) & (y == 0)).sum() for c in tries]
    best = np.flatnonzero(np.array(cost) == min(cost))
    m = fit(doc, f, y)
    m.cut = float(tries[best[len(best) // 2]])
    del doc, f, lists
    trim()
    return m


def _scored(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """docs with severity__ (s, g) and rejected__."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    held = sent(spark, model)

    @F.arrow_udf("struct<s: double, g: int>")
    def severity(texts: pa.Array) -> pa.Array:
        m, s, g = held(), [], []
        for i, j in slices(texts):
            p = m.above(*features_of(texts.slice(i, j - i)), j - i) if m else np.zeros((j - i, 1))
            s.append(p.sum(axis=1))
            g.append((p > 0.5).sum(axis=1))
        empty = np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(np.concatenate([empty, *s])), pa.array(np.concatenate([empty, *g]).astype(np.int32))], names=["s", "g"])

    cut = F.lit(model.cut if model else float("inf"))
    return docs.select("*", severity(F.coalesce(F.col("text"), F.lit(""))).alias("severity__")).withColumn("rejected__", F.col("severity__.s") >= cut)


def score(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """docs with expected_severity double, grade int (the most that is more likely than not), rejected boolean."""
    own = [c for c in docs.columns if c not in ("expected_severity", "grade", "rejected")]
    return _scored(docs, model).select(*own, F.col("severity__.s").alias("expected_severity"), F.col("severity__.g").alias("grade"), F.col("rejected__").alias("rejected"))


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> DataFrame:
    """The pipeline's form: documents that are not rejected, as they were."""
    return _scored(docs, train(docs, labels, sample)).where("not rejected__").select(*docs.columns)
