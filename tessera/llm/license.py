"""License scans: a classifier of paragraphs, confirmed by templates.

A paragraph is a line, or lines up to a blank one (a line without letters or digits is blank): both are judged, and where a
paragraph of several lines holds a line that is a notice by itself, the line is the finding, so a wrapped notice is found whole
and a notice within other text is found by itself. Features are the words and word pairs that occur in templates of licence
notices, once each, scaled by the paragraph's length; sparse multinomial logistic regression over licence families and an
unknown class is trained on templates with random context and gaps, against paragraphs of the corpus: of about ``sample``
documents, those with the smallest hashes, the ``most`` paragraphs with the smallest hashes; executors send only their known
features, so what reaches the driver doesn't grow with the input or its texts. Scores are calibrated on held-out examples by a
temperature, and unknown is a class like others, so a paragraph of which no family is likelier than not is unknown. A
prediction counts once the paragraph holds at least ``confirm`` of the words and pairs of a template of its family.

Scoring is one pass over whole texts without a shuffle; the model is a fixed table of the templates' features.

Defined results: null and empty texts have no findings; repeated rows give repeated findings; null ids are kept; several
notices in a document are several findings; other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, lean, mix, sampled, sent, signed, slices, small_batches, words_of
from tessera.llm.toxicity import _ALPHA

#: Usual wordings of notices, by family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "This document is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
    ],
}
UNKNOWN = "unknown"


def paragraphs_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Features of a batch: paragraph's index, feature hash; then each paragraph's text index, first line, last line and words.
    Lines come first, then paragraphs of several lines."""
    raw, off = bytes_of(texts)
    plain = raw.copy()
    keep = _ALPHA[raw] | ((raw >= 48) & (raw <= 57)) | (raw == 10)
    plain[~keep & (raw < 128)] = 32
    h, doc, _, _, line = words_of(plain, off, lines=True)
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, h, z, z, z, z
    # lines before each text: words_of counts line breaks and texts' starts, a start at a line break once
    breaks = np.flatnonzero(raw == 10)
    starts = off[:-1][off[:-1] < len(raw)]
    before = np.searchsorted(np.union1d(breaks, starts), off[doc], "right") - (raw[off[doc]] == 10)
    line = line - before
    other = np.ones(len(h), bool)
    other[1:] = doc[1:] != doc[:-1]
    gap = np.diff(line, prepend=line[:1])
    pair = mix(h[:-1] * np.uint64(3) + h[1:])
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    base = 0
    for new, least in ((other | (gap != 0), 1), (other | (gap > 1), 2)):
        par = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(h)) - 1
        good = line[last] - line[first] + 1 >= least
        name = np.where(good, np.cumsum(good) - 1 + base, -1)
        same = (par[1:] == par[:-1]) & good[par[1:]]
        one = good[par]
        for o, x in zip(out, (np.concatenate([name[par[one]], name[par[1:][same]]]), np.concatenate([h[one], pair[same]]), doc[first[good]], line[first[good]], line[last[good]], (last - first + 1)[good]), strict=True):
            o.append(x)
        base += int(good.sum())
    return tuple(np.concatenate(o) for o in out)


class Model:
    """Vocabulary (sorted hashes), a first sieve over their high bits, weights, classes and templates' features."""

    SIEVE = 22

    def __init__(self) -> None:
        self.classes = [UNKNOWN, *TEMPLATES]
        texts = [(k, t) for k, ts in TEMPLATES.items() for t in ts]
        par, f, doc, *_ = paragraphs_of(pa.array([t for _, t in texts]))
        self.vocab = np.unique(f)
        self.sieve = np.zeros(1 << self.SIEVE, bool)
        self.sieve[(self.vocab >> np.uint64(64 - self.SIEVE)).astype(np.int64)] = True
        self.templates = [(k, t, np.searchsorted(self.vocab, np.unique(f[doc[par] == i]))) for i, (k, t) in enumerate(texts)]
        self.w = np.zeros((len(self.vocab) + 1, len(self.classes)), np.float32)
        self.heat = 1.0

    def known(self, par: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all features those of the vocabulary, once a paragraph: paragraph, place in the vocabulary."""
        at = np.flatnonzero(self.sieve[(f >> np.uint64(64 - self.SIEVE)).astype(np.int64)])
        par, f = par[at], f[at]
        v = np.minimum(np.searchsorted(self.vocab, f), len(self.vocab) - 1)
        ok = self.vocab[v] == f
        both = np.unique(par[ok] * len(self.vocab) + v[ok])
        return both // len(self.vocab), both % len(self.vocab)

    def scores(self, par: np.ndarray, v: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Calibrated class probabilities of the paragraphs 0..len(words)."""
        s = np.zeros((len(words), len(self.classes)), np.float64)
        x = self.w[v].astype(np.float64)
        for c in range(len(self.classes)):
            s[:, c] = np.bincount(par, x[:, c], minlength=len(words)) / np.sqrt(words) + self.w[-1, c]
        s *= self.heat
        s -= s.max(axis=1, keepdims=True)
        e = np.exp(s)
        return e / e.sum(axis=1, keepdims=True)


def background(docs: DataFrame, m: Model, sample: int, most: int, seed: int) -> list[tuple[list[int], int]]:
    """(known features, words) of paragraphs of the corpus that hold no notice by the look of it."""
    chosen = sampled(docs.where(F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"), "text"), F.col("h"), sample)
    small_batches(docs.sparkSession, 500)
    held = sent(docs.sparkSession, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held()
        for b in batches:
            for i, j in slices(b.column(1)):
                par, f, doc, first, _, words = paragraphs_of(b.column(1).slice(i, j - i))
                p, v = m.known(par, f)
                n = np.bincount(p, minlength=len(words))
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                key = mix(b.column(0).slice(i, j - i).to_numpy().view(np.uint64)[doc] + (first * 2 + (np.arange(len(words)) > 0)).astype(np.uint64))
                yield pa.record_batch([pa.array(signed(key)), pa.ListArray.from_arrays(pa.array(at), pa.array(v.astype(np.int32))), pa.array(words)], names=["h", "v", "n"]).filter(pa.array(n < 0.5 * (2 * words - 1)))

    got = chosen.mapInArrow(lean(run), "h long, v array<int>, n long").distinct().orderBy("h", "n").limit(most).collect()
    return [(r.v, r.n) for r in got]


def train(docs: DataFrame, sample: int = 1000, most: int = 6000, seed: int = 8) -> Model:
    """The model, against at most ``most`` paragraphs of about ``sample`` documents."""
    m = Model()
    rng = np.random.default_rng(seed)
    back = background(docs, m, sample, most, seed)
    texts, y = [], []
    filler = [f"filler{i}" for i in range(500)]
    for c, k in enumerate(m.classes[1:], 1):
        for t in TEMPLATES[k]:
            ws = t.split()
            for r in range(30):
                part = list(ws)
                if r % 3 and len(part) > 6:
                    part = [w for w in part if rng.random() > 0.08]
                n = int(rng.integers(0, 6)) if r % 2 else 0
                extra = [filler[i] for i in rng.integers(0, len(filler), n)]
                cut = int(rng.integers(0, n + 1))
                texts.append(" ".join(extra[:cut] + part + extra[cut:]))
                y.append(c)
            # single words of notices are not notices
            for _ in range(12):
                few = [ws[i] for i in rng.integers(0, len(ws), max(1, len(ws) // 8))] + [filler[i] for i in rng.integers(0, len(filler), 12)]
                texts.append(" ".join(few[i] for i in rng.permutation(len(few))))
                y.append(0)
    par, f, doc, _, _, words = paragraphs_of(pa.array(texts, pa.string()))
    y = np.array(y)[doc]
    p, v = m.known(par, f)
    p = np.concatenate([p, len(words) + np.repeat(np.arange(len(back)), [len(v) for v, _ in back])]).astype(np.int64)
    v = np.concatenate([v, *(np.array(v, np.int64) for v, _ in back)])
    words, y = np.append(words, [n for _, n in back]).astype(np.float64), np.append(y, np.zeros(len(back), np.int64)).astype(np.int64)
    x = np.zeros((len(words), len(m.vocab)), np.float32)
    x[p, v] = (1 / np.sqrt(words))[p]
    held = rng.random(len(y)) < 0.2
    target = np.eye(len(m.classes), dtype=np.float32)[y]
    xt, tt = x[~held], target[~held]
    w, b = np.zeros((x.shape[1], len(m.classes)), np.float32), np.zeros(len(m.classes), np.float32)
    b[0] = 1
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(150):
        s = xt @ w + b
        e = np.exp(s - s.max(axis=1, keepdims=True))
        err = (e / e.sum(axis=1, keepdims=True) - tt) / len(xt)
        g = xt.T @ err + 1e-5 * w
        gw += g * g
        w -= 0.5 * g / np.sqrt(gw)
        g = err.sum(axis=0)
        gb += g * g
        b -= 0.2 * g / np.sqrt(gb)
    m.w[:-1], m.w[-1] = w, b
    s = x[held] @ w + b
    best = (np.inf, 1.0)
    for heat in np.linspace(0.4, 4, 37):
        z = s * heat
        z = z - z.max(axis=1, keepdims=True)
        best = min(best, (float(-(z[np.arange(len(z)), y[held]] - np.log(np.exp(z).sum(axis=1))).mean()), float(heat)))
    m.heat = best[1]
    return m


def scan(docs: DataFrame, model: Model, likely: float = 0.5, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, family, probability, template, agreement, paragraph) of the confirmed notices."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    held = sent(spark, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held()
        for b in batches:
            for i, j in slices(b.column(1)):
                texts = b.column(1).slice(i, j - i)
                par, f, doc, line, last, words = paragraphs_of(texts)
                p, v = m.known(par, f)
                # a paragraph without features is as unknown as the bias says; only the others are scored
                some, inv = np.unique(p, return_inverse=True)
                if not len(some):
                    continue
                prob = m.scores(inv, v, words[some])
                c = prob.argmax(axis=1)
                out, lines = [], set()
                for k in np.flatnonzero((c > 0) & (prob[np.arange(len(c)), c] >= likely)):
                    q = some[k]
                    d, a, z = int(doc[q]), int(line[q]), int(last[q])
                    if z > a and any((d, x) in lines for x in range(a, z + 1)):
                        continue  # the lines come first
                    own = v[np.searchsorted(p, q) : np.searchsorted(p, q, "right")]
                    share = lambda t: len(np.intersect1d(own, t[2], assume_unique=True)) / len(t[2])  # noqa: B023, E731
                    best = max((t for t in m.templates if t[0] == m.classes[c[k]]), key=share)
                    if share(best) >= confirm:
                        lines.add((d, a))
                        out.append((d, a, best[0], float(prob[k, c[k]]), best[1], share(best), "\n".join(texts[d].as_py().split("\n")[a : z + 1])))
                if out:
                    cols = list(zip(*out, strict=True))
                    ids = b.column(0).slice(i, j - i).take(pa.array(cols[0]))
                    yield pa.record_batch([ids, pa.array(cols[1], pa.int32()), *(pa.array(x, t) for x, t in zip(cols[2:], (pa.string(), pa.float64(), pa.string(), pa.float64(), pa.string()), strict=True))], names=["doc_id", "line", "family", "probability", "template", "agreement", "paragraph"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, line int, family string, probability double, template string, agreement double, paragraph string")
