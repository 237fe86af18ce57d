"""Periodic runs of words within a text, by Kolpakov and Kucherov's method.

A text's words become numbers. A suffix automaton gives the factors of the Lempel-Ziv factorisation (each a new word, or the
longest stretch that starts earlier as well). By Main's algorithm, every run that crosses or touches the border before a factor
and ends within it shows up as a period whose common prefix and common suffix at the border add up to the period. A run inside
a factor is a copy of one at the factor's earlier place and is taken from there.

Before that, a test that loses no run leaves out what can hold none: in a run of period q, after its first q words, every word
has stood at most q words before, over 3q words or more. For each power of two at or above q, stretches of words whose last
place is that near and which are long enough are kept, with the words before them that the run may reach, and stretches that
overlap are joined; each is searched by itself, a word wider on both sides, so its runs are those of the text.

A text is handled whole within one task's Arrow batch; no rows are shuffled, so equal texts and hot sources need no care, and a
lost task is simply run again. Memory is in proportion to the longest text. Defined results: null or empty text has no words and
no runs; a null id gives a row of its own, of the text as it is; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import lean, small_batches

LEAST, TIMES = 6, 4
OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, with a repeating end for about one id in ten, as the id's checksum says."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def stretches(seq: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of words outside of which no run of at least ``times`` periods lies."""
    n = len(seq)
    if n < least:
        return []
    order = np.argsort(seq, kind="stable")
    same = seq[order[1:]] == seq[order[:-1]]
    back = np.full(n, n + 1, np.int64)  # words since the last place of the same word
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found = []
    top = 1  # periods in (top / 2, top]
    while top // 2 + 1 <= n // times:
        q = top // 2 + 1 if top > 1 else 1
        need = max((times - 1) * q, least - top)
        near = np.flatnonzero(np.diff(np.concatenate([[False], back <= top, [False]]).view(np.int8)))
        a, b = near[::2], near[1::2]
        ok = b - a >= need
        found += zip((a[ok] - top - 1).tolist(), (b[ok] + 1).tolist(), strict=True)
        top *= 2
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        a, b = max(a, 0), min(b, n)
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, end, start of an earlier place or -1) from a suffix automaton."""
    go: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        cur = len(go)
        go.append({})
        link.append(0)
        size.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                new = len(go)
                go.append(go[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = new
                    p = link[p]
                link[q] = link[cur] = new
        last = cur
    out, i, n = [], 0, len(s)
    while i < n:
        at, j = 0, i
        while j < n and (to := go[at].get(s[j])) is not None and first[to] < j:
            at, j = to, j + 1
        if j == i:
            out.append((i, i + 1, -1))
            i += 1
        else:
            out.append((i, j, first[at] - (j - i) + 1))
            i = j
    return out


def prefixes(s: list[int]) -> list[int]:
    """For each place, the length of the longest stretch from it that also begins ``s``."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    a = b = 0
    for i in range(1, n):
        k = min(b - i, z[i - a]) if i < b else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def runs_of(s: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of at least ``times`` periods and ``least`` words, by start."""
    s = [*s, -1]  # a last factor of its own, so that every run ends before a border
    n = len(s)
    period: dict[tuple[int, int], int] = {}
    ending: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # (start, period) by end

    def add(start: int, end: int, p: int) -> None:
        if end - start >= max(least, times * p):
            old = period.get((start, end))
            if old is None or p < old:
                period[start, end] = p
                ending[end] = [(a, q) for a, q in ending[end] if a != start] + [(start, p)]

    before = 0
    for b, e, source in factors(s):
        lo = max(0, b - 2 * before - (e - b))
        t, v = s[lo:b], s[b:e]
        m, k = len(t), len(v)
        most = (m + k) // times  # no longer period has enough words here
        if most and m:
            more = s[b : min(n, e + 1)]  # one word more shows whether a run ends with the factor
            rev = t[::-1]
            # periods with a whole one right of the border
            ahead = prefixes(more)
            both = prefixes([*rev, -2, *s[lo : b + min(k, most)][::-1]])
            for p in range(1, min(k, most) + 1):
                right = ahead[p] if p < len(more) else 0
                left = both[m + 1 + min(k, most) - p]
                if left + right >= p and (left < m or lo == 0) and b + p + right <= e:
                    add(b - left, b + p + right, p)
            # periods with a whole one left of it
            behind = prefixes(rev)
            over = prefixes([*more, -2, *t[max(0, m - most) :], *more])
            w = min(m, most)
            for p in range(1, w + 1):
                left = behind[p] if p < m else 0
                right = min(over[len(more) + 1 + w - p], len(more))
                if left + right >= p and (p + left < m or lo == 0) and b + right <= e:
                    add(b - p - left, b + right, p)
        if source >= 0:
            shift = b - source
            for end in range(source + 2, e - shift):
                for start, p in list(ending[end]):
                    if start > source:
                        add(start + shift, end + shift, p)
        before = e - b
    return sorted((a, b, p) for (a, b), p in period.items())


def all_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a text's words, as (start, length, period)."""
    number: dict[bytes, int] = {}
    seq = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out = []
    for a, b in stretches(seq):
        out += [(a + x, y - x, p) for x, y, p in runs_of(seq[a:b].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, spans: bool = False) -> DataFrame:
    """(id_col, n_runs, start, length, period, exponent_milli of the run with the greatest exponent, digests of all runs and of
    the text without repeats). ``spans``: also runs array<struct<start, length, period>> and collapsed, the text itself, kept
    words joined by a space. ``plant`` repeats the ends of some texts first, as the benchmark query asks."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                if plant:
                    words = planted(words, key)
                found = all_runs(words)
                gone: set[int] = set()
                for a, length, p in found:
                    gone.update(range(a + p, a + length))
                kept = b" ".join([w for i, w in enumerate(words) if i not in gone] if gone else words)
                best = None
                for r in found:
                    if best is None or (r[1] * best[2], -r[0], -r[2]) > (best[1] * r[2], -best[0], -best[2]):
                        best = r
                said = "".join(f"{a},{n},{p}\n" for a, n, p in found).encode()
                row = [len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(said).hexdigest(), hashlib.sha256(kept).hexdigest()]
                if spans:
                    row += [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found], kept.decode()]
                for c, x in zip(cols, row, strict=False):
                    c.append(x)
            types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(one), pa.string()][: 9 if spans else 7]
            names = [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
            yield pa.record_batch([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=False)]], names=names[: len(types) + 1])

    extra = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" * spans
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, {OUT}{extra}")
