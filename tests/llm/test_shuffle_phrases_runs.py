"""Sharding, phrase collocations and periodic runs against brute force, and on rows that are null, empty, long, tied or repeated."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, queries, runs, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, shard string, slot int, part int, phrase string, rank string, m__ long, n_runs string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, "clash", "r", 3, "n") for i, t, lang in rows], DOCS)


# --- sharding ---


def test_every_row_has_one_place_in_shards_of_exact_sizes(spark):
    rows = [(i % 700 if i % 11 else None, None if i % 13 == 0 else "same" if i % 3 else f"t{i}", "en") for i in range(1000)]
    out = sharding.shuffled(docs_of(spark, rows).repartition(6), 7, seed=3).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t) for i, t, _ in rows)
    assert sorted(Counter(r.shard for r in out).items()) == [(j, 143 if j < 6 else 142) for j in range(7)]
    for j in range(7):
        assert sorted(r.slot for r in out if r.shard == j) == list(range(143 if j < 6 else 142))
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None} and {r.m__ for r in out} == {3} and {r.phrase for r in out} == {"clash"}


def test_an_empty_table_and_more_shards_than_rows(spark):
    assert sharding.shuffled(docs_of(spark, []), 5).count() == 0
    out = sharding.shuffled(docs_of(spark, [(1, "a", None), (1, "a", None)]), 5).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(0, 0), (1, 0)]


def test_the_shuffle_is_uniform_and_its_own_for_each_seed(spark):
    df = spark.range(12_000).repartition(5)
    a = {r.id: (r.shard, r.slot) for r in sharding.shuffled(df, 6, seed=1).collect()}
    b = {r.id: (r.shard, r.slot) for r in sharding.shuffled(df, 6, seed=2).collect()}
    assert sum(a[i] == b[i] for i in a) < 20
    # neither the shard nor the slot tells where a row came from: 10 ranges of ids against 6 shards x 4 ranges of slots
    for got in (a, b):
        seen = np.zeros((10, 24))
        for i, (j, k) in got.items():
            seen[i // 1200, 4 * j + k * 4 // 2000] += 1
        chi = ((seen - 50) ** 2 / 50).sum()
        assert abs(chi - 207) < 5 * np.sqrt(2 * 207), chi
    order = [i for i, (j, k) in sorted(a.items(), key=lambda x: x[1])]
    assert abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 0.05


def test_the_matrix_is_drawn_as_a_shuffle_would_have_it():
    rng = np.random.default_rng(4)
    rows, places = [3, 0, 2, 4], [4, 3, 2]
    n = 20_000
    drawn = Counter(str(sharding.drawn(rng, rows, places)) for _ in range(n))
    where = np.repeat(np.arange(4), rows)
    shuffled = Counter()
    for _ in range(n):
        cols = rng.permutation(np.repeat(np.arange(3), places))
        shuffled[str([[int(((where == i) & (cols == j)).sum()) for j in range(3)] for i in range(4)])] += 1
    assert all(abs(drawn[k] - shuffled[k]) < 6 * np.sqrt(max(drawn[k], shuffled[k])) + 8 for k in drawn | shuffled)


def test_draws_beyond_the_library_s_range():
    rng = np.random.default_rng(1)
    for good, bad, n in ((5 * 10**9, 3 * 10**9, 2 * 10**9), (2 * 10**9, 10**4, 10**6)):
        x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(2000)], float)
        total = good + bad
        mean, var = n * good / total, n * good / total * bad / total * (total - n) / (total - 1)
        assert abs(x.mean() - mean) < 5 * np.sqrt(var / 2000) and 0.8 < x.var() / var < 1.2
    assert [sharding.hypergeometric(rng, *a) for a in ((0, 5, 3), (5, 0, 3), (4, 4, 0))] == [0, 3, 0]


def test_shards_as_files(spark, tmp_path):
    path = sharding.write_shards(spark.range(500), 4, str(tmp_path / "s"), seed=5, rows_a_file=50)
    back = spark.read.parquet(path).collect()
    assert sorted(r.id for r in back) == list(range(500)) and Counter(r.shard for r in back) == {j: 125 for j in range(4)}
    one = spark.read.parquet(f"{path}/shard=0/file=1").collect()
    assert sorted(r.slot for r in one) == list(range(50, 100))


def test_op11_on_its_table(spark):
    got = queries.op11_sharding(spark, SF).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in queries.table(spark, SF, "documents").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs) and all((r["size"], r.text_crc32) == (len(docs[r.doc_id]) + 8, zlib.crc32(docs[r.doc_id])) for r in got)
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(24)) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == j) == list(range(n[j])) for j in n)


# --- phrase collocations ---


def collocations_plainly(rows, longest, least, top, cover):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        known = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = {q[i : i + k] for q, b in known.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= cover * known[q[i : i + k]]}
        best = []
        for p, a in known.items():
            if p not in held:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [None, 0, 40])
def test_phrases_equal_brute_force(spark, most):
    rng = random.Random(8)
    words = [*"abcdefgh", "É", "zß", "\x1c", "\x00n", "B"]
    line = lambda: " ".join(rng.choice(words[: rng.randrange(2, 14)]) for _ in range(rng.randrange(12)))
    rows = [(rng.choice([". ", "\n", "\t", " ; "]).join(line() for _ in range(rng.randrange(6))), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    rows += [("The same passage again, and Again", "en")] * 20 + [(None, "en"), ("", None), ("  \t.", "de"), ("x" * 100_000 + " y", "en"), ("long run " * 3000, "fr")]
    got = collocations.collocations(docs_of(spark, [(i if i % 5 else None, t, lang) for i, (t, lang) in enumerate(rows)]), 4, 5, 40, 80, most=most).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == collocations_plainly(rows, 4, 5, 40, 80)


def test_phrases_of_nothing_and_longer_ones(spark):
    assert collocations.collocations(docs_of(spark, []), least=1).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, "only one", "en"), (2, None, None)]), least=2).count() == 0
    rows = [("a b c d e a b c d e f", "en"), ("b c d e, a b c", "en")]
    got = collocations.collocations(docs_of(spark, [(1, *r) for r in rows]), 6, 2, 100, 60).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == collocations_plainly(rows, 6, 2, 100, 60)


# --- periodic runs ---


def runs_plainly(s, times=4, least=6):
    out = {}
    for q in range(1, len(s) // times + 1):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def some_words(rng):
    s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(50))]
    for _ in range(rng.randrange(4)):
        if s:
            a = rng.randrange(len(s))
            p = s[a : a + rng.randrange(1, 12)]
            s[a:a] = p * rng.randrange(1, 7) + p[: rng.randrange(len(p) + 1)]
        if s and rng.random() < 0.5:
            s += s[rng.randrange(len(s)) :][:60]
    return s


def test_runs_equal_brute_force():
    rng, found = random.Random(6), 0
    for _ in range(1500):
        s = some_words(rng)
        for times, least in ((2, 1), (3, 1), (4, 6)):
            assert [(a, b - a, p) for a, b, p in runs.runs_of(s, times, least)] == runs_plainly(s, times, least), s
        got = runs.all_runs([b"%d" % x for x in s])
        found += len(got)
        assert sorted(got) == runs_plainly(s), s
    assert found > 1000


def test_factors_are_the_longest_that_start_earlier():
    rng = random.Random(3)
    for _ in range(300):
        s, at = some_words(rng), 0
        for a, b, source in runs.factors(s):
            assert a == at and (s[source : source + b - a] == s[a:b] and source < a if source >= 0 else b == a + 1 and s[a] not in s[:a])
            longer = s[a : b + 1]
            assert b == len(s) or source < 0 or not any(s[i : i + len(longer)] == longer for i in range(a))
            at = b
        assert at == len(s)


def one_plainly(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(runs_plainly(words), key=lambda r: (r[0], r[2]))
    gone = {i for a, m, p in found for i in range(a + p, a + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{m},{p}\n" for a, m, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_op13_on_its_table_and_on_odd_rows(spark):
    docs = queries.table(spark, SF, "documents").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and sum(r[0] > 0 for r in got.values()) >= 10
    assert got == {r.doc_id: one_plainly(r.doc_id, r.text) for r in docs}
    rows = [(i, t, "en") for i, t in enumerate([None, "", " \n\t ", "a" * 90_000, "one", "go " * 4000, "a b\x0bc " * 30 + "a b d", "x\x1cy " * 6, "á b " * 5])]
    rows += [(None, "k k k k k k", "en"), (7, "p q " * 8, "de"), (7, "p q " * 8, "de"), *[(100 + i, "u v w x y z " * 9, None) for i in range(25)]]
    out = runs.periodic_runs(docs_of(spark, rows), plant=True).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str((i, *one_plainly(i, t))) for i, t, _ in rows)
    assert runs.periodic_runs(docs_of(spark, [])).count() == 0
    spans = runs.periodic_runs(docs_of(spark, [(1, "so a b a b a b a b end", "en")]), spans=True).first()
    assert [tuple(r) for r in spans.runs] == [(1, 8, 2)] and spans.collapsed == "so a b end"


def test_long_texts_take_time_in_proportion():
    words = [b"%d" % (i * i % 97) for i in range(60_000)]  # periodic all along
    assert runs.all_runs(words) == [(0, 60_000, 97)]


def test_sorting_before_numbering_stays_in_the_plan(spark):
    x = spark.range(1000).withColumn("k", F.xxhash64("id")).sortWithinPartitions("k").drop("k").withColumn("m", F.monotonically_increasing_id())
    assert "Sort" in x._jdf.queryExecution().executedPlan().toString()
