"""Operators against brute force, and on rows that are null, empty, long, tied or repeated."""

import base64
import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, common, jaccard, license, linededup, mixing, neardup, toxicity, urlfilter, warc  # noqa: A004

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, rank int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in texts], DOCS)


def text(rng, n, words=40):
    return " ".join(f"w{rng.integers(0, words)}" for _ in range(n))


# --- shared pieces ---


def test_components_and_hot_keys(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (77, 77), (None, 3)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.id: r.comp for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[150] == got[200] == got[100] == 100 and all(got[1000 + i] == 1000 for i in range(300)) and 77 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    left = spark.range(6000).select(F.col("id"), F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("low"))
    out = common.attach(left, right, ["k"], "c", F.col("id"))
    assert out.count() == 6000 and out.where("k = 1 and low <> 0").count() == 0 and out.where("k <> 1 and low <> id").count() == 0


# --- n-gram Jaccard ---


def components_by_hand(sets, num, den):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def shingles(t, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_against_all_pairs(spark, k, num, den):
    rng = np.random.default_rng(k)
    texts, i = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "x"), (6, "é É"), (7, "é é")], 10
    for n in (8, 12, 30, 60, 200):
        base = text(rng, n, 500).split()
        for _ in range(14):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, n // 25)))):
                w[int(rng.integers(0, n))] = f"z{rng.integers(0, 9)}"
            texts.append((i, " ".join(w)))
            i += 1
        texts += [(i, " ".join(base)), (i + 1, " ".join(base).upper().lower()), (i + 2, "shared passage of words " + text(rng, n, 500))]
        i += 3
    got = {r.doc_id: r for r in jaccard.jaccard_components(docs_of(spark, texts), k, num, den).collect()}
    sets = {i: shingles(t, k) for i, t in texts}
    want = components_by_hand(sets, num, den)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(want)
    kept = jaccard.keep_one(docs_of(spark, texts), k, num, den)
    assert kept.columns == docs_of(spark, texts[:1]).columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_jaccard_edges(spark):
    d = docs_of(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "q"), (4, "long " + " ".join(f"w{i}" for i in range(60_000)))])
    got = jaccard.jaccard_components(d).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (1, 1), (1, 1), (2, 2), (4, 4)]
    assert {r.n_shingles for r in got if r.doc_id == 4} == {59_999}
    assert jaccard.jaccard_components(d.limit(0)).count() == 0


def test_jaccard_one_id_with_several_texts(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(5, x), (5, y), (7, y + " more"), (9, x), (2, z), (2, x + " more"), (8, z)]
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, rows), 3, 90, 100).collect()}
    assert got == {(i, 2) for i in (2, 5, 7, 8, 9)}


def test_jaccard_one_shingle_in_a_third_of_the_documents(spark):
    """A shingle in very many sets, blocks of few rows: the same components as all pairs give."""
    rng = np.random.default_rng(12)
    rows = [(i, ("common passage of words " if i % 3 == 0 else "") + text(rng, int(rng.integers(2, 6)), 9)) for i in range(240)]
    old, jaccard.BLOCK = jaccard.BLOCK, 8
    try:
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(spark, rows), 3, 50, 100).collect()}
    finally:
        jaccard.BLOCK = old
    assert got == components_by_hand({i: shingles(t, 3) for i, t in rows}, 50, 100)


# --- vectors ---


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, rank string")


ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0])]


def test_ann_is_whole(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((400, 16)).astype("f4")
    m[50:60] = m[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    got = ann.search(vectors(spark, rows + ODD + rows[:3]), F.col("id") % 20 == 0, 20, stripe=7).toPandas()
    x = m.astype("f8")
    assert sorted(got.query_id.unique()) == list(range(0, 400, 20))
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:20]
        assert list(g.sort_values("rank").vec_id) == list(want)
        assert np.allclose(g.sort_values("rank").score, s[want], rtol=0, atol=1e-12)
    few = ann.search(vectors(spark, rows[:3]), F.col("id") % 20 == 0, 20)
    assert [(r.query_id, r["rank"]) for r in few.orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert ann.search(vectors(spark, rows[:1]).limit(0), F.col("id") % 20 == 0).count() == 0


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    at = ann.hilbert(side, 3)
    assert sorted(at) == list(range(512))
    walk = side[np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    m = list(rng.standard_normal((150, 16)))
    for k in range(12):
        m += [m[k] + rng.standard_normal(16) * 0.12 for _ in range(4)]
    m += [m[0] * (1 + i) for i in range(120)]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(m)]
    df = vectors(spark, rows + ODD + [rows[5]])
    found = neardup.near_duplicates(df, window=8)
    got = {r.vec_id: r for r in found.collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = components_by_links(near)
    assert [got[i].n_links for i in range(len(m))] == list(near.sum(axis=1))
    assert [got[i].component_id for i in range(len(m))] == want and all(got[i].kept == (want[i] == i) for i in range(len(m)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, _ in ODD) and found.count() == len(rows) + len(ODD) + 1
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_where_vectors_crowd(spark):
    """Links in a cone of like directions, which windows miss, are found all the same."""
    rng = np.random.default_rng(4)
    m = rng.standard_normal((900, 32))
    m[:600] = 3 * m[0] / np.linalg.norm(m[0]) + m[:600] / np.sqrt(32)
    m = np.concatenate([m, m[:60] + rng.standard_normal((60, 32)) * np.linalg.norm(m[:60], axis=1)[:, None] * 0.02])
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(m)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    want = components_by_links(near)
    df = vectors(spark, rows)
    vecs = neardup.usable(df)
    windows = {r.id: r.comp for r in common.components(neardup.candidate_links(vecs, 0.98, 2, 4).select("a", "b")).collect()}
    assert [windows.get(i, i) for i in range(len(m))] != want  # or this tests nothing
    got = {r.vec_id: r for r in neardup.near_duplicates(df, 0.98, passes=2, window=4).collect()}
    assert [got[i].component_id for i in range(len(m))] == want
    assert [got[i].n_links for i in range(len(m))] == list(near.sum(axis=1))


def test_compact_blocks_hold_every_row_once():
    m = np.random.default_rng(5).standard_normal((1000, 8))
    m[:300] = m[0]
    got = neardup.compact_blocks(m, 64)
    assert max(map(len, got)) <= 64 and sorted(np.concatenate(got)) == list(range(1000))


def components_by_links(near):
    up = list(range(len(near)))
    for _ in range(len(near)):
        new = [min([up[i], *(up[j] for j in np.flatnonzero(near[i]))]) for i in range(len(near))]
        if new == up:
            break
        up = new
    return up


# --- URL filter ---


def test_url_filter_by_hand(spark):
    urls = ["https://WWW.Example.com/en/x?q#f", "http://a.example.com/en/", "http://example.com/fr", "http://notexample.com/en/", "x.net/es/", None, "ftp://b.net/fr/z", "http://net/es/", "http://spam-farm.example.org/x", "http://ok.org/spam-farm.x/", "http://h.org/adserver/1", "http://n.net/ES/", "", "http://?x", "http://u.org/é utm_source=spamx"]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("com/", "allow"), (None, "allow"), (None, "allow"), ("net/fr/", "block"), ("net/es/", "block"), (None, "block"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block")]
    assert (got[0].host, got[0].path) == ("www.example.com", "/en/x") and (got[4].host, got[4].path, got[5].host) == ("", "", "") and (got[13].host, got[13].path) == ("", "")
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_filter_edges(spark):
    urls = [(1, "http://evil.org/a.com\n/x", 1), (2, "http://a.com\n/x", 1), (None, "http://a.net/es/1", 1), (3, "http://b.org/" + "x" * 200_000, 1), (3, "http://b.org/" + "x" * 200_000, 1), (4, "http://sub.net\n.org/fr/", 1)]
    got = urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string, rule int"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"]
    assert sorted((r.page_id or 0, r.rule or "") for r in got.collect()) == [(0, "net/es/"), (1, ""), (2, ""), (3, ""), (3, ""), (4, "")]


def test_url_rules_found_by_index_are_those_found_by_trying_all():
    rules = [urlfilter.pattern_rule(v, t) for v, t in urlfilter.PATTERNS] + [urlfilter.fixed_rule(v, t) for v, t in urlfilter.FIXED]
    rng = np.random.default_rng(4)
    parts = ["http://", "spam-farm.", "casino.", "example.com", "net", "/", "/adserver/", "?utm_source=spam", "/wp-login.php", "/es/", "/en/", "a", "x."]
    for _ in range(3000):
        url = "".join(rng.choice(parts) for _ in range(int(rng.integers(1, 7))))
        low = url.lower()
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        have = set(re.findall(urlfilter.TOKEN, low))
        for r in rules:
            if r.fixed and re.match(r.regex, host, re.S) and re.match(r.path, path, re.S) or not r.fixed and re.search(r.regex, low, re.S):
                assert set(r.literals) <= have, (url, r)


# --- toxicity ---


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(5)
    bad = ["blarg", "gronk", "snarf"]
    texts, labels = [], []
    for i in range(900):
        w = text(rng, 60, 300).split()
        toxic = i % 6 == 0
        if toxic:
            for b in rng.choice(bad, 3):
                w[int(rng.integers(0, 60))] = f"{b.title()},"
        texts.append((i, " ".join(w)))
        if i < 600:
            labels.append((i, int(rng.integers(0, 2)), int(toxic)))
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, texts + [(2000, None), (2001, ""), (2002, "..."), (2003, "gronk " * 3000), (None, "blarg gronk"), (0, texts[0][1])])
    model = toxicity.train(df, lab)
    assert (np.diff(model.t) >= 0).all() and (model.w >= toxicity.LEAST).all()
    got = toxicity.score(df, model)
    by = {r.doc_id: r for r in got.collect()}
    held = range(600, 900)
    assert sum(by[i].rejected == (i % 6 == 0) for i in held) >= 297
    assert not by[2000].rejected and by[2001].expected_severity == 0 and by[2002].grade == 0 and 0 <= by[600].expected_severity <= 2
    kept = toxicity.reject_toxic(df, lab)
    assert kept.columns == df.columns and kept.where("doc_id = 2000").count() == 1
    assert toxicity.train(df, lab.where("toxic = 0")) is None and toxicity.score(df, None).where("rejected").count() == 0
    assert toxicity.score(df.limit(0), model).count() == 0


# --- line dedup ---


def lines_by_hand(rows, least):
    seen, gone = {}, {}
    for i, t in sorted(set(rows)):
        lines = [(k, x.strip(" \t\n\v\f\r")) for k, x in enumerate((t or "").split("\n"))]
        lines = [(k, x) for k, x in lines if x]
        k = 1
        while k <= len(lines):
            for s in range(len(lines) - k + 1):
                part = lines[s : s + k]
                if sum(len(WORD.findall(x)) for _, x in part) >= least:
                    seen.setdefault(tuple(x for _, x in part), []).append((i, part[0][0], [a for a, _ in part]))
            k += 1
    for places in seen.values():
        for p in places:
            if p != min(places):
                gone.setdefault(p[0], set()).update(p[2])
    return {i: sorted(g) for i, g in gone.items()}


def test_line_runs_against_all_runs(spark):
    rng = np.random.default_rng(6)
    pool = [text(rng, int(rng.integers(1, 9)), 60) for _ in range(40)] + ["", " ", "Les.", "é ü ñ"]
    rows = [(i, "\n".join(rng.choice(pool, int(rng.integers(1, 14))))) for i in range(70)] + [(100, None), (101, ""), (102, "a\nb\nc\nd\ne\nf"), (103, "a\nb\nc\nd\ne\nf\r\n"), (104, "one two three four five\n" * 3)]
    df = docs_of(spark, rows)
    got = {r.doc_id: r for r in linededup.dedup_lines(df, 5).collect()}
    want = lines_by_hand([(i, t) for i, t in rows if t], 5)
    assert {i: list(r.removed_lines) for i, r in got.items() if r.removed_lines} == want
    for i, t in rows:
        assert got[i].text == (t if i not in want else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]))
    kept = linededup.drop_lines(df, 5)
    assert kept.columns == df.columns and {100, 101, 102} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id = 103").count() == 0
    twice = linededup.dedup_lines(docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")]), 5)
    assert sorted((r.doc_id or 9, r.text) for r in twice.collect()) == [(1, "a b c d e f"), (1, "a b c d e f"), (9, "")]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


# --- WARC ---


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é x", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u\r\nX: y", "<p>é</p>"), (5, "u", "WARC/1.1\r\n\r\n"), (4, "u", "<p>é</p>"), (None, "n", "lone"), (6, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, best string")
    path = str(tmp_path / "w")
    manifest = warc.write_warc(df, path, roll_bytes=200)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    names = sorted(p.name for p in (tmp_path / "w").glob("*.warc.gz"))
    assert names == sorted(r.file for r in manifest.collect()) and not list((tmp_path / "w").glob(".tmp*"))
    got = warc.read_warc(spark, path).collect()
    data = {r[0]: (r[2] or "").encode() for r in rows}
    assert sorted((r.page_id or 0) for r in got) == sorted((r[0] or 0) for r in rows)
    for r in got:
        d = data[r.page_id]
        assert r.payload_bytes == len(d) and r.payload_digest == base64.b32encode(hashlib.sha1(d).digest()).decode()
        assert (bytes(r.payload) == d) if r.record_type == "response" else r.payload is None
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([(0, "response", None), (1, "revisit", 4), (2, "revisit", 3), (3, "response", None), (4, "response", None), (4, "revisit", 4), (5, "response", None), (6, "response", None)], key=lambda x: (x[0], x[1], x[2] or 0))
    again = str(tmp_path / "v")
    warc.write_warc(df.repartition(3, "url"), again, roll_bytes=200)
    assert [p.read_bytes() for p in sorted((tmp_path / "w").glob("*.warc.gz"))] == [p.read_bytes() for p in sorted((tmp_path / "v").glob("*.warc.gz"))]
    assert warc.archive(df.limit(0), str(tmp_path / "e")).count() == 0
    import sys

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from warc_check import members

    assert sum(members(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz")) == len(rows)


# --- mixing ---


def test_mixing_rakes_until_weights_rest(spark):
    """A source with a third of all tokens: shares come as near their targets as probabilities of at most 1 allow."""
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", (3000 if i == 0 else 100) * (j + 1) * (1 + (i + k) % 3), 1) for i in range(8) for j in range(3) for k in range(3)], "source string, lang string, topic string, tokens long, docs long")
    raked = mixing.rake(cells, flatten=0.7, keep=0.8)
    got = raked.toPandas()
    w = got.tokens / got.tokens.sum()
    most = min((w.groupby(got[d]).sum() / got.groupby(d)[f"t_{d}"].first()).min() for d in mixing.DIMS)
    cap = w / min(0.8, mixing.FULL * most)
    for _ in range(3000):
        for d in mixing.DIMS:
            w = w * got[f"t_{d}"] / w.groupby(got[d]).transform("sum")
        w = np.minimum(w, cap)
    assert (abs(got.w / w - 1) < 0.02).all()
    left = mixing.unmet(raked).toPandas()
    assert len(left) == 14 and left.groupby("dimension").share.sum().round(9).eq(1).all()


def test_mixing_meets_its_targets_by_default(spark):
    """With default settings every share is within 1 % of its target; a source whose tokens can't bear its share is told."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    raked = mixing.rake(mixing.cells_of(mixing.tokens_of(docs)))
    assert mixing.worst(raked) < 0.01
    got = mixing.mix(docs, strict=0.01)
    kept = got.where("kept").agg(F.sum("n_tokens")).first()[0] / got.agg(F.sum("n_tokens")).first()[0]
    most = raked.agg(F.max(F.col("w") / F.col("cap"))).first()[0]
    assert most <= 1 + 1e-9 and abs(kept - 0.8) < 0.02
    apart = spark.createDataFrame([(i, "a b c " * (50 if i else 1), "en" if i else "de", f"s{min(i, 1)}", 0, "x", 1) for i in range(20)], DOCS)
    targets = spark.createDataFrame([("lang", "de", 0.9), ("source", "s0", 0.1)], "dimension string, value string, share double")
    with pytest.raises(ValueError, match="off"):
        mixing.mix(apart, targets=targets, strict=0.01)


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(7)
    rows = [(i, text(rng, int(rng.integers(5, 40))), "en" if i % 3 else "de", f"s{i % 4}", 0, "x", 1) for i in range(2000)]
    df = spark.createDataFrame([*rows, rows[0], rows[0], (None, None, None, None, None, None, None), (3000, "", "en", None, 0, "x", 1)], DOCS)
    targets = spark.createDataFrame([("lang", "en", 0.5), ("lang", "de", 0.5)], "dimension string, value string, share double")
    got = mixing.mix(df, rounds=12, keep=0.5, targets=targets).toPandas()
    full = got[got.n_tokens > 0]
    share = (full.n_tokens * full.probability).groupby(full.lang).sum()
    assert abs(share["en"] / share.sum() - 0.5) < 0.01 and abs(share.sum() / full.n_tokens.sum() - 0.5) < 0.01
    assert abs(full.kept.mean() - full.probability.mean()) < 0.05 and got[got.n_tokens == 0].kept.all() and (got.probability <= 1).all()
    assert mixing.sample(df).columns == df.columns and mixing.mix(df.limit(0)).count() == 0


# --- licences ---


def test_license_held_out(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "\n".join(text(rng, 20, 400) for _ in range(3))) for i in range(120)]
    notices = {200: ("MIT", "This library is released under the MIT license."), 201: ("Apache-2.0", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!"), 202: ("GPL", "It is licensed under the GNU General Public License, version 3."), 203: ("CC-BY-NC", "Licensed under CC BY-NC 4.0.")}
    rows += [(i, f"{text(rng, 10)}\n{t}\nMore words.") for i, (_, t) in notices.items()]
    rows += [(300, None), (301, ""), (302, "The license of a driver, and the version of a story."), (None, "All rights reserved."), (200, "again\n" + notices[200][1])]
    df = docs_of(spark, rows)
    got = license.scan(df, license.train(df)).collect()
    assert sorted((r.doc_id or -1, r.family) for r in got) == sorted([(-1, "Proprietary"), (200, "MIT"), (200, "MIT"), *((i, f) for i, (f, _) in notices.items() if i != 200)])
    assert all(r.line == 1 for r in got if r.doc_id) and all(r.agreement >= 0.6 and r.probability >= 0.5 for r in got)
    assert license.scan(df.limit(0), license.train(df.limit(0))).count() == 0


def test_license_paragraphs():
    """Lines first, then paragraphs of several lines, with the places that splitting at line breaks gives."""
    import pyarrow as pa

    t = ["\none two\nthree\n\n  \nfour", None, "five\n--\nsix\nseven", ""]
    par, f, doc, first, last, words = license.paragraphs_of(pa.array(t))
    assert list(zip(doc.tolist(), first.tolist(), last.tolist(), words.tolist(), strict=True)) == [(0, 1, 1, 2), (0, 2, 2, 1), (0, 5, 5, 1), (2, 0, 0, 1), (2, 2, 2, 1), (2, 3, 3, 1), (0, 1, 2, 3), (2, 2, 3, 2)]
    assert np.bincount(par).tolist() == [2 * w - 1 for w in words]


def test_license_wrapped_notice_is_one_finding(spark):
    long = next(t for ts in license.TEMPLATES.values() for t in ts if t.startswith("To the extent"))
    w = long.split()
    notice = "\n".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5))
    rng = np.random.default_rng(3)
    rows = [(i, "\n".join(text(rng, 20, 400) for _ in range(3))) for i in range(60)] + [(100, f"{text(rng, 9)}\n\n{notice}\n\n{text(rng, 9)}"), (101, f"{text(rng, 30_000)}\n\n{notice}"), (102, " ".join(w[:4]))]
    got = license.scan(docs_of(spark, rows), license.train(docs_of(spark, rows))).collect()
    assert sorted((r.doc_id, r.line, r.paragraph) for r in got) == [(100, 2, notice), (101, 2, notice)]


# --- what executors need ---


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Workers that can't import the package run the operators that broadcast objects."""
    import os
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from tessera.llm import queries as q
for name in ("op4_url_filter", "op6_toxicity", "op10_license"):
    print(name, q.QUERIES[name](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0 and out.stdout.count("op") >= 3, out.stderr[-2000:]


def test_clashing_names(spark):
    """Working columns don't meet those of the input."""
    rows = [(i, f"some words of text number {i % 3}\nand a line that repeats itself", "en", "s", 7, 0.5, "mine", [1], 3, True) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, p double, topic string, removed_lines array<int>, grade int, kept boolean")
    assert mixing.sample(df).columns == df.columns and {r.topic for r in mixing.sample(df).collect()} == {"mine"}
    assert {r.p for r in mixing.mix(df).collect()} == {0.5} and mixing.mix(df).columns.count("topic") == 1
    out = linededup.dedup_lines(df)
    assert out.columns.count("removed_lines") == 1 and linededup.drop_lines(df).columns == df.columns
    assert {tuple(r.removed_lines) for r in linededup.drop_lines(df).collect()} == {(1,)}
    assert toxicity.score(df, None).columns.count("grade") == 1 and {r.grade for r in toxicity.reject_toxic(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()} == {3}


# --- the pipeline ---


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    for k, (_, stage) in enumerate(p.STAGES):
        out = common.written(stage(spark, docs, SF), "t")
        if k < 4:
            assert out.columns == docs.columns
        now = {r.doc_id: r for r in out.collect()}
        assert set(now) <= set(kept)
        if k == 1:
            gone = lines_by_hand([(i, r.text) for i, r in kept.items()], 5)
            want = {i: "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone.get(i, ())) for i, r in kept.items()}
            assert {i: r.text for i, r in now.items()} == {i: t for i, t in want.items() if i not in gone or WORD.search(t)}
        if k == 2:
            want = components_by_hand({i: shingles(r.text, 5) for i, r in kept.items()}, 80, 100)
            assert set(now) == {i for i in want if want[i] == i}
        if k == 4:
            assert {i: r.text for i, r in now.items()} == {i: r.text for i, r in kept.items()}
        docs, kept = out, now
    assert {r.doc_id for r in p.run(spark, SF).collect()} == set(kept)
