"""Report scores, rubrics and audits against a plain version, on all reports of the smallest tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import prose
from tessera.functions import text as X
from tessera.operators import audit, claims, records, reports

SF, YEAR = "/root/testdata/sf0.001", 2025
URL = r"(?i)https?://[^\s)\]}>\"'。，；：！？]+"


def clip(x):
    return min(1.0, max(0.0, x))


def n(text, what):
    return len(re.findall(reports.PATTERNS[f"count_{what}"], text))


def asked(prompt, what):
    return bool(re.search(reports.PATTERNS[f"asks_{what}"], prompt))


def url_of(u):
    u = u.strip().rstrip(".,;:!?，。；：！？")
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", u)
    return m[0].lower() + u[m.end() :] if m else u


def bad(urls):
    marks = ("example.com", "placeholder", "localhost", "127.0.0.1", "todo")
    low = [u.lower().rstrip(".,;:") for u in urls]
    return sum(any(m in u for m in marks) or u.endswith(("...", "%", "%e")) or not re.match(r"https?://[^/\s]+\.[^/\s]+", u) for u in low)


def plainly(r, provenance=True, hard=True, dims=None):
    text, prompt, cit = r.report or "", r.task_prompt or "", r.cit
    urls, low = re.findall(URL, text), text.lower()
    future = sum(int(y) > YEAR + 1 for y in re.findall(r"\b(20[2-9]\d|21\d{2})\b", text))
    section = n(text, "section") > 0
    images = r.expected_images
    named = 0
    for i, im in enumerate(images):
        stem = im.lower().rsplit(".", 1)[0]
        marks = [im.lower(), *[w + str(k) for w in ("image ", "figure ", "fig. ", "img ", "图", "图 ") for k in (i, i + 1)], *[w.format(i + 1) for w in ("图片{}", "图像{}", "第{}张")]]
        named += any(m in low for m in marks) or (len(stem) >= 3 and stem in low)
    out = {"visual": 0.55}
    if images:
        doubt = n(text, "visual_doubt")
        out["visual"] = clip(0.65 * named / len(images) + 0.25 * min(1, n(text, "visual") / max(4, 4 * len(images))) + 0.1 * (min(1, doubt / 3) if doubt else 0.25))
    cites = n(text, "citation")
    base = 0.3 if not urls and not cites and not section else 0.45 * (1 - min(1, bad(urls) / max(1, len(urls)))) + 0.35 * (min(1, cites / 8) if cites else 0.35) + 0.15 * section + min(0.15, 0.01 * n(text, "evidence"))
    legacy = clip(base - min(0.25, 0.05 * future) - min(0.25, 0.05 * n(text, "no_source")))
    mapped = cit["mapped_urls"]
    if not cit["count"]:
        al = 0.2 if mapped else 0.12
    elif not mapped:
        al = 0.08
    else:
        al = 0.05 + 0.4 * cit["integrity"] + 0.2 * cit["claim_coverage"] + 0.15 * (1 - min(1, bad(mapped) / len(mapped))) + 0.1 * min(1, len(mapped) / 6) + 0.1 * section - min(0.25, 0.25 * cit["orphan_ratio"])
    ev = clip(0.25 * legacy + 0.75 * clip(al))
    own = {url_of(u) for u in r.evidence_urls if u}
    if r.evidence_urls or r.evidence_titles:
        hosts = {re.sub(r"^www\.", "", re.match(r"https?://([^/?#]+)", u)[1]) for u in own}
        both = len(own & set(mapped))
        exact, host_hits, titles, precision, cover = len(own & {url_of(u) for u in urls}), sum(h in low for h in hosts), sum(len(t) >= 4 and t.lower() in low for t in r.evidence_titles), both / max(1, len(mapped)), min(1, both / min(6, len(own))) if own else 0
        if not provenance:
            exact = host_hits = titles = precision = cover = 0
        if own:
            old = 0.28 + 0.42 * min(1, host_hits / max(1, min(3, len(hosts)))) + 0.18 * min(1, exact / min(2, len(own))) + 0.07 * section + 0.05 * min(1, titles / 2)
        else:
            old = 0.42 + 0.3 * min(1, titles / 2) + 0.08 * section
        near = 0.5 if not own else 0.08 if not mapped else 0.05 + 0.3 * precision + 0.15 * cover + 0.2 * cit["integrity"] + 0.25 * cit["claim_coverage"] + 0.05 * section - min(0.25, 0.25 * cit["orphan_ratio"])
        if own and mapped:
            near = min(near, 0.2) if not cit["count"] else min(near, 0.3) if not cit["integrity"] else near
        ev = clip(0.55 * ev + 0.45 * clip(0.25 * clip(old) + 0.75 * clip(near)))
    out["evidence"] = ev
    heads, bullets, tables = n(text, "heading"), n(text, "bullet"), n(text, "table")
    t = 0.45 + min(0.2, 0.03 * heads) + min(0.12, 0.01 * bullets) + min(0.08, 0.02 * tables)
    t -= 0.12 * (asked(prompt, "markdown") and not heads) + 0.18 * (asked(prompt, "table") and not tables) + 0.12 * (asked(prompt, "list") and bullets < 2)
    if asked(prompt, "three"):
        t += 0.08 if n(text, "three") >= 3 else -0.1
    if asked(prompt, "two"):
        t += 0.06 if n(text, "hypothesis") >= 2 else -0.08
    t -= 0.18 * (asked(prompt, "short") and len(text) > 3500) + 0.1 * (asked(prompt, "chinese") and n(text, "chinese") < n(text, "latin"))
    out["task"] = clip(t)
    numbers = n(text, "number")
    out["quant"] = clip(0.3 + min(0.35, 0.015 * numbers) + min(0.2, 0.03 * n(text, "formula")) + 0.05 * (n(text, "no_number") > 0) if asked(prompt, "numbers") else 0.55 + min(0.12, 0.004 * numbers))
    p_n, p_dup, p_most, s_n, s_dup, s_most, g_dup, g_most = prose.repeats_of(text)
    penalty = max(0, min(0.6, 0.65 * p_dup + 0.15 * s_dup + 0.1 * min(p_most / 10, 1) + 0.06 * min(s_most / 25, 1) + 0.04 * min(2 * g_dup, 1)))
    blocks = len(re.split(r"\n\s*\n+", text.strip())) if text.strip() else 0
    out["quality"] = clip(0.38 + 0.3 * out["task"] + min(0.25, 0.035 * heads) + min(0.12, 0.004 * blocks) - 0.75 * penalty - min(0.2, 0.08 * n(text, "contradiction")) + min(0.05, 0.01 * n(text, "caveat")) - 0.12 * (len(text) > 220_000))
    tags = {tag for tag, p in reports.REASONS.items() if re.search(p, r.judge_reason or "")}
    body = text.strip()
    if len(body) < 100 or n(body, "crash"):
        tags.add("empty_or_crashed")
    if p_dup > 0.25 or p_most > 5 or (s_dup > 0.35 and s_most > 10) or (s_dup > 0.18 and s_most > 30) or (g_dup > 0.2 and g_most > 20):
        tags.add("repetition_collapse")
    fake = (urls and bad(urls) >= max(2, -(-len(urls) // 2))) or future >= 3 or (cit["count"] >= 4 and not urls and not cit["mapping_count"]) or (cit["count"] >= 40 and cit["mapping_count"] >= 6 and cit["integrity"] < 0.2)
    fake = fake or (cit["count"] >= 80 and cit["claim_coverage"] < 0.08) or (cit["mapping_count"] >= 8 and cit["orphan_ratio"] >= 0.6)
    if provenance and (r.evidence_urls or r.evidence_titles):
        fake = fake or (len(mapped) >= 4 and len(own & set(mapped)) / len(mapped) < 0.25)
    if fake:
        tags.add("fabricated_source_data")
    if (asked(prompt, "200") and len(body) > 1200) or (asked(prompt, "real_table") and not tables):
        tags.add("format_instruction_fail")
    if dims is not None:
        of = {"visual": "MM", "evidence": "EVI", "task": "GEN", "quant": "VEF", "quality": "PRES"}
        out = {k: 0.7 * v + 0.3 * dims.get(of[k], 0.0) for k, v in out.items()}
    raw = sum(out[k] * w for k, w in (("visual", 0.33), ("evidence", 0.27), ("task", 0.16), ("quant", 0.13), ("quality", 0.11)))
    raw -= (min(0.2, 0.05 * r.tool_errors) + penalty) * hard
    cap = min([{"empty_or_crashed": 0.05, "fabricated_source_data": 0.2, "repetition_collapse": 0.25, "format_instruction_fail": 0.35}[x] for x in tags], default=1.0) if hard else 1.0
    return out | {"penalty": penalty, "raw_reward": raw, "reward_cap": cap, "final_reward": min(clip(raw), cap)}, sorted(tags)


ODD = [
    (10**9, "", "", [], [], [], 3, "", ""),
    (10**9 + 1, None, None, ["a.png"], ["HTTP://A.b/c."], ["Some title"], 0, None, None),
    (10**9 + 2, "# Sources\n1. one\n2. two\n3. three\nimage 1 may be uncertain, hypothesis or candidate. Some Title says 12 km = 5 % [1][a].\n|a|b|\n[1]: http://www.a.b/c\n" + "more words here. " * 20, "Rank 3 types in a table, two possible, list 不超过 20 字", ["x/long_name.png", "b.jpg"], ["http://www.a.b/c", "http://d.e/f"], ["some title", "abc"], 1, "copy-paste, misleading", "src3"),
    (10**9 + 3, "x " * 60 + "in 2099, 2098 and 2097, placeholder http://example.com/a http://localhost/b", "分析 markdown", [], [], ["only a title"], 0, "excellent", None),
]


@pytest.fixture(scope="module")
def scored(spark):
    x = queries.reports_of(spark, SF)
    cols = ["doc_id", "report", "task_prompt", "expected_images", "evidence_urls", "evidence_titles", "tool_errors", "judge_reason", "rubric_id"]
    x = x.withColumn("rubric_id", F.when(F.col("lang") == "en", F.col("source"))).select(*cols)
    odd = spark.createDataFrame(ODD, "doc_id long, report string, task_prompt string, expected_images array<string>, evidence_urls array<string>, evidence_titles array<string>, tool_errors int, judge_reason string, rubric_id string")
    x = x.withColumn("tool_errors", F.col("tool_errors").cast("int")).union(odd).cache()
    return x, {r.doc_id: r for r in reports.citations(x).collect()}


def same(got, want, tags):
    assert got["gates"] == tags, got["doc_id"]
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-9, (got["doc_id"], k, got[k], v)


@pytest.mark.parametrize("how", [{}, {"provenance": False}, {"hard_gates": False}])
def test_scores_of_all_reports(scored, how):
    x, rows = scored
    out = reports.score_reports(x, YEAR, **how).collect()
    assert len(out) == len(rows) == 204
    for g in out:
        same(g, *plainly(rows[g.doc_id], how.get("provenance", True), how.get("hard_gates", True)))
    if not how:
        assert {t for g in out for t in g.gates} == set(reports.CAPS)


def tokens(text):
    low = text.lower()
    return set(re.findall(r"[a-z][a-z0-9_-]{2,}|\d+(?:\.\d+)?%?", low)) | {r[i : i + 2] for r in re.findall("[一-鿿]{2,}", low) for i in range(len(r) - 1)}


def covered(text, wanted):
    need, have = tokens(wanted), tokens(text)
    numbers = {t for t in need if re.fullmatch(r"\d+(?:\.\d+)?%?", t)}
    share = min(1, len(need & have) / (0.55 * len(need))) if need else 0.0
    return share * (0.55 + 0.45 * len(numbers & have) / len(numbers)) if numbers else share


def test_rubrics_and_their_mix(spark, scored):
    x, rows = scored
    bench = [r.text for r in queries.table(spark, SF, "benchmark").collect()]
    weights = [None, 2.0, float("nan"), -1.0, float("inf")]
    crit = [(f"src{i % 20}", reports.DIMENSIONS[(i // 20 + i) % 5], weights[(i // 20 + i) % 5], t + (" 2 1" if i % 3 == 0 else ""), "content" if i % 2 else "claim_with_citation") for i, t in enumerate(bench * 3)]
    criteria = spark.createDataFrame(crit, "rubric_id string, dim string, weight double, criterion string, evaluation string")
    cited = x.where("rubric_id is not null")
    dims, agg = {}, {}
    for r in rows.values():
        if r.rubric_id is None:
            continue
        body = "\n".join(ln for ln in r.report.split("\n") if not re.match(r"\s*(?:[-*+]\s*)?\[\d+\]\s*(?::|\s).*https?://", ln))
        told = "\n".join(s for s in re.split(r"(?<=[.!?。！？])\s*(?!\[\d+\])|\n+", body) if set(re.findall(r"\[(\d+)\]", s)) & set(r.cit["resolved_ids"]))
        by = {}
        for rid, dim, w, c, how in crit:
            if rid == r.rubric_id:
                s = covered(r.report, c)
                by.setdefault(dim, []).append((0.2 * s + 0.8 * covered(told, c) if how == "claim_with_citation" else s, w))
        dims[r.doc_id] = {d: sum(s for s, _ in v) / len(v) for d, v in by.items()}
        ws = {d: max(1.0 if w is None else 0.0 if w != w or abs(w) == float("inf") else max(0.0, w) for _, w in v) for d, v in by.items()}
        agg[r.doc_id] = sum(ws[d] * dims[r.doc_id][d] for d in ws) / sum(ws.values()) if sum(ws.values()) else 0.0
    got = {r.doc_id: r.rubric for r in reports.rubric_scores(reports.citations(cited), criteria).collect()}
    assert len(got) > 50 and all(abs(got[i] - agg[i]) < 1e-9 for i in got)
    for g in reports.score_reports(x, YEAR, criteria=criteria).collect():
        same(g, *plainly(rows[g.doc_id], dims=dims.get(g.doc_id)))


def test_claims_move_the_evidence_score(spark, scored):
    x, _ = scored
    some = x.where("doc_id < 3 or doc_id >= 1000000000")
    facts = [(10**9 + 2, "http://www.a.b/c", "Some Title says 12 km = 5 % .", True, None)]
    ev = spark.createDataFrame(facts, "doc_id long, url string, text string, complete boolean, facts array<struct<subject: string, field: string, value: string, exclusive: boolean>>")
    before = {r.doc_id: r.evidence for r in reports.score_reports(some, YEAR).collect()}
    after = {r.doc_id: r.evidence for r in reports.score_reports(some, YEAR, claim_evidence=ev).collect()}
    moved = {r.doc_id: r.combined for r in claims.combined_evidence(some.select("doc_id", "report", F.lit(0.4).alias("base")), ev).collect()}
    assert set(after) == set(before) and all(abs(after[i] - before[i]) < 1e-12 for i in before if abs(moved[i] - 0.4) < 1e-12)


def test_audit_summary(spark):
    x = spark.createDataFrame([(1, 0.5, ["a"], 0.2), (2, 0.25, [], 1.0), (3, 0.9, ["a", "b"], 0.05)], "doc_id int, final_reward double, gates array<string>, reward_cap double")
    assert tuple(audit.summary(x).first()) == (3, 0.55, 0.25, 0.9, 0.666667, 0.666667)
    assert [tuple(r) for r in audit.frequencies(x).collect()] == [("a", 2), ("b", 1)]
    assert tuple(audit.summary(x.limit(0)).first())[0] == 0


def test_report_structure_by_hand(spark):
    text = "# Tea\n## Table of Contents\n## 1. Leaves\n### 1.1 Green\n### Extra\n### Extra\n### Extra\n```\n## Not one\n```\n## Water\n### Hot\n### Cold\n### Ice\n## Reference\n"
    r = spark.createDataFrame([(1, text, "Tea", "", 2), (2, None, None, None, 0), (3, "# Tea\n## Table of Contents\n", "Tea", "", 0)], "doc_id int, report string, title string, query string, references int")
    o = spark.createDataFrame([(1, 1, "1. Leaves", ["1.1 Green"]), (1, 2, "Water", ["Hot", "Cold"]), (2, 1, None, None)], "doc_id int, sec int, title string, subsections array<string>")
    got = {x.doc_id: tuple(x)[1:] for x in reports.structure_issues(r, o).collect()}
    assert got[1] == (True, 12, 8, 4, ["extra x3"], ["leaves", "water"])  # Ice is unexpected, so Water is a problem too
    assert got[2] == (False, 0, 3, 0, [], []) and got[3] == (False, 2, 2, 0, [], [])


def test_few_rows_are_read_by_many_tasks(spark):
    r = spark.range(40).selectExpr("id AS doc_id", "concat('Report ', id, '. Uncertain image, see Figure 1 and the ratio. [1]') AS report")
    parts = reports.citations(r.join(r.select("doc_id"), "doc_id")).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 2 * spark.sparkContext.defaultParallelism
    for p in (p for k, p in reports.PATTERNS.items() if k.startswith("count_")):
        t = spark.createDataFrame([("Image FIGURE fig. x visible Chart 图像 uncertain = Percent per  CENT Ratio hypothesis 假设 no source exception " + k,) for k in ("", "İmage ſource", "LEGEND\nUnit")], "t string")
        assert t.where(X.count(F.col("t"), p) != F.regexp_count("t", F.lit(p))).count() == 0


def test_whether_a_source_is_known_is_asked_for_each_list_of_citations(spark):
    cl = spark.createDataFrame([(1, "p", "size", "3", ["nobody"], True), (1, "p", "size", "3", ["b"], True)], "claim_id long, subject string, field string, value string, cited array<string>, polarity boolean")
    facts = spark.createDataFrame([("b", "q", "size", "3", False)], "source string, subject string, field string, value string, exclusive boolean")
    assert sorted(r.outcome for r in records.claim_outcomes(cl, facts).collect()) == ["insufficient_evidence", "source_not_indexed"]


def test_rubrics_find_a_reports_tokens_once(spark):
    """F4 of round 4: tokens are made before reports meet criteria, not for each pair."""
    r = spark.createDataFrame([(1, "a", "red fox 12 [1] runs", ["1"])], "doc_id long, rubric_id string, report string, ids array<string>").withColumn("cit", F.struct(F.col("ids").alias("resolved_ids")))
    crit = spark.createDataFrame([("a", "GEN", 1.0, "red fox 12", "content"), ("a", "EVI", 1.0, "blue fox 13", "claim_with_citation"), ("a", "GEN", 1.0, None, "content")], "rubric_id string, dim string, weight double, criterion string, evaluation string")
    got = reports.rubric_dimensions(r, crit)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan[: plan.index("Join")]
    assert {x.dim: round(x.s, 6) for x in got.collect()} == {"GEN": 0.5, "EVI": round(1 / (0.55 * 3) * 0.55, 6)}


def test_words_are_counted_in_one_pass(spark):
    """F2 and F3 of round 4: the counts are those of the patterns."""
    rng = random.Random(3)
    bits = [w for k in reports.WORDS for w in reports.WORDS[k].replace("\\", "").split("|")] + ["per  cent", "per\x0bcent", "K", "İ", "ſ", " ", "\n", "E", "Sourc", "图"]
    df = spark.createDataFrame([("".join(rng.choice([str, str.upper, str.title])(rng.choice(bits)) for _ in range(rng.randrange(40))),) for _ in range(300)] + [(None,)], "report string")
    want = F.struct(*[X.count(F.col("report"), reports.PATTERNS[f"count_{k}"]).alias(k) for k in reports.WORDS])
    assert all(x.n == x.m for x in df.select(reports.word_counts(F.col("report")).alias("n"), want.alias("m")).collect())


def test_marked_text_is_lexed_by_lines():
    rng = random.Random(4)
    bits = ["[3]", "[iv, 2]", "[", "]", "](http://a.b/c)", "](x)", "!", "<b>", "<", "1.", "a)", " ", "\n", "\r", "#", "> ", "- ", "word", "foo 12", "http://x.y/[3]", "://", "中文", "`", "[ 3\n]"]
    for _ in range(5000):
        x = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        assert prose._lexed(x) == (prose._marked(x) if prose._PLAIN(x) else prose._WORD.findall(x)), x
