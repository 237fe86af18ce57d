"""Hand-derived cases, and properties."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import prose, pyfuncs
from tessera.functions import text as X
from tessera.operators import evidence, mix, reports, traces
from tessera.plans import dag
from tessera.sources import readers, sinks
from tessera.streaming import events


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (X.normal_url, "HTTPS://Ex.COM/Path?Q=1.", "https://ex.com/Path?Q=1"),
        (X.url_host, "https://www.Ex.com/a", "ex.com"),
        (X.urls, "see https://a.b/c) and http://d.e。", ["https://a.b/c", "http://d.e"]),
        (X.tokens, "The 3.5% rise 中国人 ok", ["the", "3.5%", "rise", "中国", "国人"]),
        (prose.normal_text, "## **Hi** [1], see https://x.y/z ok", "hi see <url> ok"),
        (X.value_key, "2024年3月5日", "date:2024-3-5"),
        (X.value_key, "1,200.50 KG", "number:1200.5:kg"),
        (X.value_key, " Some  Text", "text:some text"),
        (X.spoken_language, "long English text、", "zh"),
        (X.spoken_language, "é 1", "zh"),
        (X.main_language, "这是一个测试 ok", "zh"),
        (X.main_language, "这是 okay", "en"),
        (X.main_language, "这ok是", "zh"),
        (X.task_id, "task_17/report.md", "17"),
        (X.task_id, "none", None),
        (X.task_id, "mytask_17", None),
        (X.quiz_number, "mytask_017", "17"),
        (X.quiz_number, "x\\Q3I2.png", "3"),
        (X.quiz_number, "D5 q", "5"),
        (X.anchors, "Image 1 shows the  Eiffel Tower; figure 2 - 3 depicts a cat: no. 图1对应埃菲尔铁塔。Image 1 shows the Eiffel Tower", ["Image 1 shows the Eiffel Tower", "figure 2 - 3 depicts a cat", "图1对应埃菲尔铁塔"]),
        (lambda c: X.compact_evidence(c, 40), "a![x](y)b<|z|>c  \n\n\n\n" + "d" * 40, "ab c\n\n" + "d" * 10 + "\n[... truncated ...]"),
        (pyfuncs.none_to_empty, "{bad", "{bad"),
        (pyfuncs.shrink_arguments(9), "{bad", "{bad"),
        (sinks.scrubbed, "{bad", "{bad"),
        (X.strip_thoughts, '<think>a\nb</think> "yes"', "yes"),
        (X.fenced_json, 'x ```json\n{"a": 1}\n``` y', '{"a": 1}'),
        (X.fenced_json, "no json", None),
        (X.split_sentences, "A 3.14 b. C", ["A 3.", "14 b.", "C"]),
        (X.heading_key, "## 2.1 The Plan", "theplan"),
        (X.tool_calls, '<tool_call>{"name": "a"}</tool_call><tool_call>{bad</tool_call>', ['{"name": "a"}']),
        (X.hashtags, "#a:b #c #a:b", ["#a:b"]),
        (lambda c: X.future_years(c, 2025), "2026 2027 2130 1999", 2),
        (lambda c: X.head_and_tail(c, 10, "x"), "abcdefghijklmno", "abcdef\n\n[... 5 chars omitted from x ...]\n\nlmno"),
        (lambda c: F.size(X.ngrams(F.split(c, " "), 3)), "a b", 0),
        (X.bad_url, "https://example.com/x", True),
        (X.bad_url, "https://real.site/x", False),
        (X.first_urls, None, []),
        (prose.normal_text, "Ａ１ ＵＲＬ", "a1 url"),
        (pyfuncs.none_to_empty, '{"a": [null, {"b": null}]}', '{"a": ["", {"b": ""}]}'),
        (pyfuncs.content_text, '[{"type": "text", "text": "a"}, {"type": "image", "image": "x"}]', "a\n<image>"),
        (pyfuncs.chunks(10), "aaaa\nbbbb\ncccccc. dddddd", ["aaaa\nbbbb", "cccccc.", " dddddd"]),
        (sinks.scrubbed, '{"a": {"save_mode": 1, "b": [{"saveMode": 2}]}}', '{"a": {"b": [{}]}}'),
    ],
)
def test_values(spark, f, value, want):
    assert one(spark, value, f) == want


def test_shrink(spark):
    got = json.loads(one(spark, json.dumps({"a": "x" * 50, "b": ["short"]}), pyfuncs.shrink_arguments(10)))
    assert got["b"] == ["short"] and "truncated 40" in got["a"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(max_size=200), min_size=1, max_size=20), limit=st.integers(2, 60))
def test_compact_is_bounded(spark, texts, limit):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for a, b in df.select("t", X.head_and_tail(F.col("t"), limit).alias("c")).collect():
        assert b == a if len(a) <= limit else len(b) <= limit + 70


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 60), k=st.integers(0, 70))
def test_pick_is_exact(spark, n, k):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    assert mix.pick(df, k, 1, "doc_id").distinct().count() == min(n, k)


def test_counts():
    assert mix.replay_count(10, 0.2) == 2 and mix.replay_count(1, 0.01) == 1 and mix.replay_count(5, 0.0) == 0
    assert mix.limit_count(100, 50, 0.1, 3) == 3 and mix.limit_count(100, 5, 0.1) == 1
    with pytest.raises(ValueError, match="ratio"):
        mix.replay_count(1, 1.0)


def test_call_ids_run_on_over_all_records(spark):
    rows = [(0, 0, None), (0, 1, "own"), (2, 0, None), (25_000, 0, None)]
    got = traces.call_ids(spark.createDataFrame(rows, "ord long, idx int, call_id string"))
    assert sorted((r.ord, r.idx, r.call_id) for r in got.collect()) == [(0, 0, "call_0"), (0, 1, "own"), (2, 0, "call_2"), (25_000, 0, "call_3")]


def test_normalized_rejects_unknown_roles(spark):
    m = spark.createDataFrame([(1, 0, "robot", "x", None, None)], "conv_id long, turn int, role string, text string, tool_name string, call_id string")
    with pytest.raises(Exception, match="robot"):
        traces.normalized(m).collect()


def test_result_reused_id_and_orphan(spark):
    m = spark.createDataFrame(
        [(1, 0, "user", "q", None, None), (1, 1, "assistant", "", "a", "c"), (1, 2, "tool", "r1", "a", "c"), (1, 3, "tool", "r2", "a", "c"), (1, 4, "assistant", "", "a", "c"), (1, 5, "tool", "r3", "a", "c"), (1, 6, "tool", "orphan", "b", "z"), (1, 7, "assistant", "done", None, None)],
        "conv_id long, turn int, role string, text string, tool_name string, call_id string",
    )
    t = {r.turn: (r.action, r.tool_result, r.done) for r in traces.transitions(m).collect()}
    assert t == {1: ("a", "r2", False), 4: ("a", "r3", False), 7: ("respond", None, True)}
    assert sorted(r.turn for r in traces.keep_last(m, 3).collect()) == [7]


def test_visual_admission_and_caps(spark):
    df = spark.createDataFrame([("1", 0, "tool", "look", "x" * 90), ("1", 1, "tool", "search", "y" * 90), ("1", 2, "tool", "search", "https://a.b " + "z" * 90)], "task_id string, ord int, role string, tool_name string, text string")
    assert sorted(r.ord for r in evidence.admitted(df, ["search"], ["look"]).collect()) == [0, 2]
    assert [r.ord for r in evidence.capped(df, 1).collect()] == [0]
    assert evidence.only_tasks(df, df.select("task_id").limit(0)).count() == 3
    assert evidence.visual_top(df.withColumn("text", F.lit("a chart")), 2).count() == 2


def test_retrieve_in_blocks_gives_the_same(spark, monkeypatch):
    q, d = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("benchmark", "documents"))
    plain = lambda x: sorted(map(tuple, x.collect()))
    whole = plain(evidence.retrieve(q, d, 3))
    monkeypatch.setattr(evidence, "MOST_SENT", 150)
    assert whole and plain(evidence.retrieve(q, d, 3)) == whole


def test_retrieve_fills_with_documents_without_a_common_token(spark):
    q = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    d = spark.createDataFrame([(1, "alpha"), (2, "other words here"), (3, "x")], "doc_id long, text string")
    assert [(r.doc_id, r.score) for r in evidence.retrieve(q, d, 2).orderBy("rank").collect()] == [(1, 0.5), (2, 0.0)]


def test_citations_by_hand(spark):
    text = "This is a claim of at least forty characters in all [1].\n\nAnother claim that nobody supports with any source.[7]\n\n[1] : https://a.b/c\n[2] : https://d.e/f\n[2] : https://d.e/g\n[9]: https://h.i/j."
    r = spark.createDataFrame([(1, text)], "doc_id long, report string")
    c = reports.citations(r).first().cit
    assert (c["count"], c.unique_ids, c.valid_ids, c.resolved_ids, c.unresolved_ids, c.orphan_ids) == (2, ["1", "7"], ["1", "9"], ["1"], ["7"], ["9"])
    assert c.mapped_urls == ["https://a.b/c", "https://h.i/j"] and (c.n_claims, c.n_cited) == (2, 1)


def test_repetition_collapse(spark):
    p = "The same paragraph of more than forty characters comes again"
    r = spark.createDataFrame([(1, "\n\n".join([p] * 8))], "doc_id long, report string")
    x = reports.repetition(r).first()
    assert x.most_paragraph == 8 and x.n_paragraphs == 8 and "max_repeated_paragraph_count" in x.severe and 0 < x.penalty <= 0.6


def test_sections_and_headings(spark):
    part = "## A\n" + "x" * 900 + "\n"
    r = spark.createDataFrame([(1, part * 2 + "## B\n" + "y" * 300 + "\n"), (2, "## A\n## A\n```\n## C\n```\ntext")], "doc_id long, report string")
    got = {x.doc_id: x.text for x in reports.dedup_sections(r).collect()}
    assert got[1].count("## A") == 1 and got[1].count("## B") == 1 and got[2].count("## A") == 2
    assert [h.title for h in reports.headings(r).where("doc_id = 2").collect()] == ["A", "A"]
    assert [x.ln for x in reports.without_repeated_headings(r).where("doc_id = 2").orderBy("ln").collect()] == [0, 2, 3, 4, 5]


def test_citation_replacement_and_gated_rubric(spark):
    df = spark.createDataFrame([("a [citation:2] b [citation:9]", ["u1", "u2"], ["repetition_collapse"], [("PRES-1", 0.3)])], "t string, us array<string>, gates array<string>, rules array<struct<id:string,overall_cap:double>>")
    r = df.select(reports.replaced_citations(F.col("t"), F.col("us")).alias("a"), reports.dimension_reward(F.lit(0.9), F.col("gates"), F.col("rules")).alias("d")).first()
    assert r.a == "a (u2) b " and r.d == 0.3


def test_plans(spark):
    s = spark.createDataFrame([(1, 0, "completed"), (1, 1, "not_started"), (1, 2, "not_started"), (1, 3, "blocked")], "plan_id long, idx int, status string")
    d = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2)], "plan_id long, idx int, dep int")
    assert [(r.plan_id, r.idx) for r in dag.ready(s, d).collect()] == [(1, 1)]
    assert dag.ready(s, d.union(spark.createDataFrame([(1, 1, 9)], d.schema))).count() == 0
    assert dag.closure(d).count() == 6
    e = spark.createDataFrame([(1, 0, 1, "completed"), (1, 0, 2, "blocked"), (1, 1, 1, "blocked")], "plan_id long, idx int, ts int, status string")
    assert sorted((r.idx, r.ts) for r in dag.claimable(e).collect()) == [(0, 1), (1, 1)]


def test_events_a_a_b_a(spark):
    e = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (1, 4, "A")], "user_id long, ts int, event_type string")
    assert [r.ts for r in events.changed(e, "user_id", ["ts"], "event_type").orderBy("ts").collect()] == [1, 3, 4]


def test_near_duplicates_assignment_and_lists(spark):
    rows = [(1, 0, "The quick brown fox jumps over the lazy dog today.", "g"), (1, 1, "The quick brown fox jumps over the lazy dog today!", "g"), (1, 2, "The quick brown fox jumps over the lazy dog today.", "other")]
    p = spark.createDataFrame(rows, "doc_id long, pos int, text string, guard string")
    assert sorted(r.pos for r in pyfuncs.near_duplicate_lines(p).collect()) == [0, 2]
    m = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.9), (1, 1, 1, 0.9), (1, 1, 0, 0.2)], "grp long, t int, c int, score double")
    assert sorted((r.t, r.c) for r in pyfuncs.assign(m).collect()) == [(0, 1), (1, 0)]
    i = spark.createDataFrame([("a", 0, "x" * 10), ("a", 1, "x" * 10), ("a", 2, "y" * 10), ("a", 3, "z" * 100), ("a", 4, "w")], "task_id string, pos int, text string")
    assert sorted(r.pos for r in pyfuncs.cover_list(i, chars=50).collect()) == [0, 2]
    f = spark.createDataFrame([("w", 0, "a", "t  t"), ("w", 1, "b", "t t"), ("w", 2, "a", "u"), ("w", 3, "c", "u")], "workspace string, pos int, name string, text string")
    assert sorted(r.pos for r in pyfuncs.file_dedupe(f).collect()) == [0, 3]


def test_exact_copies_go_however_far_apart(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=80)).strip() + " end" for _ in range(260)]
    near = texts[5][:-1] + "!"
    tail = [texts[0], texts[0].upper() + "  ", texts[5], near, "short one"]
    rows = [(1, i, t, "g") for i, t in enumerate(["short one", near, *texts, *tail])] + [(1, 900, texts[0], "other"), (2, 0, texts[0], "g")]
    p = spark.createDataFrame(rows, "doc_id long, pos int, text string, guard string")
    got = {(r.doc_id, r.pos) for r in pyfuncs.near_duplicate_lines(p).collect()}
    # gone: texts[5], near the one before it, and the four copies at the end; another guard or document and short texts stay
    assert {(d, i) for d, i, _, _ in rows} - got == {(1, 7), *((1, 262 + k) for k in range(4))}


def test_cover_list_keeps_what_is_91_percent_alike(spark):
    base = "".join(chr(97 + i % 26) for i in range(100))
    rows = [("a", 0, base), ("a", 1, base[:91] + "0123456789"[:9]), ("a", 2, base[:93] + "!?+*=%&")]  # ratios 0.91 and 0.93 to the first
    i = spark.createDataFrame(rows, "task_id string, pos int, text string")
    assert sorted(r.pos for r in pyfuncs.cover_list(i).collect()) == [0, 1]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"id": 1, "v": "x"}\n\n{"id": 2, "v": "y"}\n')
    (tmp_path / "in/b.jsonl").write_text('{"id": 1, "v": "z"}\n{broken\n')
    got = readers.jsonl(spark, str(tmp_path / "in"), "id long, v string", strict=False)
    assert [(r.id, r.v) for r in got.orderBy("ord").collect()] == [(1, "x"), (2, "y"), (1, "z")]
    assert {r.id: r.v for r in readers.last_wins(got, "id").collect()} == {1: "z", 2: "y"}
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, str(tmp_path / "in"), "id long, v string").collect()
    (tmp_path / "any").mkdir()
    for n, t in (("a", '[{"x": 1}, {"x": 2}]'), ("b", '{"data": [{"x": 3}]}'), ("c", '{"x": 4}'), ("d", '{"x": 5}\n{"x": 6}\n')):
        (tmp_path / f"any/{n}.json").write_text(t)
    assert [json.loads(r.value)["x"] for r in readers.json_any(spark, str(tmp_path / "any")).orderBy("file", "pos").collect()] == [1, 2, 3, 4, 5, 6]
    (tmp_path / "enc").mkdir()
    (tmp_path / "enc/u.txt").write_bytes("中文".encode())
    (tmp_path / "enc/g.txt").write_bytes("中文".encode("gbk"))
    assert {(r.text, r.encoding) for r in readers.decoded(spark, str(tmp_path / "enc")).collect()} == {("中文", "utf-8"), ("中文", "gbk")}
    (tmp_path / "img/x").mkdir(parents=True)
    (tmp_path / "img/a.png").write_bytes(b"1")
    (tmp_path / "img/x/a.png").write_bytes(b"2")
    assert [(r.name, len(r.paths)) for r in readers.image_index(spark, str(tmp_path / "img")).collect()] == [("a.png", 2)]
    for d in ("new", "old"):
        (tmp_path / d).mkdir()
    (tmp_path / "new/r.log").write_text('{"title": "N"}\n{}\n')
    (tmp_path / "old/r.log").write_text('{"title": "O"}\n')
    (tmp_path / "old/s.log").write_text('{"title": "S"}\n')
    assert sorted(tuple(r) for r in readers.replay_logs(spark, str(tmp_path / "new"), str(tmp_path / "old")).collect()) == [("r.log", 2, "N"), ("s.log", 1, "S")]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert readers.markdown_table(readers.csv_table(spark, str(tmp_path / "t.csv"))).first().line == "| 1 | x |"
    df = spark.range(20).withColumnRenamed("id", "ord")
    sinks.rows(df, str(tmp_path / "p"), str(tmp_path / "j"))
    lines = [json.loads(x)["ord"] for f in sorted((tmp_path / "j").glob("part-*")) for x in f.read_text().split("\n") if x]
    assert lines == list(range(20))
    items = spark.createDataFrame([("t", 1, "i", "x", ["u"], "text", "trace_tool")], "task_id string, place int, id string, title string, urls array<string>, text string, source_type string")
    assert sinks.corpus(items, str(tmp_path / "c"), 10, 2400)["items"] == 1
    sinks.by_mode(df.withColumn("sample_mode", F.lit("m")), str(tmp_path / "m"))
    sinks.typed(df.select(F.col("ord").cast("string")), str(tmp_path / "x"), "md")
    with pytest.raises(ValueError, match="writer"):
        sinks.typed(df, str(tmp_path / "y"), "docx")


def test_page_text_and_links(spark):
    html = '<title>T</title><style>x</style><p>a &amp; b</p><!-- c --><script>1</script><img src="/i.png"><a href="q">'
    r = spark.createDataFrame([(html, "https://h.x/d/e")], "h string, u string").select(readers.page_text(F.col("h")).alias("t"), readers.page_links(F.col("h"), F.col("u")).alias("l")).first()
    assert r.t == "T\na & b" and r.l == ["https://h.x/i.png", "https://h.x/d/q"]
