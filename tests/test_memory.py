"""Claims, plan contracts, tool calls, caches, watches and ordinals against plain versions and by hand."""

import json
import random
import time
from collections import Counter, OrderedDict
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import arrow, ordinals, prose
from tessera.functions.shared import shared_dir
from tessera.operators import audit, claims, mix, toolcalls, traces
from tessera.plans import contract, dag
from tessera.sources import readers, sinks
from tessera.streaming import cache, events, fold, watch

# --- claims ---

CLAUSES = [
    ('Mars: mass = "6"', [("Mars", "mass", "6", True)]),
    ('Mars： moons != “two”', [("Mars", "moons", "two", False)]),
    ('Image a-1 gives "red" for the colour and rules out "blue"', [("a-1", "colour", "red", True), ("a-1", "colour", "blue", False)]),
    ('For the colour, image 3 rules out "blue" and lists "red"', [("3", "colour", "red", True), ("3", "colour", "blue", False)]),
    ("图像 x 显示，颜色为“红”，可排除“蓝”", [("x", "颜色", "红", True), ("x", "颜色", "蓝", False)]),
    ("以图 x 为依据，可以排除“蓝”，并确认“红”是颜色的记录", [("x", "颜色", "红", True), ("x", "颜色", "蓝", False)]),
    ("The moon has a mass of 7.3 kg", [("moon", "mass", "7.3 kg", True)]),
    ("Pluto does not have an area of 3", [("Pluto", "area", "3", False)]),
    ("火星的质量为 6千克", [("火星", "质量", "6千克", True)]),
    ("火星的质量不为6", [("火星", "质量", "6", False)]),
    ("Nothing is claimed here", []),
    ('Mars: mass = "6" and more', []),
]


@pytest.mark.parametrize(("clause", "want"), CLAUSES)
def test_claim_forms(clause, want):
    assert claims.claims_in(clause) == want


def test_claims_of_reports(spark):
    report = '# H\n```\nA: b = "1" [1]\n```\n- A: b = "1" [1]. Then C: d = "2"[2][1] rest\n| t | [1] |\nx: y = "3" [3] [9]\n~~~\n[7] : http://in.fence\n~~~\n[1]: HTTP://A.com/P, \n[2] see https://b.com\n* [3]: http://c.com http://d.com\n'
    rows = claims.report_claims(spark.createDataFrame([(1, report), (2, None), (3, "")], "doc_id long, report string")).orderBy("pos").collect()
    got = [(r.clause, sorted(r.sources), r.subject, r.value) for r in rows]
    assert got == [
        ('A: b = "1"', ["http://a.com/P"], "A", "1"),
        ('Then C: d = "2"', ["http://a.com/P", "https://b.com"], "Then C", "2"),
        ("rest", [], None, None),
        ('x: y = "3"', [], "x", "3"),
    ]


def test_value_keys_of_claims():
    same = [("１,200.0 KG", "1200 kg"), ("2024年3月05日", "2024-3-5"), ("−5", "-5.00"), ("  A  b ", "a B"), ("0.0", "0")]
    assert all(claims.value_key(a) == claims.value_key(b) for a, b in same)
    assert len({claims.value_key(v) for v in ("5", "-5", "5 kg", "5%", "five")}) == 5


def combined_plainly(report, base, evidence):
    """One report against its evidence, claim by claim and sentence by sentence."""
    facts, said, whole = [], {}, set()
    for url, text, complete, listed in evidence:
        for sentence in (text or "").split("\n"):
            s = claims.statement_of(sentence)
            if s:
                said.setdefault(url, set()).add(s)
                c = claims.claims_in(sentence.strip().rstrip(claims.ENDS))
                if len(c) == 1 and c[0][3]:
                    facts.append((url, *c[0][:3], False))
        for f in listed:
            facts.append((url, *f))
            if complete:
                whole.add(url)
    all_sources = {f[0] for f in facts}

    def verify(c, cited):
        if not cited:
            return "no_citation"
        field = [f for f in facts if (claims.plain(f[1]), claims.plain(f[2])) == (claims.plain(c[0]), claims.plain(c[1]))]
        own = [f for f in field if f[0] in cited]
        if not own:
            return "source_not_indexed" if not all_sources & set(cited) else "wrong_source" if field else "insufficient_evidence"
        yes = no = False
        for f in own:
            if claims.value_key(f[3]) == claims.value_key(c[2]):
                yes, no = yes or c[3], no or not c[3]
            elif f[4]:
                yes, no = yes or not c[3], no or c[3]
        return "conflicting_evidence" if yes and no else "contradicted" if no else "supported" if yes else "insufficient_evidence"

    out = {}
    for clause, cited in report:
        found = claims.claims_in(clause)
        for c in found:
            key = (claims.plain(c[0]), claims.plain(c[1]), claims.plain(c[2]), c[3], cited)
            status = verify(c, cited)
            if status == "wrong_source" and not (set(cited) <= whole and verify(c, tuple(all_sources - set(cited))) == "supported"):
                status = "insufficient_evidence"
            out.setdefault(key, status)
        if not found:
            s = claims.statement_of(clause)
            p, n, neg = claims.features(s)
            status = "unverified"
            for o in (o for u in cited for o in said.get(u, ())):
                q, m, other = claims.features(o)
                both = len(set(p) & set(q))
                if len(p) >= 5 and n == m and neg == other and both >= 5 and both / len(p) >= 0.55 and both / len(q) >= 0.45:
                    status = "lexical_match"
            if len(s.split()) >= 6 and any(s in said.get(u, ()) for u in cited):
                status = "supported"
            out[s, cited] = status
    n = Counter(out.values())
    moved = sum(n[k] * (w - base) for k, w in claims.SCORES.items()) + 0.25 * n["lexical_match"] * (1 - base)
    return base + moved / max(1, len(out)), n, len(out)


def test_combined_evidence_equals_a_plain_version(spark):
    rng = random.Random(5)
    urls = ["http://a.x", "http://b.x", "http://c.x"]
    words = ["red fox runs over the hill in 3 days", "red fox runs over the hill in 4 days", "the red fox runs over the hill in 3 days today", "no red fox runs over the hill in 3 days", "short one"]
    reports, evidence, want = [], [], {}
    for doc in range(60):
        ev = [(u, "\n".join(rng.sample([*words, 'M1: size = "4"', "M2 has a mass of 5 kg"], rng.randrange(4))), rng.random() < 0.5, [(f"m{rng.randrange(3)}", rng.choice(["Size", "mass"]), str(rng.randrange(3, 6)), rng.random() < 0.5) for _ in range(rng.randrange(4))]) for u in urls if rng.random() < 0.8]
        body = []
        for _ in range(rng.randrange(9)):
            clause = rng.choice([*words, f'M{rng.randrange(3)}: size {rng.choice(["=", "!="])} "{rng.randrange(3, 6)}"', f"M{rng.randrange(3)} has a mass of {rng.randrange(3, 6)} kg"])
            body.append((clause, tuple(sorted(rng.sample(range(4), rng.randrange(3))))))
        lines = [c + " " + "".join(f"[{i + 1}]" for i in ids) for c, ids in body]
        refs = [f"[{i + 1}]: {u}" for i, u in enumerate(urls)]
        base = rng.random()
        reports.append((doc, "\n".join(lines + refs), base))
        evidence += [(doc, *e) for e in ev]
        plain = [(c, tuple(sorted(urls[i] for i in ids)) if 3 not in ids else ()) for c, ids in body]
        want[doc] = combined_plainly(plain, base, ev)
    ddl = "doc_id long, url string, text string, complete boolean, facts array<struct<subject: string, field: string, value: string, exclusive: boolean>>"
    got = claims.combined_evidence(spark.createDataFrame(reports, "doc_id long, report string, base double"), spark.createDataFrame(evidence, ddl)).collect()
    assert len(got) == 60
    for r in got:
        score, n, total = want[r.doc_id]
        assert {o: r[o] for o in claims.OUTCOMES if r[o]} == dict(n), r.doc_id
        assert abs(r.combined - score) < 1e-9 and r.total == total and r.decided == sum(n[k] for k in claims.SCORES)
    assert {o for _, n, _ in want.values() for o in n} >= {"supported", "contradicted", "wrong_source", "lexical_match", "unverified", "no_citation"}


# --- prose ---


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ＦＵＬＬ width ％５", "full width %5"),
        ("see [the *page*](https://a.b/c(d) now", "see the page <url> now"),
        ("![alt text](x.png) after", "after"),
        ("[![badge](http://i.mg/x)](https://a.b) t", "<url> t"),
        ("claim [1, 2–iv][3] stands", "claim stands"),
        ("a<br/>b < c", "a b c"),
        ("## 1. Head\n> 2) said\n  a. item\n- 3. kept", "head said item 3 kept"),
        ("**1.** bold", "bold"),
        ("go to HTTPS://X.Y/z, ok", "go to <url> ok"),
        ("中文ab，c", "中文ab c"),
        ("", ""),
    ],
)
def test_normal_prose(text, want):
    assert prose.normal(text) == want


def test_repetition_counts():
    par = "This paragraph is long enough to count as one of its own"
    text = "\n\n".join([par, f"# {par}", f"{par} [3].", "```\n" + par + "\n```", f"- {par}\n- {par}!", "|---|---|", "short"])
    assert list(prose.paragraphs(text)) == [prose.normal(par)] * 4
    n, dup, most, *_ = prose.repeats_of(text)
    assert (n, dup, most) == (4, 0.75, 4)
    assert prose.grams(list("abab"), 2) == Counter([b"\0\0\0\0\1\0\0\0"] * 2 + [b"\1\0\0\0\0\0\0\0"])
    assert prose.repeats_of("") == (0, 0, 0, 0, 0, 0, 0, 0)
    wide = "ｗｉｄｅ　ｔｅｘｔ　ｉｓ　ｆｏｌｄｅｄ　ｔｏ　ｎａｒｒｏｗ　ｌｅｔｔｅｒｓ　ｈｅｒｅ"
    assert prose.repeats_of(f"{wide}。{'wide text is folded to narrow letters here'}.")[5] == 2


# --- plan contract ---


def told(**e):
    return {"operation": None, "steps": None, "dependencies": None, "step_id": None, "content": None, "evidence_ids": None, "returned": None, "status": None} | e


def test_contract_rules():
    s = json.loads(json.dumps(contract.START))
    go = lambda **e: contract.judge(s, told(**e))[1]
    long_, report = "x" * 40, "r" * 200
    assert go(operation="save_step", step_id="0") == go(operation="submit_report") == "no_plan"
    assert go(operation="create_plan", steps=["one"]) == go(operation="create_plan", steps=["s"] * 12 + ["report"]) == "plan_size"
    assert go(operation="create_plan", steps=["one", "two"]) == "no_report_step"
    assert go(operation=" Create_Plan ", steps=["a", "", " b ", "总结"], dependencies={"1": [0, 1, 0, 9], "x": [1], "7": [0]}) == "plan_accepted"
    assert s["steps"] == ["a", "b", "总结"] and s["needs"] == {"1": [0]}
    assert [go(operation="save_step", step_id=i) for i in (None, "x", "2", "-1", "1")] == ["no_step_id", "no_step_id", "no_working_step", "no_working_step", "blocked"] and s["blocked"] == 1
    assert go(operation="save_step", step_id="0", content="short") == "thin_summary"
    assert go(operation="save_step", step_id="0", content=long_, evidence_ids=["e1"]) == "unknown_evidence"
    assert go(operation="search_evidence", content=" ") == "no_query"
    assert go(operation="search_evidence", content="q", returned=[1]) == "searched"
    assert go(operation="save_step", step_id="0", content=long_, evidence_ids=[" e1 ", ""]) == "step_saved"
    assert go(operation="save_step", step_id="0", content=long_) == "already_saved"
    assert contract.judge(s, told(operation="submit_report", content=report))[1:3] == ("blocked", [1]) and s["candidate"] == 200
    assert go(operation="claim_step", step_id="1") == "claimed" and go(operation="claim_step", step_id="1") == "not_free"
    assert go(operation="mark_step", step_id="0", status="blocked") == "kept_completed" and go(operation="mark_step", step_id="9") == "no_step"
    assert go(operation="save_step", step_id="1", content=long_) == "step_saved"
    assert go(operation="submit_report", content="r") == "thin_report" and go(operation="submit_report", content=report) == "report_submitted"
    assert go(operation="nothing") == go(operation=None) == "unknown_operation" and go(operation="status") == "read"


def streamed(spark, df, files, make, tmp_path):
    df.repartition(files, F.rand(3)).write.parquet(str(tmp_path / "in"))
    return events.run_to_end(make(events.stream_of(spark, str(tmp_path / "in"), "*.parquet", df.schema)), str(tmp_path / "out"))


def test_contract_in_batch_and_on_a_stream(spark, tmp_path):
    rng = random.Random(2)
    ddl = "rollout string, seq long, operation string, steps array<string>, dependencies map<int, array<int>>, step_id string, content string, evidence_ids array<string>, returned array<int>, status string"
    rows = []
    for r in range(12):
        for k in range(1, rng.randrange(4, 30)):
            op = rng.choice(["create_plan", "save_step", "save_step", "save_step", "search_evidence", "submit_report", "claim_step", "mark_step", "status"])
            rows.append((f"r{r}", k, "create_plan" if k == 1 else op, ["a", "b", "report"][rng.randrange(2) :], {1: [0]} if rng.random() < 0.5 else None, str(rng.randrange(3)), "x" * rng.choice([39, 40, 200]), rng.choice([None, ["E1"], ["E2"]]), [1], "completed"))
    df = spark.createDataFrame(rows, ddl)
    want = []
    state, last = {}, None
    for row in rows:
        if row[0] != last:
            last, state = row[0], json.loads(json.dumps(contract.START))
        want.append((row[0], row[1], *contract.judge(state, dict(zip([c.split()[0] for c in ddl.split(", ") if not c.startswith("array<int>>")], row, strict=True)))))
    plain = lambda d: sorted((r.rollout, r.seq, r.valid, r.verdict, list(r.missing), r.saved, r.submitted) for r in d.collect())
    assert plain(contract.judged(df)) == sorted(want)
    assert plain(streamed(spark, df, 4, contract.judged_stream, tmp_path)) == sorted(want)
    assert contract.judged(df.limit(0)).count() == 0


# --- tool calls ---


def test_tool_calls_at_each_level(spark):
    text = 'a <tool_call>{"name": "f", "arguments": {"x": [1, null]}}</tool_call><TOOL_CALL>\n```json\n{"function": "g", "arguments": "raw"}\n```\n</TOOL_CALL><tool_call></tool_call>'
    text += '<tool_call>{"name": " serper_search ", "arguments": {"q": "a b", "n": 3, "z": "y"}} x</tool_call><tool_call>{"arguments": {}}</tool_call><tool_call>[1]</tool_call>'
    text += '<tool_call>{"name": "serper_search", "arguments": {"q": "a", bad}}</tool_call><tool_call>{"name": "ask_question_about_video", broken</tool_call>'
    df = spark.createDataFrame([(1, text, "stop"), (2, "<tool_call>{", "stop"), (3, "plain", "length"), (4, None, None), (5, "<tool_call> {} </tool_call>", "LENGTH")], "id long, content string, finish_reason string")
    got = [(r.id, r.call, r.level, r.name, r.arguments, r.truncated) for r in toolcalls.repaired(df, "id").orderBy("id", "call").collect()]
    assert got == [
        (1, 0, "json", "f", '{"x": [1, null]}', False),
        (1, 1, "fenced", "g", "raw", False),
        (1, 3, "pairs", "serper_search", "{}", False),
        (1, 6, "pairs", "serper_search", '{"q": "a", "query": "a"}', False),
        (1, 7, "pairs", "ask_question_about_video", '{"task_prompt": "Please analyze the file and answer the task."}', False),
        (2, None, None, None, None, True),
        (5, None, None, None, None, False),
    ]
    assert toolcalls.looks_cut_off("<tool_call> x", "max_tokens") and not toolcalls.looks_cut_off("none", "length")


# --- cache and watch ---


def cache_plainly(log, ttl, size):
    held, out = OrderedDict(), []
    for entry, now in log:
        if entry in held and now < held[entry]:
            held.move_to_end(entry)
            out.append((True, 0, None, len(held)))
            continue
        old = [k for k, until in held.items() if now >= until]
        for k in old:
            del held[k]
        gone = held.popitem(last=False)[0] if len(held) >= size else None
        held[entry] = now + ttl
        out.append((False, len(old), gone, len(held)))
    return out


def test_cache_in_batch_and_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows, want = [], []
    for key in range(5):
        now, log = 0.0, []
        for _ in range(120):
            now += rng.choice([0, 1, 30, 400])
            log.append((rng.choice([None, *"abcdefgh"]), now))
        rows += [(key, k, e, t) for k, (e, t) in enumerate(log, 1)]
        want += [(key, k, *x) for k, x in enumerate(cache_plainly(log, 600, 4), 1)]
    df = spark.createDataFrame(rows, "k long, seq long, entry string, at double")
    plain = lambda d: sorted(map(tuple, d.select("k", "seq", "hit", "expired", "evicted", "held").collect()), key=lambda r: r[:2])
    assert plain(cache.replayed(df, "k", 600, 4)) == want and {r[2] for r in want} == {True, False} and any(r[4] for r in want)
    # a second run goes on from the checkpoint of the first
    path = str(tmp_path / "in")
    df.where("seq <= 50").coalesce(1).write.parquet(path)
    make = lambda: cache.replayed_stream(events.stream_of(spark, path, "*.parquet", df.schema), "k", 600, 4)
    assert len(plain(events.run_to_end(make(), str(tmp_path / "out")))) == 250
    df.where("seq > 50").coalesce(1).write.mode("append").parquet(path)
    assert plain(events.run_to_end(make(), str(tmp_path / "out"))) == want


def test_watch_by_a_controlled_clock():
    s = json.loads(json.dumps(watch.START))
    ev = lambda kind, payload: {"kind": kind, "payload": payload}
    assert watch.watch(s, 0, ev("plan", "p1")) == [("plan", "p1")] and s["due"] == 60
    assert watch.watch(s, 10, ev("plan", "p1")) == [] and s["due"] == 70
    assert watch.watch(s, 70, None) == [("waiting", "p1")] and s["due"] == 130
    assert watch.watch(s, 130, None) == []  # said before
    assert watch.watch(s, 131, ev("plan", "p1")) == [("plan", "p1")]
    assert watch.watch(s, 132, ev("tool", "t")) == watch.watch(s, 133, ev("tool", "t")) == [("tool", "t")]
    assert watch.watch(s, 134, ev("analysis", "a")) == [("analysis", "a")] and watch.watch(s, 135, ev("analysis", "a")) == []
    assert watch.watch(s, 200, ev("result", "r")) == [("result", "r")] and s["due"] == 205
    assert watch.watch(s, 205, None) == [] and s["due"] == 210
    assert watch.watch(s, 300, ev("result", "r2")) == [("result", "r2")] and s["done"] == 200  # the first result counts
    assert watch.watch(s, 379, None) == [] and watch.watch(s, 381, ev("analysis", "b")) == [("analysis", "b")]  # late, but before an idle look
    assert watch.watch(s, 386, None) == [("closed", None)] and s["due"] is None
    assert watch.watch(s, 387, ev("plan", "p")) == []


def test_watch_with_real_timers(spark, tmp_path):
    ddl = "k string, seq long, kind string, payload string"
    path = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "plan", "p"), ("b", 1, "result", "r")], ddl).coalesce(1).write.parquet(path)
    s = watch.watched(spark.readStream.schema(ddl).parquet(path), "k", idle=1.0, poll=0.5, tail=2.0)
    q = s.writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        want, until = {("a", "plan", "p"), ("a", "waiting", "p"), ("b", "result", "r"), ("b", "closed", None)}, time.time() + 60
        while time.time() < until and {tuple(r) for r in spark.table("watched").collect()} != want:
            time.sleep(0.5)
        assert sorted(map(str, (tuple(r) for r in spark.table("watched").collect()))) == sorted(map(str, want))
    finally:
        q.stop()


# --- ordinals ---


@pytest.mark.parametrize("split", ["100000000", "3000", "700"])
def test_line_numbers_under_any_split(spark, tmp_path, split):
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text("\n".join(f"{n} {i} " + "é" * (i % 40) + "\r" * (i % 3 == 0) for i in range(800)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        x = readers.text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(x) == 1600 and all(r.value == f"{r.file[-5]} {r.pos} " + "é" * (r.pos % 40) for r in x)
    assert [(r.file, r.pos) for r in sorted(x, key=lambda r: r.ord)] == sorted((r.file, r.pos) for r in x)


def test_running_numbers_and_ranks(spark):
    rng = random.Random(1)
    v = [rng.choice([None, *range(40)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i long, v long").repartition(7)
    got, n = ordinals.running(df, ["v", "i"])
    order = sorted(range(3000), key=lambda i: (v[i] is not None, v[i] or 0, i))
    assert n == 3000 and [r.i for r in sorted(got.collect(), key=lambda r: r.upto)] == order and sorted(r.upto for r in got.collect()) == list(range(1, 3001))
    some = sorted(x for x in v if x is not None)
    shares = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    assert {r.p: r.value for r in audit.percentiles(df, "v", shares).collect()} == {p: some[round((len(some) - 1) * p)] for p in shares}
    assert audit.percentiles(df.limit(0), "v", shares).count() == 0
    ids = traces.call_ids(spark.createDataFrame([(5, 1, None), (5, 0, "own"), (1, 0, None), (900_000, 0, None)], "ord long, idx int, call_id string"))
    assert {(r.ord, r.idx): r.call_id for r in ids.collect()} == {(1, 0): "call_0", (5, 0): "own", (5, 1): "call_2", (900_000, 0): "call_3"}
    parts = [spark.range(3).withColumnRenamed("id", "k"), spark.range(2).withColumnRenamed("id", "k")]
    assert sorted((r.idx, r.source_no, r.k) for r in mix.renumbered(parts, ["k"]).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0), (4, 1, 1)]


def test_fold_counts_rows_of_one_place(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("b", 1, 5), (None, 1, 7)], "k string, seq long, v long")
    add = lambda s, e: (s.__setitem__("n", s["n"] + e["v"]) or s["n"],)
    assert sorted(r.n for r in fold.folded(df, "k", "seq", {"n": 0}, add, "n long").collect())[-2:] == [5, 5]


def test_files_of_task_folders(spark, tmp_path):
    for name in ("task_10/b.md", "task_10/a.md", "task_9/sub/z.md", "task_x/q.md", "other/n.md", "task_9/skip.txt", "task_2/task_3/in.md"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(name)
    got = [(r.task_id, r.name, r.text) for r in readers.task_files(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [("3", "in.md", "task_2/task_3/in.md"), ("9", "z.md", "task_9/sub/z.md"), ("10", "a.md", "task_10/a.md"), ("10", "b.md", "task_10/b.md"), (None, "q.md", "task_x/q.md")]
    assert [r.name for r in readers.task_files(spark, str(tmp_path), recursive=False).orderBy("ord").collect()] == ["in.md", "a.md", "b.md", "q.md"]


def test_rows_as_yaml(spark, tmp_path):
    sinks.typed(spark.createDataFrame([("a: b\n", None)], "x string, n int").coalesce(1), str(tmp_path / "y"), "yaml")
    assert [r.value for r in spark.read.text(str(tmp_path / "y")).collect()] == ['- {"x":"a: b\\n","n":null}']


def test_claims_meet_their_evidence_without_broadcasts(spark):
    evidence = spark.createDataFrame([(1, "https://a.test/p", 'Part 7: size = "3"', True, None)], "doc_id long, url string, text string, complete boolean, facts array<struct<subject: string, field: string, value: string, exclusive: boolean>>")
    out = claims.combined_evidence(spark.createDataFrame([(1, 'Part 7: size = "3" [1]\n[1] : https://a.test/p', 0.0)], "doc_id long, report string, base double"), evidence)
    assert [(r.supported, r.total) for r in out.collect()] == [(1, 1)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_events_of_a_stream_wait_in_files(spark, tmp_path):
    """Three files that each hold every third event: what waits is rows, not state, and comes once."""
    log = [(k, n, f"e{n % 7}", float(n)) for k in range(40) for n in range(1, 10)]
    df = spark.createDataFrame(log, "k long, seq long, entry string, at double")
    for part in (2, 0, 1):
        x = df.where(F.col("seq") % 3 == part)
        x.union(x.where("k = 3")).union(spark.createDataFrame([(None, 1, "x", 0.0)], df.schema)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # some twice, one without key
        make = lambda: cache.replayed_stream(events.stream_of(spark, str(tmp_path / "in"), "*.parquet", df.schema), "k", 600, 4)
        out = events.run_to_end(make(), str(tmp_path / "out"))
        assert out.count() == (360 if part == 1 else 0)
        if part == 0:
            assert spark.read.parquet(str(tmp_path / "out/arrived/batch__=1")).where("not ready__").count() == 240
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, cache.replayed(df, "k", 600, 4).collect()))


def test_waiting_events_leave_no_trace_in_the_state(spark, tmp_path):
    df = spark.createDataFrame([(1, n, f"e{n}", float(n)) for n in range(2, 2000)], "k long, seq long, entry string, at double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert events.run_to_end(cache.replayed_stream(events.stream_of(spark, str(tmp_path / "in"), "*.parquet", df.schema), "k", 600, 4), str(tmp_path / "out")).count() == 0
    assert not list(tmp_path.glob("out/data/*/kept__=true/*")) and spark.read.parquet(str(tmp_path / "out/arrived")).count() == 1998


def test_claims_alone_are_the_same_and_read_by_many_tasks(spark):
    text = 'Part 7: size = "3" [1]. Free words here\nThe part 9 has a mass of 6 kg. [2]\n[1] : https://a.test/p'
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(text).alias("report")).coalesce(1)
    got = claims.report_claims(df, statements=False)
    keep = ("doc_id", "s", "f", "v", "polarity", "sources")
    assert sorted(map(tuple, got.select(*keep).collect())) == sorted(map(tuple, claims.report_claims(df).where("s is not null").select(*keep).collect()))
    assert got.count() == 80 and got.select(F.spark_partition_id()).distinct().count() >= 2 * spark.sparkContext.defaultParallelism


def test_columns_become_python_values_as_arrow_gives_them():
    rng = random.Random(3)
    some = lambda make: [None if rng.random() < 0.3 else make() for _ in range(500)]
    few = lambda make: lambda: [make() for _ in range(rng.randrange(4))]
    maybe = lambda: rng.choice([None, -1, 2**40])
    cols = {
        "long": pa.array(some(maybe), pa.int64()),
        "int": pa.array(range(500), pa.int32()),
        "double": pa.array(some(rng.random), pa.float64()),
        "text": pa.array(some(lambda: rng.choice(["", "é", "NaN"]))),
        "yes": pa.array(some(lambda: rng.random() < 0.5)),
        "none": pa.nulls(500, pa.list_(pa.string())),
        "texts": pa.array(some(few(lambda: rng.choice(["a", None]))), pa.list_(pa.string())),
        "deep": pa.array(some(few(few(maybe))), pa.list_(pa.list_(pa.int64()))),
        "map": pa.array(some(lambda: [(k, few(maybe)()) for k in range(rng.randrange(3))]), pa.map_(pa.int32(), pa.list_(pa.int64()))),
        "at": pa.array(some(lambda: rng.randrange(10**15)), pa.timestamp("us", "UTC")),
        "struct": pa.array(some(lambda: {"a": maybe()}), pa.struct([("a", pa.int64())])),
    }
    b = pa.record_batch(cols)
    for part in (b, b.slice(17, 300), b.slice(499), b.slice(0, 0)):
        want = part.to_pylist()
        assert list(arrow.dicts(part)) == list(arrow.dicts(part, 100)) == want
        assert [[type(v) for v in r.values()] for r in arrow.dicts(part)] == [[type(v) for v in r.values()] for r in want]


def test_verdicts_are_spread_over_four_tasks_a_core(spark):
    kinds = {"steps": "array<string>", "dependencies": "map<int, array<int>>", "step_id": "string", "content": "string", "evidence_ids": "array<string>", "returned": "array<int>", "status": "string"}
    df = spark.range(4000).selectExpr("id % 500 AS rollout", "id AS seq", "'status' AS operation", *[f"cast(null AS {t}) AS {c}" for c, t in kinds.items()]).coalesce(1)
    out = contract.judged(df)
    assert out.select(F.spark_partition_id()).distinct().count() >= 3 * spark.sparkContext.defaultParallelism
    assert out.where("valid and verdict = 'read' and saved = 0").count() == 4000


def test_steps_of_plans_meet_in_a_given_number_of_tasks(spark):
    rng = random.Random(8)
    states = {(p, i): rng.choice(["completed", "not_started", "blocked"]) for p in range(60) for i in range(6)}
    deps = {(p, i, rng.randrange(8)) for p, i in states for _ in range(rng.randrange(3))}
    want = sorted(k for k, s in states.items() if s == "not_started" and all(states.get((p, d)) == "completed" for p, i, d in deps if (p, i) == k))
    s = spark.createDataFrame([(*k, v) for k, v in states.items()], "plan_id long, idx int, status string")
    d = spark.createDataFrame(list(deps), "plan_id long, idx int, dep int")
    for n in (1, 7, None):
        assert sorted(map(tuple, dag.ready(s, d, n).collect())) == want
    assert dag.ready(s.repartition(7, "plan_id", "idx"), d, 7).rdd.getNumPartitions() == 7


def test_lines_are_shuffled_before_their_least_is_sought(spark):
    steps = queries.steps_of(spark, "/root/testdata/sf0.001")[0]
    assert steps.rdd.getNumPartitions() == queries.plan_tasks(spark, "/root/testdata/sf0.001") == 2 * spark.sparkContext.defaultParallelism
    plan = steps._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]


def test_claims_and_evidence_are_shuffled_once(spark, tmp_path):
    """F1 of round 4: claims, facts and sentences meet in one order by document; nothing is written, nothing shuffled twice."""
    evidence = spark.createDataFrame([(1, "https://a.test/p", 'Part 7: size = "3"', True, None)], "doc_id long, url string, text string, complete boolean, facts array<struct<subject: string, field: string, value: string, exclusive: boolean>>")
    shared = set(Path(shared_dir(spark)).rglob("*"))
    out = claims.combined_evidence(spark.createDataFrame([(1, 'Part 7: size = "3" [1]\n[1] : https://a.test/p', 0.0), (2, None, 0.5), (None, 'Part 7: size = "3"', None)], "doc_id long, report string, base double"), evidence)
    assert sorted((r.doc_id or 0, r.supported, r.total, r.combined) for r in out.collect()) == [(0, 0, 0, 0.0), (1, 1, 1, 1.0), (2, 0, 0, 0.5)]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ") == 1
    assert set(Path(shared_dir(spark)).rglob("*")) == shared


def test_structs_become_python_values():
    kind = pa.list_(pa.struct([("a", pa.string()), ("b", pa.bool_()), ("c", pa.struct([("d", pa.int64())]))]))
    rows = [[{"a": "x", "b": True, "c": None}, None, {"a": None, "b": None, "c": {"d": 3}}], None, [], [{"a": "y", "b": False, "c": {"d": None}}]]
    a = pa.array(rows * 3, kind)
    assert arrow.values(a) == a.to_pylist() == rows * 3
    assert arrow.values(a.slice(2, 7)) == a.slice(2, 7).to_pylist()
