"""Hand-derived cases of prompts, workspace joins and trajectory rewards."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import references, tasks


def test_prompts(spark):
    item = "array<struct<title:string,source_ref:string,urls:array<string>,text:string>>"
    df = spark.createDataFrame([([("T", "r", list("abcdef"), " x "), ("", None, None, "y")], "body")], f"items {item}, body string")
    want = "[1] T\nSource: r\nURLs: a; b; c; d; e\nx\n\n[2] Evidence 2\ny"
    r = df.select(tasks.evidence_prompt(F.col("items")).alias("e"), tasks.prompt(F.col("body"), F.lit(2), F.col("items"), F.lit("Report.")).alias("p")).first()
    assert r.e == want and r.p == f"<image>\n<image>\nbody\n\nEvidence:\n{want}\n\nReport."


def test_paths_images_and_numbers(spark):
    index = spark.createDataFrame([("/a/x.png",), ("/b/y.png",), ("/c/y.png",), ("/d/z.png",)], "path string")
    refs = spark.createDataFrame([(1, "/old/x.png"), (2, "/no/z.png"), (3, "/no/y.png"), (4, "q/b/y.png"), (5, " "), (6, None)], "ref_id int, raw string")
    assert {r.ref_id: (r.path, r.how) for r in references.resolved_paths(refs, index, [("/old/", "/a")]).collect()} == {1: ("/a/x.png", "exact"), 2: ("/d/z.png", "name"), 3: (None, None), 4: ("/b/y.png", "suffix"), 5: (None, None), 6: (None, None)}
    got = references.path_candidates(F.col("raw"), [("D:\\w", "/m")], "/r")
    paths = [r.c for r in spark.createDataFrame([("D:\\w\\data\\images\\1.png",), ("/x/work_space/a/data/images/2.png",)], "raw string").select(got.alias("c")).collect()]
    assert paths == [["D:\\w\\data\\images\\1.png", "/m\\data\\images\\1.png", "/r/data/images/1.png", "/r/D:\\w\\data\\images\\1.png"], ["/x/work_space/a/data/images/2.png", "/r/work_space/a/data/images/2.png", "/r/data/images/2.png"]]

    md = spark.createDataFrame([("1", "cat.md", ""), ("1", "b.md", "see dog"), ("1", "c.md", ""), ("2", "d.md", "")], "task_id string, md string, text string")
    im = spark.createDataFrame([("1", "cat.png"), ("1", "dog.png"), ("2", "only.png")], "task_id string, image string")
    assert sorted((r.md, r.image) for r in tasks.images_of(md, im).collect()) == [("b.md", "dog.png"), ("cat.md", "cat.png"), ("d.md", "only.png")]
    assert tasks.images_of(md, im, True).where("md = 'c.md'").count() == 2
    w = spark.createDataFrame([("task_7",), ("task_8",)], "name string")
    q = spark.createDataFrame([("Q7", 0, "old"), ("D07I2", 1, "new")], "id string, ord int, body string")
    assert {r.name: r.quiz and r.quiz.body for r in tasks.by_number(w, q).collect()} == {"task_7": "new", "task_8": None}
    c = spark.createDataFrame([("HTTP://A.b/x.",), ("http://c.d",)], "url string")
    assert tasks.referenced(c, spark.createDataFrame([("http://a.b/x",)], "url string")).count() == 1


@pytest.mark.parametrize(
    ("before", "line", "want"),
    [
        ("", "[T *x*](http://a.b/c) and http://a.b/c", ("link", "T x")),
        ("", "来源：题目 http://a.b/c", ("label", "题目")),
        ("", "Source: 12 http://a.b/c rest", ("label", "12 rest")),
        ("", "2) A `line` (http://a.b/c)", ("line", "A line")),
        ("Title: First\n\"title\": \"Last\"\n", "http://a.b/c", ("window", "Last")),
        ("Title: far\n" + "x" * 495 + "\n", "URL: http://a.b/c", ("host", "a.b")),
        ("", "42 http://a.b/c", ("host", "a.b")),
    ],
)
def test_reference_titles_by_tier(before, line, want):
    (row,) = references._mentions(1, 1, "f", f"{before}{line}\nmore")
    assert (row[5], row[4]) == want and row[3] == "http://a.b/c"



def test_filters(spark):
    s = spark.createDataFrame([(1, "short", ["/a"]), (2, "short", ["/b"]), (3, "x" * 400, [])], "sample_id int, text string, images array<string>")
    assert [r.sample_id for r in tasks.fits_trainer(s, 50, spark.createDataFrame([("/a",)], "path string")).collect()] == [1]
    h = spark.createDataFrame([('[{"type": "a", "value": "b"}]',), ('[{"type": "a"}]',), ("no",)], "h string").select(tasks.history_shaped(F.col("h")).alias("ok"))
    assert [r.ok for r in h.collect()] == [True, False, False]
    f = spark.createDataFrame([("/w/a.md", 200), ("/w/b.md", 5), ("/x/c.md", 300), ("/w/d.txt", 300)], "path string, length int")
    assert [r.path for r in tasks.report_artifacts(f, "/w").collect()] == ["/w/a.md"]
    p = spark.createDataFrame([("see http://a",), ("none",)], "p string").select(tasks.unless_mentioned(F.col("p"), F.array(F.lit("http://a")), "RULE").alias("x"))
    assert [r.x for r in p.collect()] == ["see http://a", "none\n\nRULE"]
    assert [r.idx for r in tasks.sliced(spark.range(9).withColumnRenamed("id", "idx"), 3, 2).collect()] == [3, 4]
    a = spark.createDataFrame([("t", "png"), ("t", "md"), ("t", "png")], "task_id string, type string")
    assert tasks.attachment_counts(a).first().files == "1 md, 2 png"
    lines = spark.createDataFrame([(1, 0, "![a](x)"), (1, 1, "t"), (1, 2, "![b](x)"), (1, 3, "t")], "doc_id int, ln int, line string")
    assert sorted(r.ln for r in tasks.first_embeds(lines).collect()) == [0, 1, 3]


def test_lexical_match_and_credibility(spark):
    kinds = "grp int, id int, text string"
    s = spark.createDataFrame([(1, 1, "The plant made 40 tons of green steel last year"), (1, 2, "The plant made 41 tons of green steel last year"), (1, 3, "The plant never made 40 tons of green steel last year")], kinds)
    t = spark.createDataFrame([(1, 9, "the plant made 40 tons of green steel in the last year")], kinds)
    assert [r.id for r in tasks.lexical_matches(s, t).collect()] == [1]
    r = spark.createDataFrame([(["  a ", "a", "c"], []), ([], [])], "x array<string>, y array<string>").select(tasks.credibility(F.col("x"), F.lit("f" * 60), F.lit(200)).alias("c")).collect()
    assert [x.c for x in r] == [["a"], ["f" * 50]]


def test_step_reward(spark):
    state = spark.createDataFrame([(1, True, 1), (2, False, 0)], "grp long, submitted boolean, invalid int")
    teacher = spark.createDataFrame([(1, 0, "collect market data", False), (1, 1, "write report", True), (2, 0, "collect market data", False)], "grp long, t int, objective string, final boolean")
    gen = spark.createDataFrame([(1, 0, "collect market data"), (1, 1, "write report")], "grp long, c int, text string")
    got = {r.grp: r for r in tasks.step_rewards(state, teacher, gen, gen.where("c = 0")).collect()}
    assert abs(got[1].final_reward - (0.15 + 0.75 + 0.10 - 0.04)) < 1e-9 and got[2].final_reward == 0.0
    j = spark.createDataFrame([(0.4, 0.8), (None, 0.5)], "a double, b double").select(tasks.joint_reward(F.col("a"), F.col("b")).alias("x")).collect()
    assert abs(j[0].x - 0.6) < 1e-12 and j[1].x == 0.5
