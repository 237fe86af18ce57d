"""Registry of the library's own queries: name -> callable, and name -> the same in DuckDB's SQL.

The driver's tables stand in for traces, evidence and reports: ``reports`` turns documents into Markdown with headings,
citations and a reference list of pages; ``messages`` turns conversations into traces with tool calls and results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.shared import shared_dir
from tessera.operators import audit, evidence, mix, reports, traces
from tessera.plans import dag
from tessera.sources import readers
from tessera.streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
YEAR = 2025
TOOLS = ("search", "extract", "chart", "write")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- views --------------------------------------------------------------------------------------------------------


def reports_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    n = pages.agg((F.max("page_id") + 1).alias("n"))
    want = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).crossJoin(F.broadcast(n)).select("doc_id", "k", F.pmod(F.col("doc_id") + F.col("k"), F.col("n")).alias("page_id"))  # n is one row
    label = F.when(F.col("k") <= 4, F.col("k")).when(F.col("k") <= 6, 5).when(F.col("k") == 7, 9).otherwise(12)
    refs = want.join(pages.select("page_id", "url"), "page_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", label.alias("label"), "url"))).alias("rs"))
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when((i + 1) % 5 == 0, "## ").otherwise(""), x, F.when((i + 1) % 2 == 1, F.concat(F.lit(" ["), ((i + 1) % 7 + 1).cast("string"), F.lit("]"))).otherwise(""))), "\n\n")
    listed = F.array_join(F.transform("rs", lambda r: F.concat(F.lit("["), r["label"].cast("string"), F.lit("] : "), r["url"])), "\n")
    prompt = F.when(F.col("lang") == "en", "Compare the numbers in a markdown table").when(F.col("lang") == "de", "List 3 categories, under 200 characters").when(F.col("lang") == "fr", "Name two possible candidates").otherwise("")
    judged = F.when(F.col("source") == "src1", "excellent, but the data look fabricated").when(F.col("source") == "src2", "accurate").otherwise("")
    x = docs.join(refs, "doc_id").select("doc_id", "source", "lang", F.concat(body, F.lit("\n\n## References\n\n"), listed).alias("report"), prompt.alias("task_prompt"), judged.alias("judge_reason"))
    urls = refs.select("doc_id", F.transform(F.filter("rs", lambda r: r["k"] <= 3), lambda r: r["url"]).alias("evidence_urls"))
    x = x.join(urls, "doc_id")
    none = F.array().cast("array<string>")
    return x.withColumns({"expected_images": F.when(F.col("lang") == "es", F.array(F.concat("source", F.lit(".png")), F.lit("the.png"))).otherwise(none), "tool_errors": F.length("source") % 2, "evidence_titles": F.array("source", "lang")})


REPORTS = """
npg AS (SELECT max(page_id) + 1 AS n FROM pages),
want AS (SELECT doc_id, k, (doc_id + k) % n AS page_id FROM documents, range(1, 9) t(k), npg),
refs AS (SELECT doc_id, list(url ORDER BY k) AS urls, string_agg('[' || CASE WHEN k <= 4 THEN k WHEN k <= 6 THEN 5 WHEN k = 7 THEN 9 ELSE 12 END || '] : ' || url, chr(10) ORDER BY k) AS listed FROM want JOIN pages USING (page_id) GROUP BY doc_id),
reports AS (SELECT doc_id, source, lang,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: (CASE WHEN i % 5 = 0 THEN '## ' ELSE '' END) || x || (CASE WHEN i % 2 = 1 THEN ' [' || (i % 7 + 1) || ']' ELSE '' END)), chr(10) || chr(10)) || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || listed AS report,
  CASE lang WHEN 'en' THEN 'Compare the numbers in a markdown table' WHEN 'de' THEN 'List 3 categories, under 200 characters' WHEN 'fr' THEN 'Name two possible candidates' ELSE '' END AS task_prompt,
  CASE source WHEN 'src1' THEN 'excellent, but the data look fabricated' WHEN 'src2' THEN 'accurate' ELSE '' END AS judge_reason,
  list_slice(urls, 1, 3) AS evidence_urls FROM documents JOIN refs USING (doc_id))"""


def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.length("text") % 4 + 1).cast("int"))
    role = F.when((F.col("role") == "user") & (F.col("turn") > 1), "tool").otherwise(F.col("role"))
    calls = (F.col("role") == "assistant") & (F.length("text") % 3 != 0) | (role == "tool")
    return c.select("conv_id", "turn", role.alias("role"), "text", F.when(calls, tool).alias("tool_name"), F.when(calls, F.concat(F.lit("c"), (F.floor(F.col("turn") / 2) % 2).cast("string"))).alias("call_id"))


MESSAGES = """
messages AS (SELECT conv_id, turn, r AS role, text, CASE WHEN calls THEN ['search', 'extract', 'chart', 'write'][length(text) % 4 + 1] END AS tool_name,
  CASE WHEN calls THEN 'c' || ((turn // 2) % 2) END AS call_id
  FROM (SELECT *, (role = 'assistant' AND length(text) % 3 <> 0) OR r = 'tool' AS calls FROM (SELECT *, CASE WHEN role = 'user' AND turn > 1 THEN 'tool' ELSE role END AS r FROM conversations)))"""


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("task_id"), F.col("doc_id").alias("ord"), F.when(F.col("lang") == "en", "trace_tool").otherwise("workspace_md").alias("source_type"), F.concat(F.when(F.col("lang") == "fr", "final_").otherwise("notes_"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("source_ref"), "text", F.length("text").alias("n_chars"), (F.length("text") % 3).alias("url_count"))


ITEMS = """
items AS (SELECT source AS task_id, doc_id AS ord, CASE WHEN lang = 'en' THEN 'trace_tool' ELSE 'workspace_md' END AS source_type, CASE WHEN lang = 'fr' THEN 'final_' ELSE 'notes_' END || doc_id AS name, lang AS source_ref, text, length(text) AS n_chars, length(text) % 3 AS url_count FROM documents)"""

# --- evidence -----------------------------------------------------------------------------------------------------

STOP = "'about', 'after', 'also', 'and', 'are', 'from', 'have', 'into', 'must', 'that', 'the', 'their', 'then', 'this', 'using', 'with'"
TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}|[0-9]+(?:\\.[0-9]+)?%?'))"


@query(f"""
WITH q AS (SELECT item_id, {TOKENS} AS ts FROM benchmark), d AS (SELECT doc_id, length(text) AS n, {TOKENS} AS ts FROM documents),
qt AS (SELECT item_id, len(ts) AS m, unnest(ts) AS t FROM q), dt AS (SELECT doc_id, n, unnest(ts) AS t FROM d),
s AS (SELECT item_id, doc_id, any_value(n) AS n, round_even(count(*) / any_value(m), 6) AS score FROM qt JOIN dt USING (t) GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, n DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5, X6."""
    return evidence.retrieve(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 3)


@query(f"""
WITH {ITEMS}, r AS (SELECT * REPLACE (CASE ord % 7 WHEN 0 THEN 'Final_Report' WHEN 1 THEN 'notes' WHEN 2 THEN '检索URL' WHEN 3 THEN 'x_20240102_030405' WHEN 4 THEN '报告最终' WHEN 5 THEN 'Source_evidence' ELSE '资料最终报告' END || '_' || ord || '.md' AS name) FROM items),
s AS (SELECT *, 5 * regexp_matches(text, 'https?://[^\\s)\\]}}>"''。，；：！？]')::INT + CASE ord % 7 WHEN 0 THEN -20 WHEN 1 THEN 0 WHEN 2 THEN 6 WHEN 3 THEN -20 WHEN 4 THEN -20 WHEN 5 THEN 4 ELSE -18 END + (n_chars > 500)::INT AS score FROM r)
SELECT task_id, name, score::INT AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, n_chars, name) AS rank FROM s) WHERE rank <= 10""")
def evidence_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, F4."""
    kinds = F.array(*[F.lit(k) for k in ("Final_Report", "notes", "检索URL", "x_20240102_030405", "报告最终", "Source_evidence", "资料最终报告")])
    name = F.concat(F.element_at(kinds, (F.col("ord") % 7 + 1).cast("int")), F.lit("_"), F.col("ord").cast("string"), F.lit(".md"))
    x = items_of(spark, sf_dir).withColumn("name", name).withColumn("score", evidence.doc_score(F.col("name"), F.col("text")))
    return evidence.top_docs(x, 10).select("task_id", "name", "score", "rank")


@query(f"""
WITH {ITEMS} SELECT task_id, ord, row_number() OVER (PARTITION BY task_id ORDER BY (url_count > 0) DESC, (source_type = 'trace_tool') DESC, url_count DESC, n_chars, ord)::INT AS place FROM items""")
def evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, A6."""
    return evidence.ordered(items_of(spark, sf_dir)).select("task_id", "ord", "place")


RR = """
b AS (SELECT *, CASE WHEN source_type = 'trace_tool' AND url_count > 0 THEN 0 WHEN url_count > 0 THEN 1 WHEN source_type = 'trace_tool' THEN 2 ELSE 3 END AS bucket FROM items),
t AS (SELECT *, row_number() OVER (PARTITION BY task_id, bucket ORDER BY url_count DESC, n_chars, ord) AS turn FROM b),
rr AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY turn, bucket) AS place FROM t)"""


@query(f"WITH {ITEMS}, {RR} SELECT task_id, ord, bucket, place::INT AS place FROM rr")
def evidence_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3."""
    return evidence.round_robin(items_of(spark, sf_dir)).select("task_id", "ord", "bucket", "place")


@query(f"""
WITH RECURSIVE {ITEMS}, {RR}, top AS (SELECT task_id, place, text FROM rr WHERE place <= 12), n AS (SELECT task_id, count(*) AS n FROM top GROUP BY task_id),
f AS (SELECT task_id, n, 0::BIGINT AS place, 6000::BIGINT AS rest, 0::BIGINT AS allowed, 0::BIGINT AS used FROM n
 UNION ALL SELECT task_id, n, place, rest - length(rtrim(left(text, a), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), a, length(rtrim(left(text, a), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))
 FROM (SELECT f.task_id, f.n, top.place, f.rest, top.text, least(length(top.text), greatest(greatest(320, 6000 // f.n), f.rest // (f.n - f.place)), f.rest) AS a FROM f JOIN top ON f.task_id = top.task_id AND top.place = f.place + 1 WHERE f.rest > 0))
SELECT task_id, place, allowed, used FROM f WHERE place > 0""")
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack is the first 12 of the round robin."""
    top = evidence.round_robin(items_of(spark, sf_dir)).where("place <= 12").select("task_id", F.col("place").cast("int").alias("place"), "text")
    x = evidence.fair_share(top, 6000).select("task_id", F.explode("packed").alias("p"))
    return x.select("task_id", F.col("p.place").cast("long").alias("place"), F.col("p.allowed").cast("long").alias("allowed"), F.col("p.used").cast("long").alias("used"))


@query(f"""
WITH {ITEMS}, i AS (SELECT *, left(sha1(source_type || chr(10) || task_id || chr(10) || source_ref || chr(10) || left(text, 500)), 16) AS id FROM items)
SELECT task_id, id, min(ord) AS ord, count(*) AS copies FROM i GROUP BY task_id, id""")
def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4."""
    i = items_of(spark, sf_dir).withColumn("id", evidence.item_id(F.col("source_type"), F.col("task_id"), F.col("source_ref"), F.col("text")))
    n = i.groupBy("task_id", "id").agg(F.count(F.lit(1)).alias("copies"))
    return evidence.distinct_items(i).select("task_id", "id", "ord").join(n, ["task_id", "id"])


@query(f"""
WITH {ITEMS}, tasks AS (SELECT item_id AS task, CASE WHEN item_id % 3 = 0 THEN 'src' || item_id % 40 ELSE 'q_src' || item_id % 40 END AS qid, 'src' || item_id % 23 AS id FROM benchmark),
k AS (SELECT task, unnest([qid, regexp_extract(qid, '([0-9]+)$', 1), id, regexp_extract(id, '([0-9]+)$', 1)]) AS task_id, unnest([0, 1, 2, 3]) AS prio FROM tasks),
best AS (SELECT task, arg_min(task_id, prio) AS task_id FROM k WHERE task_id IN (SELECT task_id FROM items) GROUP BY task)
SELECT t.task, b.task_id, count(i.ord) AS n_items FROM tasks t LEFT JOIN best b USING (task) LEFT JOIN items i ON i.task_id = b.task_id GROUP BY t.task, b.task_id""")
def evidence_first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, P12."""
    b = table(spark, sf_dir, "benchmark")
    n = F.col("item_id")
    qid = F.concat(F.when(n % 3 == 0, "src").otherwise("q_src"), (n % 40).cast("string"))
    tasks = b.select(n.alias("task"), evidence.task_keys(qid, F.concat(F.lit("src"), (n % 23).cast("string"))).alias("keys"))
    return evidence.first_key(tasks, items_of(spark, sf_dir)).groupBy("task", "task_id").agg(F.count("ord").alias("n_items"))


@query("""
SELECT count(*) AS tasks, count(*) FILTER (WHERE ok) AS covered, round_even(avg(ok::INT), 6) AS coverage FROM (SELECT d.doc_id, l.doc_id IS NOT NULL AS ok FROM documents d LEFT JOIN labels l USING (doc_id))""")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("ok"))
    return evidence.coverage(d.join(lab, "doc_id", "left").select(F.coalesce("ok", F.lit(False)).alias("has_evidence")))


# --- traces -------------------------------------------------------------------------------------------------------

POSED = "p AS (SELECT *, row_number() OVER w - 1 AS pos, lead(role) OVER w AS next_role, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS first_user FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
CONTEXT = "ctx AS (SELECT t.conv_id, t.turn, c.turn AS c_turn FROM p t JOIN p c ON t.conv_id = c.conv_id AND c.pos < t.pos WHERE t.role = 'assistant' AND (c.role = 'system' OR c.turn = c.first_user OR t.pos - c.pos <= 2 OR (c.next_role = 'tool' AND t.pos - c.pos - 1 <= 2 AND t.pos - c.pos > 1)))"
RENDER = "'<|im_start|>' || CASE WHEN role = 'tool' AND tool_name IS NOT NULL THEN 'tool name=' || tool_name ELSE role END || chr(10) || coalesce(text, '') || '<|im_end|>'"


@query(f"WITH {MESSAGES}, {POSED}, {CONTEXT} SELECT conv_id, turn, count(*) AS n, sum(c_turn)::BIGINT AS turns FROM ctx GROUP BY conv_id, turn")
def trace_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    return traces.context(messages_of(spark, sf_dir), 2).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum("c_turn").alias("turns"))


@query(f"""
WITH {MESSAGES}, {POSED}, {CONTEXT}, r AS (SELECT conv_id, turn AS c_turn, {RENDER} AS r FROM messages),
g AS (SELECT conv_id, turn, count(*) AS n_context, md5(string_agg(r, chr(10) ORDER BY c_turn)) AS prompt FROM ctx JOIN r USING (conv_id, c_turn) GROUP BY conv_id, turn)
SELECT g.conv_id, g.turn, n_context, prompt, md5(coalesce(m.text, '')) AS target FROM g JOIN messages m USING (conv_id, turn)""")
def trace_turn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, P5."""
    s = traces.turn_samples(messages_of(spark, sf_dir), 2)
    return s.select("conv_id", "turn", "n_context", F.md5("prompt").alias("prompt"), F.md5("target").alias("target"))


@query(f"""
WITH {MESSAGES}, s AS (SELECT conv_id, string_agg({RENDER}, chr(10) ORDER BY turn) AS prompt FROM messages GROUP BY conv_id)
SELECT min(conv_id) AS conv_id, length(prompt)::INT AS n FROM s WHERE length(prompt) BETWEEN 400 AND 20000 GROUP BY prompt""")
def trace_keep_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, D1, U3."""
    s = traces.full_samples(messages_of(spark, sf_dir))
    return traces.keep_samples(s, "prompt", ["conv_id"], 400, 20_000).select("conv_id", F.length("prompt").alias("n"))


@query(f"""
WITH {MESSAGES}, o AS (SELECT *, lag(text) OVER w AS observation, sum((role = 'assistant' AND call_id IS NOT NULL)::INT) OVER (PARTITION BY conv_id, call_id ORDER BY turn) AS use FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS done FROM o WHERE role = 'assistant'),
r AS (SELECT conv_id, call_id, use, arg_max(text, turn) AS tool_result FROM o WHERE role = 'tool' AND use > 0 GROUP BY ALL)
SELECT a.conv_id, a.turn, md5(a.observation) AS observation, coalesce(a.tool_name, 'respond') AS action, md5(r.tool_result) AS tool_result, a.done
FROM a LEFT JOIN r ON a.conv_id = r.conv_id AND a.call_id = r.call_id AND a.use = r.use""")
def trace_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, P16, W6, J3."""
    t = traces.transitions(messages_of(spark, sf_dir))
    return t.select("conv_id", "turn", F.md5("observation").alias("observation"), "action", F.md5("tool_result").alias("tool_result"), "done")


@query(f"""
WITH {MESSAGES}, s AS (SELECT *, (SELECT min(b.turn) FROM messages b WHERE b.conv_id = m.conv_id AND b.role = 'assistant' AND b.turn > m.turn) AS stop FROM messages m WHERE role = 'assistant' AND tool_name IS NOT NULL)
SELECT s.conv_id, s.turn, min(t.turn) AS result_turn FROM s LEFT JOIN messages t ON t.conv_id = s.conv_id AND t.role = 'tool' AND t.tool_name = s.tool_name AND t.turn > s.turn AND (s.stop IS NULL OR t.turn < s.stop)
 AND (s.call_id IS NULL OR t.call_id IS NULL OR s.call_id = t.call_id) GROUP BY s.conv_id, s.turn""")
def trace_result_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4."""
    return traces.result_of(messages_of(spark, sf_dir))


@query(f"""
WITH {MESSAGES}, {POSED}, c AS (SELECT *, CASE WHEN role = 'assistant' THEN tool_name END AS call FROM p),
j AS (SELECT a.conv_id, a.turn, a.pos, (SELECT max(pos) FROM c b WHERE b.conv_id = a.conv_id AND b.pos < a.pos AND b.call IS NOT NULL) AS pp,
 (SELECT min(pos) FROM c b WHERE b.conv_id = a.conv_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 AND b.call IN ('write', 'chart')) AS tp FROM c a WHERE a.call IN ('search', 'extract'))
SELECT j.conv_id, j.turn, q.call AS previous_tool, t.turn AS terminal_turn, t.call AS terminal_tool, least(t.pos + 1 + coalesce(t.next_role = 'tool', false)::INT, j.pos + 4)::INT AS end_pos
FROM j JOIN c t ON t.conv_id = j.conv_id AND t.pos = j.tp LEFT JOIN c q ON q.conv_id = j.conv_id AND q.pos = j.pp""")
def trace_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, W3."""
    return traces.segments(messages_of(spark, sf_dir), ["search", "extract"], ["write", "chart"], 6, 4)


@query(f"""
WITH {MESSAGES}, c AS (SELECT *, CASE WHEN role = 'assistant' THEN tool_name END AS call, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM messages),
s AS (SELECT a.conv_id, a.turn, (SELECT count(DISTINCT b.call) FROM c b WHERE b.conv_id = a.conv_id AND b.pos BETWEEN a.pos - 12 AND a.pos - 1) AS seen FROM c a WHERE a.call IS NOT NULL)
SELECT conv_id, turn, seen::INT AS seen, CASE WHEN seen >= 3 THEN 3 WHEN seen >= 1 THEN 2 ELSE 1 END AS weight FROM s""")
def trace_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    return traces.workflow_weight(messages_of(spark, sf_dir), 12)


@query(f"""
WITH {MESSAGES}, r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pair FROM messages WHERE tool_name IN ('search', 'chart') AND role IN ('assistant', 'tool')) SELECT conv_id, turn, pair::INT AS pair FROM r WHERE pair <= 2""")
def trace_recent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return traces.recent_pairs(messages_of(spark, sf_dir), ["search", "chart"])


GROUPED = "g AS (SELECT *, sum((role <> 'tool')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM messages)"


@query(f"""
WITH {MESSAGES}, {GROUPED}, n AS (SELECT conv_id, grp, count(*) AS n FROM g WHERE grp > 0 GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY grp DESC) AS upto FROM n)
SELECT g.conv_id, g.turn, g.grp::BIGINT AS grp FROM g JOIN u USING (conv_id, grp) WHERE upto <= 4""")
def trace_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11, W12."""
    return traces.keep_last(messages_of(spark, sf_dir), 4).select("conv_id", "turn", "grp")


@query(f"""
WITH {MESSAGES}, {GROUPED}, n AS (SELECT conv_id, grp, sum(floor(length(coalesce(text, '')) / 4.0) + 4) AS n FROM g GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY grp DESC) AS upto FROM n)
SELECT g.conv_id, g.turn FROM g JOIN u USING (conv_id, grp) WHERE upto <= 500""")
def trace_keep_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14, M6."""
    return traces.keep_budget(messages_of(spark, sf_dir), 500).select("conv_id", "turn")


@query(f"""
WITH {MESSAGES}, {GROUPED}, l AS (SELECT *, max(grp) OVER (PARTITION BY conv_id) AS last FROM g)
SELECT conv_id, turn, CASE WHEN grp <= 1 THEN 'head' WHEN grp > last - 2 THEN 'tail' ELSE 'middle' END AS part FROM l""")
def trace_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13."""
    return traces.parts(messages_of(spark, sf_dir), 1, 2).select("conv_id", "turn", "part")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rr FROM conversations)
SELECT conv_id, turn, role FROM r WHERE rn <= 20 AND (role = 'user' OR (role = 'assistant' AND rr <= 2))""")
def trace_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W16."""
    return traces.history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query(f"""
WITH {MESSAGES} SELECT conv_id, turn FROM messages m WHERE NOT EXISTS (SELECT 1 FROM messages b WHERE b.conv_id = m.conv_id AND b.turn < m.turn AND b.role = 'tool')""")
def trace_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7."""
    return traces.until(messages_of(spark, sf_dir), F.col("role") == "tool").select("conv_id", "turn")


@query(f"""
WITH {MESSAGES}, a AS (SELECT conv_id, tool_name, lag(tool_name) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM messages WHERE role = 'assistant' AND tool_name IS NOT NULL)
SELECT 'role:' || role AS key, count(*) AS n FROM messages GROUP BY ALL UNION ALL SELECT 'tool_call:' || tool_name, count(*) FROM a GROUP BY ALL UNION ALL SELECT 'workflow_transition:' || prev || '->' || tool_name, count(*) FROM a WHERE prev IS NOT NULL GROUP BY ALL""")
def trace_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return traces.counters(messages_of(spark, sf_dir))


@query(f"""
WITH {MESSAGES} SELECT conv_id, turn, role, length(CASE WHEN role = 'assistant' AND tool_name IS NOT NULL THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END)::INT AS n FROM messages WHERE role = 'assistant' OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''""")
def trace_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P6, F2."""
    return traces.normalized(messages_of(spark, sf_dir)).select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, left(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 300) ORDER BY ln) AS k FROM l WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''),
u AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM o WHERE k = 1 AND regexp_matches(line, '[A-Z]\\S+ [a-z]'))
SELECT doc_id, ln::INT AS ln FROM u WHERE used < 800""")
def lines_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return traces.compact_lines(lines, 800, r"[A-Z]\S+ [a-z]").select("doc_id", "ln")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, ' ')) AS line, unnest(range(len(string_split(text, ' ')))) AS ln FROM documents),
p AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM l), q AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY ln) AS prev FROM p)
SELECT doc_id, count(*) AS n, sum(ln)::BIGINT AS places FROM q WHERE prev IS NULL OR s <> prev GROUP BY doc_id""")
def code_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, on words as lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("ln", "line")).withColumn("line", F.regexp_replace("line", "^#", "%"))
    return traces.compact_code(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ln").cast("long").alias("places"))


# --- text ---------------------------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS mid FROM d),
e AS (SELECT doc_id, text, regexp_replace('A' || ' ' || 'B' || chr(10) || chr(10) || CASE WHEN mid = '' THEN '' ELSE mid END, '\\s+$', '') AS e FROM c),
f AS (SELECT doc_id, text, regexp_replace(regexp_replace(e, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS e FROM e)
SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(left(text, 180), '\\s+$', '') || chr(10) || chr(10) || '[... ' || (length(text) - 300) || ' chars omitted from text ...]' || chr(10) || chr(10) || regexp_replace(right(text, 120), '^\\s+', '') END) AS head_tail,
 md5(CASE WHEN length(e) <= 400 THEN e ELSE regexp_replace(left(e, 376), '\\s+$', '') || chr(10) || '[... truncated ...]' END) AS cut,
 md5(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS clean FROM f""")
def text_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 of the text behind an image, a marker and blank lines."""
    t = F.col("text")
    marked = F.concat(F.lit("![i](u.png)A<|x|>B \t\n\n \n\n"), X.strip(X.text(t)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.head_and_tail(t, 300, "text")).alias("head_tail"), F.md5(X.compact_evidence(marked, 400)).alias("cut"), F.md5(X.clean_space(t)).alias("clean"))


@query("""
WITH t AS (SELECT doc_id, coalesce(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '中，' || left(text, 3) WHEN 2 THEN left(text, 200) || '。' ELSE '12 é' END, '') AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '[一-鿿　-〿]') THEN 'zh' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' ELSE 'zh' END AS spoken,
 CASE WHEN len(regexp_extract_all(t, '[一-鿿　-〿]')) > n THEN 'zh' WHEN n > 0 THEN 'en' ELSE 'zh' END AS main FROM (SELECT doc_id, t, length(array_to_string(list_filter(regexp_split_to_array(t, '[^0-9A-Za-z_À-ÖØ-öø-ɏ一-鿿]+'), lambda w: regexp_full_match(w, '[A-Za-z]+')), '')) AS n FROM t)""")
def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By any Chinese character, and by what prevails; report_language has the third rule."""
    k, t = F.col("doc_id") % 4, F.col("text")
    x = F.when(k == 0, t).when(k == 1, F.concat(F.lit("中，"), F.left(t, F.lit(3)))).when(k == 2, F.concat(F.left(t, F.lit(200)), F.lit("。"))).otherwise("12 é")
    return table(spark, sf_dir, "documents").select("doc_id", X.spoken_language(x).alias("spoken"), X.main_language(x).alias("main"))


@query("""
SELECT doc_id, (2 * len(regexp_extract_all(text, '[一-鿿]')) + len(regexp_extract_all(text, '[A-Za-z]{2,}')) + least(100, len(regexp_extract_all(text, '[0-9]'))))::INT AS score, floor(length(text) / 4.0)::BIGINT + 4 AS tokens,
 length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10 AND len(regexp_extract_all(text, '[A-Za-z0-9À-ɏ一-鿿\\s.,;:!?''-]')) >= 0.3 * length(text) AS readable, CASE WHEN strlen(text) < 1024 THEN 'small' WHEN strlen(text) < 8192 THEN 'medium' ELSE 'large' END AS size FROM documents""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F10, M6, X23."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.meaning_score(t).alias("score"), X.est_tokens(t).alias("tokens"), X.readable(t).alias("readable"), X.size_class(t).alias("size"))


@query("""
SELECT page_id, lower(regexp_extract(url, '^(\\w+://[^/?#]+)', 1)) || substr(url, length(regexp_extract(url, '^(\\w+://[^/?#]+)', 1)) + 1) AS url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host,
 contains(url, 'example.com') OR NOT regexp_matches(url, '^https?://[^/\\s]+\\.[^/\\s]+') AS bad, regexp_replace(regexp_replace(lower(url), '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
 regexp_replace(regexp_replace(url, '[^0-9A-Za-z._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS name, CASE page_id % 4 WHEN 0 THEN '0' || page_id WHEN 1 THEN page_id::VARCHAR END AS task, page_id::VARCHAR AS number FROM pages""")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2, X3, F6, X11, X14, X18."""
    u, k, i = F.col("url"), F.col("page_id") % 4, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("w/task_0"), i, F.lit("/f.md"))).when(k == 1, F.concat(F.lit("see task_"), i)).when(k == 2, F.concat(F.lit("mytask_"), i)).otherwise(F.concat(F.lit("G"), i, F.lit("I7.png")))
    return table(spark, sf_dir, "pages").select("page_id", X.normal_url(u).alias("url"), X.url_host(u).alias("host"), X.bad_url(u).alias("bad"), X.slug(u).alias("slug"), X.safe_name(u).alias("name"), X.task_id(path).alias("task"), X.quiz_number(path).alias("number"))


@query("""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host FROM pages)
SELECT page_id, host FROM h WHERE NOT (host = 'example.org' OR ends_with(host, '.example.org') OR host = 'spam-farm.example.net' OR ends_with(host, '.spam-farm.example.net'))""")
def domains_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hosts and their suffixes against a block list of fixed size."""
    p = table(spark, sf_dir, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))
    bad = ("example.org", "spam-farm.example.net")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return p.where(~F.arrays_overlap(suffixes, F.array(*[F.lit(b) for b in bad])))


@query("""
WITH x AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<noscript\\b[^>]*>.*?</noscript>', ' ', 'g') AS t FROM pages),
y AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(?:p|div|br|li|tr|h[1-6]|title|section|article)\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM x),
z AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM y)
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text FROM z""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9, S11."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(readers.page_text(F.col("html"))).alias("text"))


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11, F8."""
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(readers.page_links(F.col("html"), F.col("url"))).alias("pos", "link"))
    return p.where(~F.col("link").rlike(r"(?i)\.(?:png|jpe?g|gif|svg|css|js|ico)(?:[?#]|$)"))


@query(f"""
WITH t AS (SELECT item_id, text AS c, {TOKENS} AS need FROM benchmark), d AS (SELECT doc_id, source, {TOKENS} AS have FROM documents), b AS (SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source),
w AS (SELECT *, list_filter(need, lambda x: NOT list_contains([{STOP}], x)) AS few FROM t),
j AS (SELECT item_id, d.doc_id, len(need) AS n, len(list_intersect(need, have)) AS c, len(few) AS n2, len(list_intersect(few, have)) AS c2 FROM w JOIN (SELECT d.* FROM d JOIN b USING (doc_id)) d ON d.source = 'src' || w.item_id % 20)
SELECT item_id, doc_id, round_even(least(1.0, c / (0.55 * n)), 6) AS v1, CASE WHEN n2 = 0 THEN 0 ELSE round_even(least(1.0, c2 / (0.45 * n2)), 6) END AS v2 FROM j""")
def criterion_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria against the newest document of their source."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    newest = d.groupBy("source").agg(F.max("doc_id").alias("doc_id"))
    j = b.select("item_id", F.col("text").alias("want"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source")).join(d.join(newest.select("doc_id"), "doc_id", "left_semi"), "source")
    return j.select("item_id", "doc_id", F.bround(X.coverage(F.col("text"), F.col("want")), 6).alias("v1"), F.bround(X.coverage(F.col("text"), F.col("want"), 0.45, 0.65, X.STEP_STOPWORDS), 6).alias("v2"))


@query(f"""
WITH t AS (SELECT item_id, 'src' || item_id % 20 AS source, {TOKENS} AS need FROM benchmark), d AS (SELECT doc_id, source, {TOKENS} AS have FROM documents),
w AS (SELECT *, list_filter(need, lambda x: NOT list_contains([{STOP}], x)) AS few FROM t),
j AS (SELECT item_id, doc_id, len(need) AS n, len(list_intersect(need, have)) AS c, len(few) AS n2, len(list_intersect(few, have)) AS c2 FROM w JOIN d USING (source))
SELECT item_id, doc_id, round_even(least(1.0, c / (0.55 * n)), 6) AS v1, CASE WHEN n2 = 0 THEN 0 ELSE round_even(least(1.0, c2 / (0.45 * n2)), 6) END AS v2 FROM j""")
def criterion_coverage_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria against every document of their source; a document's tokens are taken once for all its criteria."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    need = b.select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), X.tokens(F.col("text")).alias("need"))
    j = d.select("doc_id", "source", X.tokens(F.col("text")).alias("have")).join(need, "source")
    return j.select("item_id", "doc_id", F.bround(X.token_coverage(F.col("have"), F.col("need")), 6).alias("v1"), F.bround(X.token_coverage(F.col("have"), F.col("need"), 0.45, 0.65, X.STEP_STOPWORDS), 6).alias("v2"))


@query("""
SELECT l_orderkey, l_linenumber, 'number:' || CASE WHEN l_quantity = floor(l_quantity) THEN (l_quantity::BIGINT)::VARCHAR ELSE l_quantity::VARCHAR END || ':kg' AS quantity,
 'date:' || year(l_shipdate) || '-' || month(l_shipdate) || '-' || day(l_shipdate) AS shipped, 'text:' || lower(l_returnflag || ' ' || l_linestatus) AS flags FROM lineitem""")
def value_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X28."""
    li = table(spark, sf_dir, "lineitem")
    q = F.concat(F.expr("format_number(l_quantity, '#,##0.00')"), F.lit(" kg"))
    return li.select("l_orderkey", "l_linenumber", X.value_key(q).alias("quantity"), X.value_key(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("shipped"), X.value_key(F.concat_ws("  ", "l_returnflag", "l_linestatus")).alias("flags"))


# --- reports ------------------------------------------------------------------------------------------------------

#: Steps of a text's normal form, as (pattern, replacement); a private character stands for an address until the end.
NORM_STEPS = [("(?i)https?://[^\\s)\\]}}>\"'']+", " \ue000 "), ("(?i)(?:\\[\\s*(?:\\d+|[ivxlcdm]+)\\s*\\])+|<[^>\\n]+>|[`*_~]+", " "), ("(?m)^\\s{{0,3}}#{{1,6}}\\s*", " "), ("(?m)^\\s*(?:[-+]|\\d+[.)、]|[A-Za-z][.)])\\s+", " "), ("[^0-9A-Za-z一-鿿%\ue000]+", " "), ("\ue000", "<url>")]
NORM = "{0}"
for pattern, to in NORM_STEPS:
    NORM = f"regexp_replace({NORM}, '{pattern}', '{to}', 'g')"
NORM = f"trim(lower({NORM}))"
REPEATS = f"""
sen AS (SELECT doc_id, u FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(regexp_replace(report, '\\s+', ' ', 'g'), '[^.!?。！？]+[.!?。！？]?'), lambda s: {NORM.format('s')})) AS u FROM reports) WHERE length(u) >= 30),
par AS (SELECT doc_id, u FROM (SELECT doc_id, {NORM.format('b')} AS u FROM (SELECT doc_id, unnest(regexp_split_to_array(report, '\\n\\s*\\n+')) AS b FROM reports) WHERE NOT starts_with(b, '## ') AND b <> '') WHERE length(u) >= 40),
tok AS (SELECT doc_id, regexp_extract_all({NORM.format('report')}, '[0-9a-zA-Z%]+|[一-鿿]') AS w FROM reports),
ng AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 22), lambda i: array_to_string(w[i:i + 23], ' '))) AS u FROM tok WHERE len(w) >= 24),
cs AS (SELECT doc_id, sum(c) AS n, count(*) AS k, max(c) AS m FROM (SELECT doc_id, u, count(*) AS c FROM sen GROUP BY ALL) GROUP BY doc_id),
cp AS (SELECT doc_id, sum(c) AS n, count(*) AS k, max(c) AS m FROM (SELECT doc_id, u, count(*) AS c FROM par GROUP BY ALL) GROUP BY doc_id),
cn AS (SELECT doc_id, sum(c) AS n, sum(CASE WHEN c > 3 THEN c - 1 ELSE 0 END) AS x, max(c) AS m FROM (SELECT doc_id, u, count(*) AS c FROM ng GROUP BY ALL) GROUP BY doc_id),
rep AS (SELECT doc_id, coalesce(cp.n, 0)::INT AS n_paragraphs, coalesce((cp.n - cp.k) / cp.n, 0) AS dup_paragraphs, coalesce(cp.m, 0)::INT AS most_paragraph, coalesce(cs.n, 0)::INT AS n_sentences, coalesce((cs.n - cs.k) / cs.n, 0) AS dup_sentences, coalesce(cs.m, 0)::INT AS most_sentence,
 coalesce(cn.x / cn.n, 0) AS dup_ngrams, coalesce(cn.m, 0)::BIGINT AS most_ngram FROM reports LEFT JOIN cs USING (doc_id) LEFT JOIN cp USING (doc_id) LEFT JOIN cn USING (doc_id)),
rp AS (SELECT *, greatest(0.0, least(0.6, 0.65 * dup_paragraphs + 0.15 * dup_sentences + 0.10 * least(most_paragraph / 10.0, 1.0) + 0.06 * least(most_sentence / 25.0, 1.0) + 0.04 * least(dup_ngrams * 2.0, 1.0))) AS penalty,
 dup_paragraphs > 0.25 OR most_paragraph > 5 OR (dup_sentences > 0.35 AND most_sentence > 10) OR (dup_sentences > 0.18 AND most_sentence > 30) OR (dup_ngrams > 0.20 AND most_ngram > 20) AS severe FROM rep)"""


@query(f"""
WITH {REPORTS}, {REPEATS} SELECT doc_id, n_paragraphs, round_even(dup_paragraphs, 6) AS dup_paragraphs, most_paragraph, n_sentences, round_even(dup_sentences, 6) AS dup_sentences, most_sentence, round_even(dup_ngrams, 6) AS dup_ngrams, most_ngram, severe, round_even(penalty, 6) AS penalty FROM rp""")
def report_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, A7, A8, F17, M9, X4, X5, X7."""
    r = reports.repetition(reports_of(spark, sf_dir))
    six = {c: F.bround(c, 6) for c in ("dup_paragraphs", "dup_sentences", "dup_ngrams", "penalty")}
    return r.withColumns(six | {"severe": F.size("severe") > 0, "most_ngram": F.col("most_ngram").cast("long")})


CITES = """
ln AS (SELECT doc_id, unnest(string_split(report, chr(10))) AS line, unnest(range(len(string_split(report, chr(10))))) AS k FROM reports),
rl AS (SELECT *, regexp_matches(line, '^\\s*(?:[-*+]\\s*)?\\[\\d+\\]\\s*(?::|\\s)\\s*.*https?://') AS ref FROM ln),
body AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS body FROM rl WHERE NOT ref GROUP BY doc_id),
map AS (SELECT DISTINCT doc_id, regexp_extract(line, '\\[(\\d+)\\]', 1)::INT AS id, regexp_replace(regexp_extract(line, 'https?://[^\\s)\\]}>"'']+'), '[.,;:!?]+$', '') AS url FROM rl WHERE ref),
mid AS (SELECT doc_id, id, count(*) AS n, any_value(url) AS url FROM map GROUP BY ALL),
cit AS (SELECT doc_id, unnest(regexp_extract_all(body, '\\[(\\d+)\\]', 1))::INT AS id FROM body),
uc AS (SELECT doc_id, id, count(*) AS n FROM cit GROUP BY ALL),
m1 AS (SELECT doc_id, count(*) AS mapping_count, list(id ORDER BY id) FILTER (WHERE n = 1) AS valid_ids, list(DISTINCT url ORDER BY url) FILTER (WHERE n = 1) AS mapped FROM mid GROUP BY doc_id),
u1 AS (SELECT doc_id, sum(n)::INT AS cites, list(id ORDER BY id) AS ids FROM uc GROUP BY doc_id),
cl AS (SELECT doc_id, count(*) AS n_claims, count(*) FILTER (WHERE regexp_matches(s, '\\[\\d+\\]')) AS n_cited FROM (
  SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(regexp_replace(body, '([.!?。！？])\\s*', '\\1' || chr(1), 'g'), chr(1) || '|\\n+')), '^\\s+|\\s+$', '', 'g') AS s FROM body)
  WHERE length(s) >= 40 AND NOT regexp_matches(s, '^(?:#|```|!\\[)') AND NOT regexp_matches(s, '^[-*+|\\s\\d.:]+$') GROUP BY doc_id),
ci AS (SELECT r.doc_id, coalesce(cites, 0) AS cites, coalesce(mapping_count, 0) AS mapping_count, len(list_intersect(coalesce(ids, []), coalesce(valid_ids, []))) AS resolved, len(coalesce(ids, [])) AS uniq, len(coalesce(valid_ids, [])) AS valid,
  coalesce(mapped, []) AS mapped, coalesce(n_claims, 0) AS n_claims, coalesce(n_cited, 0) AS n_cited FROM reports r LEFT JOIN m1 USING (doc_id) LEFT JOIN u1 USING (doc_id) LEFT JOIN cl USING (doc_id)),
cd AS (SELECT *, valid - resolved AS orphans, uniq - resolved AS unresolved, (valid - resolved) / greatest(1, valid) AS orphan_ratio, resolved / greatest(1, uniq) AS integrity, n_cited / greatest(1, n_claims) AS claim_coverage FROM ci)"""


@query(f"""
WITH {REPORTS}, {CITES} SELECT doc_id, cites, mapping_count::INT AS mapping_count, valid::INT AS n_valid, resolved::INT AS n_resolved, unresolved::INT AS n_unresolved, orphans::INT AS n_orphans, len(mapped)::INT AS n_mapped, round_even(integrity, 6) AS integrity, n_claims::INT AS n_claims, n_cited::INT AS n_cited FROM cd""")
def report_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, J9, U4, X26."""
    c = reports.citations(reports_of(spark, sf_dir))
    n = {"n_valid": "valid_ids", "n_resolved": "resolved_ids", "n_unresolved": "unresolved_ids", "n_orphans": "orphan_ids", "n_mapped": "mapped_urls"}
    return c.select("doc_id", F.col("cit.count").alias("cites"), "cit.mapping_count", *[F.size(f"cit.{v}").alias(k) for k, v in n.items()], F.bround("cit.integrity", 6).alias("integrity"), "cit.n_claims", "cit.n_cited")


def _cnt(p: str, t: str = "report") -> str:
    return f"len(regexp_extract_all({t}, '{p}'))"


BAD = "len(list_filter({0}, lambda u: contains(lower(u), 'example.com') OR contains(lower(u), 'placeholder') OR contains(lower(u), 'localhost') OR contains(lower(u), 'todo')))"


@query()
def report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against a plain version, since look-behind has no place in the oracle's dialect."""
    s = reports.score_reports(reports_of(spark, sf_dir), YEAR)
    return s.select("doc_id", *[F.bround(c, 6).alias(c) for c in (*reports.WEIGHTS, "penalty", "raw_reward", "final_reward")], "gates", "reward_cap")


GATES = f"""
g AS (SELECT r.doc_id, list_sort(list_distinct(list_filter([
 CASE WHEN length(regexp_replace(report, '^\\s+|\\s+$', '', 'g')) < 100 OR regexp_matches(report, '(?i)traceback|exception|tool crashed|error executing') THEN 'empty_or_crashed' END,
 CASE WHEN (len(us) > 0 AND {BAD.format('us')} >= greatest(2, ceil(len(us) * 0.5))) OR len(list_filter(regexp_extract_all(report, '\\b(20[2-9][0-9]|21[0-9]{{2}})\\b'), lambda y: y::INT > {YEAR} + 1)) >= 3 OR (cites >= 40 AND mapping_count >= 6 AND integrity < 0.20) OR (cites >= 80 AND claim_coverage < 0.08) OR (mapping_count >= 8 AND orphan_ratio >= 0.60)
   OR (len(mapped) >= 4 AND len(list_intersect(mapped, evidence_urls)) / len(mapped) < 0.25) OR source = 'src1' THEN 'fabricated_source_data' END,
 CASE WHEN (lang = 'de' AND length(regexp_replace(report, '^\\s+|\\s+$', '', 'g')) > 1200) OR (lang = 'en' AND NOT regexp_matches(report, '(?m)^\\s*\\|.+\\|\\s*$')) THEN 'format_instruction_fail' END,
 CASE WHEN severe THEN 'repetition_collapse' END], lambda x: x IS NOT NULL))) AS gates
 FROM (SELECT *, regexp_extract_all(report, 'https?://[^\\s)\\]}}>"'']+') AS us FROM reports) r JOIN cd USING (doc_id) JOIN rp USING (doc_id))"""


@query(f"""
WITH {REPORTS}, {REPEATS}, {CITES}, {GATES} SELECT doc_id, array_to_string(gates, ',') AS gates, CASE WHEN list_contains(gates, 'empty_or_crashed') THEN 0.05 WHEN list_contains(gates, 'fabricated_source_data') THEN 0.20 WHEN list_contains(gates, 'repetition_collapse') THEN 0.25 WHEN list_contains(gates, 'format_instruction_fail') THEN 0.35 ELSE 1.0 END::DOUBLE AS reward_cap FROM g""")
def report_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10, C17, X20."""
    s = reports.score_reports(reports_of(spark, sf_dir), YEAR)
    return s.select("doc_id", F.array_join("gates", ",").alias("gates"), "reward_cap")


@query(f"""
WITH {REPORTS}, {REPEATS}, {CITES}, {GATES} SELECT tag, count(*) AS n FROM (SELECT unnest(gates) AS tag FROM g) GROUP BY tag""")
def audit_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return audit.frequencies(reports.score_reports(reports_of(spark, sf_dir), YEAR))


@query()
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return audit.summary(reports.score_reports(reports_of(spark, sf_dir), YEAR))


@query(f"""
WITH {REPORTS}, {CITES} SELECT printf('%.1f', floor(integrity * 10) / 10) AS bin, count(*) AS n FROM cd GROUP BY ALL""")
def audit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    c = reports.citations(reports_of(spark, sf_dir))
    return audit.histogram(c.select(F.col("cit.integrity").alias("x")), "x")


@query("""
WITH v AS (SELECT length(text)::INT AS v FROM documents), n AS (SELECT count(*) AS n FROM v), s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM v)
SELECT '50' AS p, v AS value FROM s, n WHERE i = round_even((n - 1) * 0.5, 0) UNION ALL SELECT '90', v FROM s, n WHERE i = round_even((n - 1) * 0.9, 0) UNION ALL SELECT '99', v FROM s, n WHERE i = round_even((n - 1) * 0.99, 0)""")
def audit_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    x = table(spark, sf_dir, "documents").select(F.length("text").alias("v"))
    return audit.percentiles(x, "v", [0.5, 0.9, 0.99]).select((F.col("p") * 100).cast("int").cast("string").alias("p"), "value")


@query("SELECT min(length(text))::INT AS low, max(length(text))::INT AS high, round_even(avg(length(text)), 2) AS mean FROM documents")
def audit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return audit.lengths(table(spark, sf_dir, "documents").select(F.length("text").alias("n")), "n")


@query(f"""
WITH {REPORTS}, u AS (SELECT doc_id, unnest(regexp_extract_all(report, 'https?://[^\\s)\\]}}>"'']+')) AS url, unnest(range(len(regexp_extract_all(report, 'https?://[^\\s)\\]}}>"'']+')))) AS pos FROM reports),
f AS (SELECT doc_id, url, min(pos) AS pos FROM u GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS number, url FROM f""")
def report_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8, X1."""
    return reports.registry(reports_of(spark, sf_dir))


HEADS = """
l AS (SELECT doc_id, unnest(string_split(report, chr(10))) AS line, unnest(range(len(string_split(report, chr(10))))) AS ln FROM reports),
h AS (SELECT doc_id, ln::INT AS ln, length(regexp_extract(line, '^(#+)', 1))::INT AS level, regexp_replace(lower(regexp_replace(line, '^#+\\s+', '')), '[^0-9a-z一-鿿]+', '', 'g') AS key FROM l WHERE regexp_matches(line, '^#{1,6}\\s+\\S'))"""


@query(f"WITH {REPORTS}, {HEADS} SELECT doc_id, ln, level, key, last_value(CASE WHEN level = 2 THEN key END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln) AS parent FROM h")
def report_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8, W10, X11."""
    return reports.headings(reports_of(spark, sf_dir)).select("doc_id", "ln", "level", "key", "parent")


@query(f"WITH {REPORTS}, {HEADS} SELECT doc_id, key, count(*) AS n FROM h GROUP BY ALL HAVING count(*) >= 2")
def report_repeated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, C20."""
    return reports.repeated_headings(reports_of(spark, sf_dir), 2)


@query("""
SELECT doc_id, CASE WHEN source = 'src1' THEN 'fabricated_source_data' ELSE '' END AS tags, CASE WHEN source = 'src1' THEN 0.2 ELSE 1.0 END::DOUBLE AS cap, source IN ('src1', 'src2') AS positive, source = 'src1' AS failed FROM documents""")
def judge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17."""
    r = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src1", "excellent, but the data look fabricated").when(F.col("source") == "src2", "accurate").otherwise("").alias("j"))
    c = reports.classify_reason(F.col("j"))
    return r.select("doc_id", F.array_join(c["tags"], ",").alias("tags"), c["cap"].alias("cap"), c["positive"].alias("positive"), c["failed"].alias("failed"))


@query("""
WITH c AS (SELECT l_orderkey AS claim_id, l_linenumber, 'p' || l_partkey AS s, l_quantity AS v, ['o' || l_suppkey] AS cited FROM lineitem WHERE l_linenumber = 1),
f AS (SELECT 'o' || (p_partkey % 10 + 1) AS source, 'p' || p_partkey AS s, p_size AS w, p_size > 25 AS exclusive FROM part),
j AS (SELECT claim_id, max((list_contains(cited, source) AND v = w)::INT) AS yes, max((list_contains(cited, source) AND v <> w AND exclusive)::INT) AS no, max((NOT list_contains(cited, source) AND v = w)::INT) AS other FROM c JOIN f USING (s) GROUP BY claim_id)
SELECT claim_id, CASE WHEN yes = 1 THEN 'supported' WHEN no = 1 THEN 'contradicted' WHEN other = 1 THEN 'wrong_source' ELSE 'unknown' END AS status FROM c LEFT JOIN j USING (claim_id)""")
def claim_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, X28, A20."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    claims = li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("claim_id"), F.concat(F.lit(" P"), F.col("l_partkey").cast("string")).alias("subject"), F.lit("Size").alias("field"), F.expr("format_number(l_quantity, '0.0')").alias("value"), F.array(F.concat(F.lit("o"), F.col("l_suppkey").cast("string"))).alias("cited"))
    facts = p.select(F.concat(F.lit("o"), (F.col("p_partkey") % 10 + 1).cast("string")).alias("source"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("subject"), F.lit("size ").alias("field"), F.col("p_size").cast("string").alias("value"), (F.col("p_size") > 25).alias("exclusive"))
    return reports.claim_status(claims, facts)


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'p' || l_partkey AS s, l_quantity AS v, ['o' || l_suppkey] AS cited FROM lineitem),
f AS (SELECT 'o' || (p_partkey % 10 + 1) AS source, 'p' || p_partkey AS s, p_size AS w, p_size > 25 AS exclusive FROM part),
j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v, max((list_contains(cited, source) AND v = w)::INT) AS yes, max((list_contains(cited, source) AND v <> w AND exclusive)::INT) AS no, max((NOT list_contains(cited, source) AND v = w)::INT) AS other FROM c JOIN f USING (s) GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v AS l_quantity, CASE WHEN yes = 1 THEN 'supported' WHEN no = 1 THEN 'contradicted' WHEN other = 1 THEN 'wrong_source' ELSE 'unknown' END AS status FROM c LEFT JOIN j USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, v)""")
def claim_statuses_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every order is a claim. Lines share order and number, so what is claimed is part of the id."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    claims = li.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("claim_id"), F.concat(F.lit(" P"), F.col("l_partkey").cast("string")).alias("subject"), F.lit("Size").alias("field"), F.expr("format_number(l_quantity, '0.0')").alias("value"), F.array(F.concat(F.lit("o"), F.col("l_suppkey").cast("string"))).alias("cited"))
    facts = p.select(F.concat(F.lit("o"), (F.col("p_partkey") % 10 + 1).cast("string")).alias("source"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("subject"), F.lit("size ").alias("field"), F.col("p_size").cast("string").alias("value"), (F.col("p_size") > 25).alias("exclusive"))
    return reports.claim_status(claims, facts).select("claim_id.*", "status")


@query()
def report_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubrics of benchmark items, one for each source."""
    b = table(spark, sf_dir, "benchmark")
    dims = F.element_at(F.array(*[F.lit(d) for d in reports.DIMENSIONS]), (F.col("item_id") % 5 + 1).cast("int"))
    crit = b.select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("rubric_id"), dims.alias("dim"), (F.col("item_id") % 3).cast("double").alias("weight"), F.col("text").alias("criterion"), F.when(F.col("item_id") % 2 == 0, "content").otherwise("claim_with_citation").alias("evaluation"))
    r = reports.citations(reports_of(spark, sf_dir)).withColumn("rubric_id", F.col("source"))
    return reports.rubric_scores(r, crit).select("doc_id", F.bround("rubric", 6).alias("rubric"))


# --- mixing -------------------------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, lang, source FROM d WHERE rn = 1""")
def mix_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, D3, D10."""
    return mix.first_of(table(spark, sf_dir, "documents"), [F.sha2("text", 256)], ["doc_id"]).select("doc_id", "lang", "source")


@query("""
WITH n AS (SELECT count(*) FILTER (WHERE lang = 'en') AS p FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents WHERE lang <> 'en')
SELECT doc_id FROM r, n WHERE k <= greatest(1, round_even(p * 0.2 / 0.8, 0))""")
def mix_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O9, O11, M5."""
    d = table(spark, sf_dir, "documents")
    n = mix.replay_count(d.where("lang = 'en'").count(), 0.2)
    return mix.pick(d.where("lang <> 'en'").select("doc_id"), n, 7, "doc_id")


@query("""
WITH n AS (SELECT greatest(1, floor(count(*) * 0.05)) AS v FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, k <= v AS val FROM r, n""")
def mix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10."""
    return mix.split(table(spark, sf_dir, "documents").select("doc_id"), 0.05, 3, "doc_id")


@query("""
SELECT d.doc_id, unnest(range(CASE WHEN l.toxic = 1 THEN 3 WHEN l.quality = 1 THEN 2 ELSE 1 END))::INT AS repeat_index FROM documents d LEFT JOIN labels l USING (doc_id)""")
def mix_oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O13, J8."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    times = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 1, 2).otherwise(1)
    return mix.repeated(d.select("doc_id", "toxic", "quality"), times).select("doc_id", "repeat_index")


@query("SELECT count(*) FILTER (WHERE lang = 'en') AS n_primary, count(*) FILTER (WHERE lang <> 'en') AS n_replay, count(*) AS n_total, round_even(count(*) FILTER (WHERE lang <> 'en') / count(*), 6) AS achieved FROM documents")
def mix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "primary").otherwise("replay").alias("kind"))
    return mix.stats(d, "kind")


@query("SELECT doc_id FROM documents WHERE source LIKE 'src1%' OR source = 'src5'")
def mix_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    return table(spark, sf_dir, "documents").where(mix.allowed(F.col("source"), ["src1*", "src5"])).select("doc_id")


@query("""
WITH u AS (SELECT 0 AS s, p_partkey AS k FROM part UNION ALL SELECT 1, s_suppkey FROM supplier UNION ALL SELECT 2, c_custkey FROM customer) SELECT s AS source_no, k, row_number() OVER (ORDER BY s, k) - 1 AS idx FROM u""")
def mix_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U2, U5."""
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"))]
    return mix.renumbered(parts, ["k"]).select("source_no", "k", "idx")


@query("SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, count(*) AS n, arg_min(url, page_id) AS url, md5(string_agg(url, chr(10) ORDER BY page_id)) AS merged FROM pages GROUP BY ALL")
def search_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", "page_id").alias("url"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]), "\n")).alias("merged"))


# --- plans and events ---------------------------------------------------------------------------------------------


def plan_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Two tasks a core, and never more than some 1,250,000 lines a task."""
    return max(2 * spark.sparkContext.defaultParallelism, table(spark, sf_dir, "lineitem").count() // 1_250_000 + 1)


def steps_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "completed").when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "F", "completed").otherwise("blocked")).otherwise(F.when(F.col("l_quantity") > 40, "in_progress").otherwise("not_started"))
    lines = li.select(F.col("l_orderkey").alias("plan_id"), (F.col("l_linenumber") - 1).alias("idx"), "l_partkey", status.alias("status"))
    # shuffled before the least line is sought: else tasks that read sort all they have read
    one = lines.repartition(plan_tasks(spark, sf_dir), "plan_id", "idx").groupBy("plan_id", "idx").agg(F.min(F.struct("l_partkey", "status")).alias("x"))
    steps = one.select("plan_id", "idx", "x.status", F.col("x.l_partkey").alias("part"))
    before = F.when(F.col("part") % 3 == 0, F.array(F.col("idx") - 1, F.greatest(F.lit(0), F.col("idx") - 2))).otherwise(F.array(F.col("idx") - 1))
    d = steps.select("plan_id", "idx", F.explode(F.when(F.col("idx") > 0, before)).alias("dep"))
    return steps.select("plan_id", "idx", "status"), d.distinct()


STEPS = """
s0 AS (SELECT l_orderkey AS plan_id, l_linenumber - 1 AS idx, min({'a': l_partkey, 'b': CASE WHEN l_returnflag = 'R' THEN 'completed' WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'blocked' END WHEN l_quantity > 40 THEN 'in_progress' ELSE 'not_started' END}) AS x FROM lineitem GROUP BY ALL),
steps AS (SELECT plan_id, idx, x.b AS status, x.a AS part FROM s0),
deps AS (SELECT plan_id, idx, idx - 1 AS dep FROM steps WHERE idx > 0 UNION SELECT plan_id, idx, greatest(0, idx - 2) FROM steps WHERE idx > 0 AND part % 3 = 0)"""


@query(f"""
WITH {STEPS} SELECT plan_id, idx FROM steps s WHERE status = 'not_started' AND NOT EXISTS (SELECT 1 FROM deps d LEFT JOIN steps t ON t.plan_id = d.plan_id AND t.idx = d.dep WHERE d.plan_id = s.plan_id AND d.idx = s.idx AND coalesce(t.status, '') <> 'completed')""")
def plan_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, T6."""
    return dag.ready(*steps_of(spark, sf_dir), plan_tasks(spark, sf_dir))


@query(f"""
WITH {STEPS} SELECT plan_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'not_started') AS not_started FROM steps GROUP BY plan_id""")
def plan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return dag.progress(steps_of(spark, sf_dir)[0])


@query(f"""
WITH RECURSIVE {STEPS}, c AS (SELECT plan_id, idx, dep FROM deps UNION SELECT c.plan_id, c.idx, d.dep FROM c JOIN deps d ON d.plan_id = c.plan_id AND d.idx = c.dep) SELECT plan_id, idx, dep FROM c""")
def plan_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16."""
    return dag.closure(steps_of(spark, sf_dir)[1])


@query(f"WITH {STEPS} SELECT plan_id, idx, dep FROM deps")
def plan_zero_based(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the same dependencies given from 1."""
    s, d = steps_of(spark, sf_dir)
    return dag.zero_based(d.select("plan_id", (F.col("idx") + 1).alias("idx"), (F.col("dep") + 1).alias("dep")), s.join(d.groupBy("plan_id").agg((F.max("idx") + 1).alias("n")), "plan_id").where("idx < n")).select("plan_id", F.col("idx").cast("int").alias("idx"), F.col("dep").cast("int").alias("dep"))


@query("SELECT user_id AS plan_id, max((event_type = 'signup')::INT) AS created, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'view') AS searches, max((event_type = 'click')::INT) AS submitted, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL")
def rollout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    return dag.rollout_metrics(table(spark, sf_dir, "events").withColumnRenamed("user_id", "plan_id"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE event_type IS DISTINCT FROM prev")
def events_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, M10."""
    return streaming.changed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    return streaming.once(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id")


@query("SELECT e.event_id FROM events e LEFT JOIN (SELECT user_id, min(ts) AS done FROM events WHERE event_type = 'purchase' GROUP BY ALL) d USING (user_id) WHERE d.done IS NULL OR e.ts <= d.done + INTERVAL 180 SECOND")
def events_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4's window, by event time."""
    return streaming.tail_window(table(spark, sf_dir, "events"), "purchase").select("event_id")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.stream_of(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


def _sink(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type, md5(event_type) AS fp FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE event_type IS DISTINCT FROM prev")
def stream_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2, T5 by Structured Streaming."""
    return streaming.run_to_end(streaming.changed_stream(_stream(spark, sf_dir)), _sink(spark))


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 by Structured Streaming; the state spans the whole input."""
    s = streaming.once_stream(_stream(spark, sf_dir), ["user_id", "event_type"], "3650 days")
    return streaming.run_to_end(s.select("user_id", "event_type"), _sink(spark))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT user_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 4) AS click, round(coalesce(sum(value) FILTER (WHERE event_type = 'error'), 0), 4) AS error, round(coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0), 4) AS view FROM events GROUP BY user_id")
def chart_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, M3."""
    e = table(spark, sf_dir, "events")
    p = e.groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.sum("value"))
    return p.select("user_id", *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("click", "error", "view")])
