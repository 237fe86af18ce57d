"""More queries of the registry: single records, claims, workflow modes, closures. Their SQL is written from what they are to
compute, not from the operators' code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import records, traces
from tessera.queries import MESSAGES, messages_of, query, table

RAW = """raw AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"q": ' || n_chars || '}' WHEN 1 THEN '[1, "' || source || '"]' WHEN 2 THEN '{"q": ' || source END AS raw FROM documents)"""


def raw_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('{"q": '), F.col("n_chars").cast("string"), F.lit("}"))).when(k == 1, F.concat(F.lit('[1, "'), "source", F.lit('"]'))).when(k == 2, F.concat(F.lit('{"q": '), "source"))
    return d.select("doc_id", raw.alias("raw"))


@query(f"""WITH {RAW} SELECT doc_id, raw IS NULL OR json_valid(raw) AS parsed, coalesce(raw, '{{}}') AS value, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS properties FROM raw""")
def arguments_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, M11."""
    a = records.arguments(F.col("raw"))
    return raw_of(spark, sf_dir).select("doc_id", a["parsed"].alias("parsed"), a["value"].alias("value"), records.properties(F.col("raw")).alias("properties"))


@query("""
SELECT page_id AS id, 'page' AS source_type, CASE WHEN page_id % 3 = 0 THEN url ELSE 'dir/f' || page_id END AS source_ref, CASE WHEN page_id % 5 = 0 THEN 'T' || page_id WHEN page_id % 3 = 0 THEN 'local evidence' ELSE 'dir/f' || page_id END AS title,
       coalesce(url, '') AS urls, trim(substr(html, 1, 40), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages""")
def evidence_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, M12."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    x = p.select(i.alias("id"), F.lit("page").alias("source_type"), F.lit(None).cast("string").alias("source_ref"), F.when(i % 3 != 0, F.concat(F.lit("dir/f"), i.cast("string"))).otherwise("").alias("path"), "url", F.when(i % 5 == 0, F.concat(F.lit("T"), i.cast("string"))).alias("title"), F.array("url", F.lit("")).alias("urls"), F.lit("").alias("text"), F.substring("html", 1, 40).alias("content"))
    return records.evidence_item(x).withColumn("urls", F.array_join("urls", " "))


@query("""
SELECT doc_id, CASE WHEN lang = 'en' THEN 'Planner' ELSE 'Actor' END AS role, 1.0 / greatest(doc_id % 7, 1) AS rank_score, len(regexp_extract_all(text, '[A-Z][a-z]+ly')) AS found, replace(text, 'the ', 'THE ') AS replaced FROM documents""")
def record_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17, M7, X22."""
    path = F.concat(F.lit("planner/run_"), F.when(F.col("lang") == "en", "MyPlanner").otherwise("acting"), F.lit(".jsonl"))
    return table(spark, sf_dir, "documents").select("doc_id", records.role_of(path).alias("role"), records.rank_score(F.col("doc_id") % 7).alias("rank_score"), F.size(records.find_in_content(F.col("text"), "[A-Z][a-z]+ly")).alias("found"), records.str_replace(F.col("text"), "the ", "THE ").alias("replaced"))


@query("""
WITH f AS (SELECT source AS task_id, doc_id, n_chars, CASE lang WHEN 'en' THEN 'Final_Report_' WHEN 'de' THEN '分析_20240102_030405_' WHEN 'fr' THEN 'step_' ELSE 'evidence_report_' END || doc_id || '.md' AS name FROM documents WHERE n_chars >= 300),
s AS (SELECT *, least(50.0, n_chars / 2000.0) + CASE WHEN name LIKE 'Final%' THEN 8 WHEN name LIKE '分析%' THEN 12 WHEN name LIKE 'step%' THEN -6 ELSE 2 END AS score FROM f)
SELECT task_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, doc_id % 100 DESC, name DESC) AS k FROM s) WHERE k = 1""")
def best_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O7."""
    name = F.when(F.col("lang") == "en", "Final_Report_").when(F.col("lang") == "de", "分析_20240102_030405_").when(F.col("lang") == "fr", "step_").otherwise("evidence_report_")
    x = table(spark, sf_dir, "documents").select(F.col("source").alias("task_id"), F.concat(name, F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), "n_chars", (F.col("doc_id") % 100).alias("mtime"))
    return records.best_reports(x, 300)


@query("""
SELECT doc_id, n_chars AS final_reward, n_chars AS score, n_chars AS capped_score, quality AS R_workflow, quality AS workflow, toxic AS P_repeat, toxic AS P_repeat_soft, toxic AS repetition_penalty
FROM documents JOIN labels USING (doc_id) WHERE coalesce(n_chars / 10000.0, 0) >= 0.4""")
def reward_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21, F11."""
    x = table(spark, sf_dir, "documents").withColumn("score", F.col("n_chars") / 10000.0)
    x = records.relevant(x, 0.4).join(table(spark, sf_dir, "labels"), "doc_id")
    return records.with_aliases(x.select("doc_id", F.col("n_chars").alias("final_reward"), F.col("quality").alias("R_workflow"), F.col("toxic").alias("P_repeat")))


@query("""
WITH m AS (SELECT page_id % 97 AS doc_id, page_id AS pos, CASE page_id % 3 WHEN 0 THEN url || ').' WHEN 1 THEN url || '/a.PNG' ELSE url END AS url FROM pages),
c AS (SELECT doc_id, pos, rtrim(trim(coalesce(url, '')), '.,;:!?)]}"''') AS url FROM m),
k AS (SELECT doc_id, url, min(pos) AS pos FROM c WHERE regexp_matches(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]') AND NOT regexp_matches(lower(url), '[.](png|jpg|jpeg|gif|webp|svg|css|js)$') GROUP BY doc_id, url)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS number, url FROM k""")
def references_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8, F8."""
    i = F.col("page_id")
    url = F.when(i % 3 == 0, F.concat("url", F.lit(").")) ).when(i % 3 == 1, F.concat("url", F.lit("/a.PNG"))).otherwise(F.col("url"))
    return records.reference_registry(table(spark, sf_dir, "pages").select((i % 97).alias("doc_id"), i.alias("pos"), url.alias("url")))


@query("""
WITH r AS (SELECT coalesce(url, '') AS url, page_id AS ord, 't' || page_id AS title, substr(coalesce(html, ''), 1, 20) AS summ FROM pages UNION ALL SELECT coalesce(url, ''), page_id + 1000000, 'late', 's' || page_id % 5 FROM pages)
SELECT url, arg_min(title, ord) AS title, string_agg(summ, chr(10) ORDER BY ord) AS summ FROM r GROUP BY url""")
def search_merged_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    p, u = table(spark, sf_dir, "pages"), F.coalesce("url", F.lit("")).alias("url")
    x = p.select(u, F.col("page_id").alias("ord"), F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), F.substring(F.coalesce("html", F.lit("")), 1, 20).alias("summ"))
    late = p.select(u, (F.col("page_id") + 1000000).alias("ord"), F.lit("late").alias("title"), F.concat(F.lit("s"), (F.col("page_id") % 5).cast("string")).alias("summ"))
    return records.merged_by_url(x.union(late))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'p' || l_partkey AS s, l_quantity AS v, l_linenumber % 3 <> 0 AS polarity,
  CASE l_linenumber WHEN 1 THEN [] WHEN 2 THEN ['nobody'] WHEN 3 THEN ['a' || l_suppkey % 3, 'b'] WHEN 4 THEN ['a0', 'a1', 'a2'] ELSE ['b', 'nobody'] END AS cited FROM lineitem),
f AS (SELECT 'a' || p_partkey % 3 AS source, 'p' || p_partkey AS s, p_size AS w, p_size > 25 AS exclusive FROM part
  UNION SELECT 'b', 'p' || p_partkey, p_size + p_partkey % 2, p_size % 2 = 0 FROM part WHERE p_partkey % 4 <> 0),
o AS (SELECT c.*, CASE WHEN len(cited) = 0 THEN 'no_citation'
  WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.s = c.s AND list_contains(c.cited, f.source)) THEN
    CASE WHEN NOT list_has_any(cited, ['a0', 'a1', 'a2', 'b']) THEN 'source_not_indexed' WHEN EXISTS (SELECT 1 FROM f WHERE f.s = c.s) THEN 'wrong_source' ELSE 'insufficient_evidence' END
  ELSE (SELECT CASE WHEN bool_or(fit = pol) AND bool_or(fit <> pol) THEN 'conflicting_evidence' WHEN bool_or(fit <> pol) THEN 'contradicted' WHEN bool_or(fit = pol) THEN 'supported' ELSE 'insufficient_evidence' END
    FROM (SELECT CASE WHEN f.w = c.v THEN true WHEN f.exclusive THEN false END AS fit, c.polarity AS pol FROM f WHERE f.s = c.s AND list_contains(c.cited, f.source))) END AS outcome FROM c)
SELECT l_linenumber, outcome, count(*) AS n, sum(l_orderkey) AS keys FROM o GROUP BY ALL""")
def claim_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven outcomes of every line, counted, with a sum of the lines' orders."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    n, one = F.col("l_linenumber"), lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    cited = F.when(n == 1, F.array().cast("array<string>")).when(n == 2, one("nobody")).when(n == 3, one(F.concat(F.lit("a"), (F.col("l_suppkey") % 3).cast("string")), "b")).when(n == 4, one("a0", "a1", "a2")).otherwise(one("b", "nobody"))
    claims = li.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("claim_id"), F.concat(F.lit(" P"), F.col("l_partkey").cast("string")).alias("subject"), F.lit("Size").alias("field"), F.expr("format_number(l_quantity, '0.0')").alias("value"), cited.alias("cited"), (n % 3 != 0).alias("polarity"))
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("subject")
    facts = p.select(F.concat(F.lit("a"), (F.col("p_partkey") % 3).cast("string")).alias("source"), key, F.lit("size ").alias("field"), F.col("p_size").cast("string").alias("value"), (F.col("p_size") > 25).alias("exclusive"))
    more = p.where("p_partkey % 4 <> 0").select(F.lit("b").alias("source"), key, F.lit("size ").alias("field"), (F.col("p_size") + F.col("p_partkey") % 2).cast("string").alias("value"), (F.col("p_size") % 2 == 0).alias("exclusive"))
    out = records.claim_outcomes(claims, facts.union(more))
    return out.groupBy(F.col("claim_id.l_linenumber").alias("l_linenumber"), "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("claim_id.l_orderkey").alias("keys"))


NAMES = "CASE tool_name WHEN 'search' THEN 'serper_search' WHEN 'extract' THEN 'ask_question_about_image' WHEN 'chart' THEN 'mark_step' WHEN 'write' THEN 'file_saver' END"


@query(f"""
WITH {MESSAGES}, m AS (SELECT conv_id, turn, role, {NAMES} AS tool, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM messages),
t AS (SELECT * FROM m WHERE role = 'assistant' AND tool IS NOT NULL),
r AS (SELECT t.conv_id, t.turn, t.tool, list(p.tool) FILTER (p.tool IS NOT NULL AND p.role IN ('assistant', 'tool')) AS recent FROM t LEFT JOIN m p ON p.conv_id = t.conv_id AND p.i < t.i AND p.i >= t.i - 4 GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN tool = 'file_saver' AND list_contains(recent, 'ask_question_about_image') THEN 'workflow_image_to_file_saver' WHEN tool = 'file_saver' AND list_contains(recent, 'serper_search') THEN 'workflow_research_to_file_saver'
  WHEN tool = 'file_saver' THEN 'workflow_file_saver' WHEN tool = 'mark_step' AND list_contains(recent, 'file_saver') THEN 'workflow_mark_after_save_or_report' ELSE '' END AS mode,
  CASE WHEN tool = 'file_saver' THEN 4 WHEN tool = 'mark_step' AND list_contains(recent, 'file_saver') THEN 2 ELSE 1 END AS weight FROM r""")
def workflow_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    names = F.create_map(*[F.lit(x) for kv in (("search", "serper_search"), ("extract", "ask_question_about_image"), ("chart", "mark_step"), ("write", "file_saver")) for x in kv])
    m = messages_of(spark, sf_dir).withColumn("tool_name", names[F.col("tool_name")])
    return traces.workflow_modes(m, 4, {"file_saver": 4, "report": 3, "mark_step": 2})


@query(f"""
WITH {MESSAGES}, m AS (SELECT conv_id, turn, role, tool_name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM messages),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM m WHERE i < n AND role IN ('assistant', 'tool') AND tool_name IN ('search', 'write')),
x AS (SELECT conv_id, i FROM h WHERE k <= 2 UNION SELECT h.conv_id, p.i FROM h JOIN m p ON p.conv_id = h.conv_id AND h.k <= 2 AND (h.role = 'tool' AND p.i = h.i - 1 AND p.role = 'assistant' OR h.role = 'assistant' AND p.i = h.i + 1 AND p.role = 'tool' AND p.i < h.n))
SELECT m.conv_id, m.turn FROM x JOIN m USING (conv_id, i)""")
def recent_tool_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before the last message."""
    return traces.recent_tool_pairs(messages_of(spark, sf_dir), ["search", "write"])


@query("""
WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '[一-鿿]') THEN 'zh'
  WHEN regexp_matches(t, '[äöüß]') OR regexp_matches(' ' || regexp_replace(t, '[^a-z0-9_À-ÿ]+', ' ', 'g') || ' ', ' (der|die|das|und|mit|für|bewerte|bericht|deutsch) ') THEN 'de'
  WHEN regexp_matches(t, '[éèêëàâçîïôùûüÿœ]') OR regexp_matches(' ' || regexp_replace(t, '[^a-z0-9_À-ÿ]+', ' ', 'g') || ' ', ' (le|la|les|des|avec|pour|rapport|évaluer|français) ') THEN 'fr'
  WHEN regexp_matches(t, '[áéíóúñ¿¡]') OR regexp_matches(' ' || regexp_replace(t, '[^a-z0-9_À-ÿ]+', ' ', 'g') || ' ', ' (el|la|los|las|con|para|informe|evaluar|español) ') THEN 'es' ELSE 'en' END AS language,
  CASE WHEN length(text) <= 200 THEN text ELSE rtrim(substr(text, 1, 120), ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) || '[... ' || (length(text) - 200) || ' chars omitted from content ...]' || chr(10) || chr(10) || ltrim(substr(text, length(text) - 79), ' ' || chr(9) || chr(10) || chr(13)) END AS cut
FROM l JOIN documents USING (doc_id)""")
def report_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10 (a report's language), P7."""
    return table(spark, sf_dir, "documents").select("doc_id", X.report_language(F.col("text")).alias("language"), X.head_and_tail(F.col("text"), 200).alias("cut"))
