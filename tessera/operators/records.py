"""Single records: arguments, properties, evidence items, aliases, candidates' scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

#: A reward's columns under the names that older readers know.
REWARD_ALIASES = [
    ("score", "final_reward"),
    ("capped_score", "final_reward"),
    ("cap", "reward_cap"),
    ("cap_reasons", "hard_gate_reasons"),
    ("visual_grounding", "R_visual_grounding"),
    ("evidence_factuality", "R_evidence_factuality"),
    ("task_following", "R_task_following"),
    ("quantitative_reasoning", "R_quantitative_reasoning"),
    ("report_quality", "R_report_quality"),
    ("workflow", "R_workflow"),
    ("cost_penalty", "P_cost"),
    ("P_invalid_tool", "P_invalid"),
    ("P_repeat_soft", "P_repeat"),
    ("invalid_tool_penalty", "P_invalid"),
    ("repetition_penalty", "P_repeat"),
    ("repetition", "repetition_metrics"),
]
#: What a report's file name says, and what it adds.
NAME_SCORES = [
    (r"report|报告|analysis|研究|分析", 8.0),
    (r"\d{8}_\d{6}", 4.0),
    (r"image_analysis|evidence|sources|检索|证据|线索|step", -6.0),
]
#: What a URL that is no reference ends with, and marks that don't belong to a URL's end.
ASSETS = r"(?i)\.(?:png|jpg|jpeg|gif|webp|svg|css|js)$"
URL_TAIL = r"""[.,;:!?，。；：！？)\]）}"']+$"""


def arguments(raw: Column) -> Column:
    """struct(parsed, value): value is the raw text, {} for null; parsed says whether it is JSON."""
    return F.struct((raw.isNull() | F.try_parse_json(raw).isNotNull()).alias("parsed"), F.coalesce(raw, F.lit("{}")).alias("value"))


def properties(raw: Column) -> Column:
    """The raw text if it is JSON, else {}."""
    return F.when(F.try_parse_json(raw).isNotNull(), raw).otherwise("{}")


def filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty; null if there is none."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def evidence_item(items: DataFrame) -> DataFrame:
    """Id, source_type, source_ref, title, urls, text of raw items (id, source_type, source_ref, path, url, title, urls, text,
    content)."""
    c = F.col
    urls = F.filter(F.coalesce(c("urls"), F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != ""))
    return items.select("id", "source_type", filled(c("source_ref"), c("path"), c("url")).alias("source_ref"), F.coalesce(filled(c("title"), c("source_ref"), c("path")), F.lit("local evidence")).alias("title"), urls.alias("urls"), X.strip(F.coalesce(filled(c("text"), c("content")), F.lit(""))).alias("text"))


def role_of(path: Column) -> Column:
    """Planner if the file's name says so, else Actor."""
    return F.when(F.contains(F.lower(F.substring_index(path, "/", -1)), F.lit("planner")), "Planner").otherwise("Actor")


def with_aliases(rewards: DataFrame) -> DataFrame:
    """Rewards with the older names besides."""
    return rewards.withColumns({new: F.col(old) for new, old in REWARD_ALIASES if old in rewards.columns})


def relevant(results: DataFrame, least: float = 0.4) -> DataFrame:
    """search results of at least that score; none counts as 0."""
    return results.where(F.coalesce("score", F.lit(0.0)) >= least)


def rank_score(position: Column) -> Column:
    """M7: 1 / position, from 1; a missing one counts as 1."""
    return 1.0 / F.greatest(F.coalesce(position, F.lit(1)), F.lit(1))


def candidate_score(name: Column, n: Column) -> Column:
    """How much a Markdown file looks like a task's report."""
    out = F.least(F.lit(50.0), n / 2000.0)
    for pattern, add in NAME_SCORES:
        out = out + F.when(F.lower(name).rlike(pattern), add).otherwise(0.0)
    return out


def best_reports(files: DataFrame, min_chars: int) -> DataFrame:
    """(task_id, name, score) of files (task_id, name, n_chars, mtime): the best score, then the latest, then the name."""
    x = files.where(F.col("n_chars") >= min_chars).withColumn("score", candidate_score(F.col("name"), F.col("n_chars")))
    return x.groupBy("task_id").agg(F.max(F.struct("score", "mtime", "name")).alias("b")).select("task_id", "b.name", "b.score")


def find_in_content(text: Column, pattern: str) -> Column:
    """All matches of a pattern without groups, in order."""
    return F.regexp_extract_all(X.text(text), F.lit(f"({pattern})"), 1)


def str_replace(text: Column, old: str, new: str) -> Column:
    """Every place of a plain text replaced; an empty one changes nothing."""
    return F.replace(X.text(text), F.lit(old), F.lit(new)) if old else X.text(text)


def clean_url(url: Column) -> Column:
    """A URL without the marks after it."""
    return F.regexp_replace(X.strip(X.text(url)), URL_TAIL, "")


def is_reference(url: Column) -> Column:
    """F8: a URL with a host that is no asset."""
    return url.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]") & ~url.rlike(ASSETS)


def reference_registry(mentions: DataFrame) -> DataFrame:
    """(doc_id, number, url): cleaned reference URLs of mentions (doc_id, pos, url), numbered from 1 as first seen."""
    from pyspark.sql import Window

    x = mentions.select("doc_id", "pos", clean_url(F.col("url")).alias("url"))
    x = x.where(is_reference(F.col("url"))).groupBy("doc_id", "url").agg(F.min("pos").alias("pos"))
    return x.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("number"), "url")


def merged_by_url(results: DataFrame) -> DataFrame:
    """(url, title, summ) of results (url, ord, title, summ): the first row of a URL, all its summaries line by line."""
    x = results.groupBy("url").agg(F.min_by("title", "ord").alias("title"), F.array_sort(F.collect_list(F.struct("ord", "summ"))).alias("s"))
    return x.select("url", "title", F.array_join(F.transform("s", lambda r: r["summ"]), "\n").alias("summ"))


def claim_outcomes(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim_id, outcome) of claims (claim_id, subject, field, value, cited array, polarity) against facts (source, subject,
    field, value, exclusive). A cited source's fact with the claimed value speaks for the claim, an exclusive one with another
    value against it; where the claim denies, the other way round.

    Facts are summed by (subject, field, source, value) before claims meet them, so a claim meets one row for each of these."""
    k = lambda c: F.lower(F.regexp_replace(X.strip(X.text(F.col(c))), r"\s+", " "))
    f = facts.select("source", k("subject").alias("s"), k("field").alias("f"), X.value_key(F.col("value")).alias("w"), F.col("exclusive"))
    f = f.groupBy("s", "f", "source", "w").agg(F.max("exclusive").alias("exclusive"))
    c = claims.select("claim_id", k("subject").alias("s"), k("field").alias("f"), X.value_key(F.col("value")).alias("v"), F.coalesce("cited", F.array().cast("array<string>")).alias("cited"), "polarity")
    own, same = F.array_contains("cited", F.col("source")), F.col("v") == F.col("w")
    yes = own & ((same & F.col("polarity")) | (~same & F.col("exclusive") & ~F.col("polarity")))
    no = own & ((same & ~F.col("polarity")) | (~same & F.col("exclusive") & F.col("polarity")))
    flag = lambda x, n: F.coalesce(F.max(x), F.lit(False)).alias(n)
    met = c.join(f, ["s", "f"], "left").select("claim_id", "cited", F.col("source").isNotNull().alias("field"), own.alias("relevant"), yes.alias("yes"), no.alias("no"), F.lit(False).alias("indexed"))
    known, none = facts.select("source").distinct(), F.lit(None).cast("boolean")
    listed = c.select("claim_id", "cited", F.explode("cited").alias("source")).join(known, "source", "left_semi").select("claim_id", "cited", none, none, none, none, F.lit(True))
    met = met.unionAll(listed).groupBy("claim_id", "cited").agg(*[flag(F.col(n), n) for n in ("field", "relevant", "yes", "no", "indexed")])
    out = F.when(F.size("cited") == 0, "no_citation").when(~F.col("relevant") & ~F.col("indexed"), "source_not_indexed").when(~F.col("relevant") & F.col("field"), "wrong_source")
    out = out.when(F.col("yes") & F.col("no"), "conflicting_evidence").when(F.col("no"), "contradicted").when(F.col("yes"), "supported").otherwise("insufficient_evidence")
    return met.select("claim_id", out.alias("outcome"))


def chart_frame(items: DataFrame, by_date: bool = False) -> DataFrame:
    """(chart, dimension, place, metrics map) of items (chart, ord, dimension, metrics map<string, string>): a chart's
    rows in input order, or by date where ``by_date`` and all its dimensions are dates. Values that are no numbers count as 0; rows
    without a dimension go."""
    from pyspark.sql import Window

    rows = items.where(F.coalesce("dimension", F.lit("")) != "")
    x = rows.select("chart", "ord", "dimension", F.transform_values("metrics", lambda _, v: F.coalesce(v.try_cast("double"), F.lit(0.0))).alias("metrics"))
    dated = F.col("dimension").try_cast("timestamp")
    all_dates = F.every(dated.isNotNull()).over(Window.partitionBy("chart"))
    at = F.when(F.lit(by_date) & all_dates, dated)
    return x.withColumn("at__", at).withColumn("place", F.row_number().over(Window.partitionBy("chart").orderBy("at__", "ord"))).select("chart", "dimension", "place", "metrics")
