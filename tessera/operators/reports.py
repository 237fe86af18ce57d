"""Report scoring as columns: repetition, citations, evidence, gates, the final reward.

A report is a row (doc_id, report, task_prompt, expected_images, tool_errors, evidence_urls, evidence_titles, judge_reason);
scores are functions of the row, so they run where the row lies.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.functions import prose
from tessera.functions import text as X
from tessera.functions.shared import tasks
from tessera.operators import claims

#: Weights of the five scores, caps of the gates.
WEIGHTS = {"visual": 0.33, "evidence": 0.27, "task": 0.16, "quant": 0.13, "quality": 0.11}
CAPS = {"empty_or_crashed": 0.05, "fabricated_source_data": 0.20, "repetition_collapse": 0.25, "format_instruction_fail": 0.35}
REFERENCE = r"^\s*(?:[-*+]\s*)?\[(\d+)\]\s*(?::|\s)\s*(.*)$"
SECTION = r"(?im)^#{1,3}\s*(?:references?|sources?|bibliography|参考|来源|参考文献)"
DIMENSIONS = ("GEN", "EVI", "VEF", "MM", "PRES")
RUBRIC_OF = {"visual": "MM", "evidence": "EVI", "task": "GEN", "quant": "VEF", "quality": "PRES"}
#: What a judge's reason says of a failure.
REASONS = {
    "fabricated_source_data": r"(?is)fabricated|invents?|hallucinat|non-existent|false presence|future publication dates?|伪造|编造|幻觉|不存在",
    "format_instruction_fail": r"(?is)format violates|fails? to adhere|ignores? the requested|hard requirement|格式.*错误|违反.*要求|未遵守",
    "repetition_collapse": r"(?is)excessive repetition|repeated headings|copy-paste|repetitive filler|重复崩坏|大量重复|报告崩坏",
}

clamp = X.clamp


def per(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1), b)


def ratio_of(extra: Column, n: Column) -> Column:
    return F.when(n > 0, extra / n).otherwise(0.0)


# --- repetition ---------------------------------------------------------------------------------------------------


def multiplicity(units: DataFrame, unit: str, above: int = 1) -> DataFrame:
    """By document: units, distinct units, the extra copies of units that occur more than ``above`` times, the most."""
    c = units.groupBy("doc_id", unit).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("doc_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct"), F.sum(F.when(F.col("c") > above, F.col("c") - 1).otherwise(0)).alias("extra"), F.max("c").alias("most"))


def top_repeated(units: DataFrame, unit: str, k: int = 10) -> DataFrame:
    """The k most repeated units of a document, first seen first, cut to 240 characters."""
    c = units.groupBy("doc_id", unit).agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("pos")).where("c > 1")
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("c"), "pos"))
    return c.withColumn("rank", rn).where(F.col("rank") <= k).select("doc_id", "rank", "c", F.left(unit, F.lit(240)).alias("unit"))


def soft_penalty(dup_par: Column, dup_sen: Column, most_par: Column, most_sen: Column, dup_ng: Column) -> Column:
    """M9."""
    x = 0.65 * dup_par + 0.15 * dup_sen + 0.10 * F.least(most_par / 10.0, F.lit(1.0)) + 0.06 * F.least(most_sen / 25.0, F.lit(1.0)) + 0.04 * F.least(dup_ng * 2.0, F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.6), x))


def severe(dup_par: Column, most_par: Column, dup_sen: Column, most_sen: Column, dup_ng: Column, most_ng: Column) -> Column:
    """why a report counts as collapsed."""
    rules = [
        (dup_par > 0.25, "duplicate_paragraph_ratio"),
        (most_par > 5, "max_repeated_paragraph_count"),
        ((dup_sen > 0.35) & (most_sen > 10), "duplicate_sentence_block"),
        ((dup_sen > 0.18) & (most_sen > 30), "max_repeated_sentence_count"),
        ((dup_ng > 0.20) & (most_ng > 20), "duplicate_ngram_block"),
    ]
    return F.filter(F.array(*[F.when(c, n) for c, n in rules]), lambda x: x.isNotNull())


def repetition(reports: DataFrame) -> DataFrame:
    """By document the repetition metrics, why it counts as collapsed, and the penalty; made in the row, without a shuffle."""
    return reports.select("doc_id", prose.repeats(F.col("report")).alias("r")).select("doc_id", "r.*").withColumns(judged(F.col))


def judged(c: Callable[[str], Column]) -> dict[str, Column]:
    """F17 and M9 of a report's counts."""
    why = severe(c("dup_paragraphs"), c("most_paragraph"), c("dup_sentences"), c("most_sentence"), c("dup_ngrams"), c("most_ngram"))
    return {"severe": why, "penalty": soft_penalty(c("dup_paragraphs"), c("dup_sentences"), c("most_paragraph"), c("most_sentence"), c("dup_ngrams"))}


# --- spread -------------------------------------------------------------------------------------------------------


def spread(reports: DataFrame) -> DataFrame:
    """Reports over four tasks a core at least: to read one costs far more than Spark's sizes of shuffled partitions allow for."""
    return reports.repartition(tasks(reports.sparkSession), F.xxhash64("doc_id"))  # by doc_id itself, it would be taken for the join's own shuffle


# --- citations ----------------------------------------------------------------------------------------------------


def citations(reports: DataFrame) -> DataFrame:
    """Reports with a struct ``cit``: counts, valid, resolved, unresolved and orphan ids, mapped URLs, coverage.

    A reference line is ``[n] : url``; an id is valid if its lines have one distinct URL between them."""
    reports = spread(reports)
    lines = F.split(X.text(F.col("report")), r"\r?\n")
    is_ref = lambda x: x.rlike(REFERENCE) & F.regexp_extract(x, REFERENCE, 2).rlike("(?i)https?://[^\\s)\\]}>\"'。，；：！？]")
    number = lambda a: F.transform(F.array_sort(F.transform(F.array_distinct(a), lambda t: t.cast("decimal(38,0)"))), lambda t: t.cast("string"))
    x = reports.withColumns({"refs__": F.filter(lines, is_ref), "body__": F.array_join(F.filter(lines, lambda x: ~is_ref(x)), "\n")})
    pairs = F.flatten(F.transform("refs__", lambda r: F.transform(X.urls(F.regexp_extract(r, REFERENCE, 2)), lambda u: F.struct(F.regexp_extract(r, REFERENCE, 1).alias("id"), X.normal_url(u).alias("url")))))
    x = x.withColumns({"pairs__": F.array_distinct(pairs), "cites__": X.matches(F.col("body__"), r"\[\d+\]")})
    x = x.withColumns({"cites__": F.transform("cites__", lambda t: F.regexp_extract(t, r"(\d+)", 1)), "ids__": F.array_distinct(F.transform("pairs__", lambda p: p["id"]))})
    x = x.withColumns({"unique__": number(F.col("cites__")), "valid__": number(F.filter("ids__", lambda i: F.size(F.filter("pairs__", lambda p: p["id"] == i)) == 1))})
    claims = F.filter(F.transform(X.split_sentences(F.col("body__")), X.strip), lambda s: (F.length(s) >= 40) & ~s.rlike(r"^(?:#|```|!\[)") & ~s.rlike(r"^[-*+|\s\d.:]+$"))
    x = x.withColumns({"claims__": claims, "resolved__": F.array_intersect("unique__", "valid__")})
    x = x.withColumns({"unresolved__": F.array_except("unique__", "resolved__"), "orphans__": F.array_except("valid__", "unique__"), "mapped__": F.array_sort(F.array_distinct(F.transform(F.filter("pairs__", lambda p: F.array_contains("valid__", p["id"])), lambda p: p["url"]))), "cited__": F.size(F.filter("claims__", lambda s: s.rlike(r"\[\d+\]")))})
    cit = F.struct(
        F.size("cites__").alias("count"), F.col("unique__").alias("unique_ids"), F.size("ids__").alias("mapping_count"), F.col("valid__").alias("valid_ids"), F.col("resolved__").alias("resolved_ids"),
        F.col("unresolved__").alias("unresolved_ids"), F.col("orphans__").alias("orphan_ids"), per(F.size("orphans__"), F.size("valid__")).alias("orphan_ratio"), F.col("mapped__").alias("mapped_urls"),
        per(F.size("resolved__"), F.size("unique__")).alias("integrity"), F.size("claims__").alias("n_claims"), F.col("cited__").alias("n_cited"), per(F.col("cited__"), F.size("claims__")).alias("claim_coverage"),
    )
    return x.select(*reports.columns, cit.alias("cit"))


def registry(reports: DataFrame) -> DataFrame:
    """(doc_id, number, url): a report's distinct clean URLs, renumbered in order of first use."""
    x = reports.select("doc_id", F.posexplode(X.urls(F.col("report"))).alias("pos", "u")).select("doc_id", "pos", X.normal_url(F.col("u")).alias("url"))
    g = x.groupBy("doc_id", "url").agg(F.min("pos").alias("pos"))
    return g.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("number"), "url")


def replaced_citations(answer: Column, urls: Column) -> Column:
    """``[citation:n]`` becomes the n-th URL in brackets; ids without a URL go."""
    done = F.aggregate(F.transform(urls, lambda u, i: F.struct(u.alias("u"), i.alias("i"))), X.text(answer), lambda a, s: F.replace(a, F.concat(F.lit("[citation:"), (s["i"] + 1).cast("string"), F.lit("]")), F.concat(F.lit("("), s["u"], F.lit(")"))))
    return F.regexp_replace(done, r"\[citation:\d+\]", "")


# --- scores -------------------------------------------------------------------------------------------------------

#: What is counted in a report (``count_``) and looked for in a task (``asks_``), and the words before an image's
#: number, which counts from 0 or from 1.
PATTERNS = {
    "count_visual": r"(?i)image|figure|fig\.|visual|visible|chart|axis|legend|unit|curve|图像|图片|图表|画面|主体|背景|构图|坐标|图例|单位|曲线|可见",
    "count_visual_doubt": r"(?i)uncertain|not visible|cannot confirm|cannot determine|不确定|无法确认|看不清|证据不足",
    "count_citation": r"\[(?:\d+|[A-Za-z][A-Za-z0-9_-]*)\]",
    "count_section": SECTION,
    "count_evidence": r"(?i)evidence|source|according to|citation|来源|证据|资料|引用|根据",
    "count_no_source": r"(?i)citation needed|placeholder|no source|no available source|无法提供|未找到|无可用",
    "count_heading": r"(?m)^#{1,4}\s+\S",
    "count_bullet": r"(?m)^\s*(?:[-*+]|\d+[.)、])\s+\S",
    "count_table": r"(?m)^\s*\|.+\|\s*$",
    "count_three": r"(?m)^\s*(?:[123][.)、]|一[.)、]|二[.)、]|三[.)、])",
    "count_hypothesis": r"(?i)hypothesis|candidate|假设|候选|可能",
    "count_chinese": r"[一-鿿]",
    "count_latin": r"\b[A-Za-z]{3,}\b",
    "count_number": r"(?i)(?<![A-Za-z])[-+]?\d+(?:\.\d+)?\s*(?:%|km|kg|gb|mb|usd|rmb|yuan|kwh|mwh|mw|gw|元|年|月|日)?",
    "count_formula": r"(?i)=|ratio|percent|同比|环比|增长|下降|increase|decrease|per\s+cent",
    "count_no_number": r"(?i)insufficient data|cannot calculate|cannot confirm|无法计算|无法确认|数据不足|不确定",
    "count_contradiction": r"(?i)contradict|inconsistent|自相矛盾|前后矛盾|不一致",
    "count_caveat": r"(?i)uncertain|limitation|caveat|不确定|局限|证据不足",
    "count_crash": r"(?i)traceback|exception|tool crashed|error executing|空输出|崩溃|报错",
    "asks_markdown": r"(?i)markdown",
    "asks_table": r"(?i)table|表格|表形",
    "asks_list": r"(?i)编号|numbered|bullet|列出|list",
    "asks_three": r"(?i)3\s*(?:categories|types|类|个)",
    "asks_two": r"(?i)2\s*(?:possible|candidates?|个|种)|two possible",
    "asks_short": r"(?i)短答|一小段|under\s+\d+\s+(?:chars|characters|words)|字以内|不超过\s*\d+\s*字",
    "asks_chinese": r"[一-鿿]",
    "asks_numbers": r"(?i)quant|numeric|calculate|ratio|percent|trend|unit|rank|compare|定量|数量|计算|比例|百分比|同比|环比|单位|排序|比较|峰值|最大|最小",
    "asks_200": r"(?i)under\s+200\s+characters|within\s+200\s+characters|200\s*字以内|不超过\s*200\s*字",
    "asks_real_table": r"(?i)table|表格",
}
IMAGE_WORDS = ("image ", "figure ", "fig. ", "img ", "图", "图 ")
SHORT, LONG = 3_500, 220_000
ALIGNMENT = 0.75


#: Those of the counts that are of words alone. Java tries them at every place of a text, Arrow's automaton reads it once: a tenth of the time.
WORDS = {k.removeprefix("count_"): "|".join(w) for k in PATTERNS if k.startswith("count_") and (w := X.plain_words(PATTERNS[k]))}
WORDS["formula"] = PATTERNS["count_formula"].removeprefix("(?i)").replace(r"\s", r"[ \t\n\x0b\f\r]")


@F.pandas_udf(StructType([StructField(k, IntegerType()) for k in WORDS]))
def word_counts(report: pd.Series) -> pd.DataFrame:
    """How often each of ``WORDS`` occurs in a report; only ASCII letters match in either case."""
    low = pc.ascii_lower(pa.array(report, pa.string()).fill_null(""))
    return pd.DataFrame({k: pc.count_substring_regex(low, w).to_numpy() for k, w in WORDS.items()})


word_counts = word_counts.asNondeterministic()  # so that it stays in its place, beside the repetition


def _n(report: Column, what: str, counted: Column | None = None) -> Column:
    return X.count(report, PATTERNS[f"count_{what}"]) if counted is None or what not in WORDS else counted[what]


def _asked(prompt: Column, what: str) -> Column:
    return X.text(prompt).rlike(PATTERNS[f"asks_{what}"])


def _up_to(most: float, x: Column) -> Column:
    return F.least(F.lit(most), x)


def image_coverage(report: Column, images: Column) -> Column:
    """The share of images that the report names, by file, stem or number."""

    def named(low: Column, image: Column, i: Column) -> Column:
        stem = F.regexp_replace(F.lower(image), r"\.[^.]*$", "")
        ks = [i.cast("string"), (i + 1).cast("string")]
        marks = [F.lower(image), *[F.concat(F.lit(p), k) for p in IMAGE_WORDS for k in ks], F.concat(F.lit("图片"), ks[1]), F.concat(F.lit("图像"), ks[1]), F.concat(F.lit("第"), ks[1], F.lit("张"))]
        out = (F.length(stem) >= 3) & F.contains(low, stem)
        for m in marks:
            out = out | F.contains(low, m)
        return out

    return F.when(F.size(images) > 0, X.let(F.lower(X.text(report)), lambda low: F.size(F.filter(F.transform(images, lambda image, i: named(low, image, i)), lambda b: b))) / F.size(images)).otherwise(0.0)


def visual(report: Column, images: Column, counted: Column | None = None) -> Column:
    """C3."""
    n, doubt = F.size(images), _n(report, "visual_doubt", counted)
    x = 0.65 * image_coverage(report, images) + 0.25 * _up_to(1.0, _n(report, "visual", counted) / F.greatest(F.lit(4), n * 4)) + 0.10 * F.when(doubt > 0, _up_to(1.0, doubt / 3)).otherwise(0.25)
    return F.when(n > 0, clamp(x)).otherwise(0.55)


def factuality(report: Column, year: int, counted: Column | None = None) -> Column:
    """C4."""
    urls = X.urls(report)
    n, cites, section = F.size(urls), _n(report, "citation"), _n(report, "section")
    some = 0.45 * (1.0 - _up_to(1.0, per(X.bad_urls(urls), n))) + 0.35 * F.when(cites > 0, _up_to(1.0, cites / 8)).otherwise(0.35) + F.when(section > 0, 0.15).otherwise(0.0) + _up_to(0.15, _n(report, "evidence", counted) * 0.01)
    base = F.when((n == 0) & (cites == 0) & (section == 0), 0.30).otherwise(some)
    return clamp(base - _up_to(0.25, X.future_years(report, year) * 0.05) - _up_to(0.25, _n(report, "no_source", counted) * 0.05))


def aligned(report: Column, cit: Column, legacy: Column, strength: float = ALIGNMENT) -> Column:
    """C5."""
    mapped = cit["mapped_urls"]
    full = 0.05 + 0.40 * cit["integrity"] + 0.20 * cit["claim_coverage"] + 0.15 * (1.0 - _up_to(1.0, per(X.bad_urls(mapped), F.size(mapped)))) + 0.10 * _up_to(1.0, F.size(mapped) / 6.0)
    full = full + F.when(X.text(report).rlike(SECTION), 0.10).otherwise(0.0) - _up_to(0.25, 0.25 * cit["orphan_ratio"])
    x = F.when(cit["count"] == 0, F.when(F.size(mapped) == 0, 0.12).otherwise(0.20)).when(F.size(mapped) == 0, 0.08).otherwise(full)
    return clamp((1.0 - strength) * legacy + strength * clamp(x))


def local_evidence(report: Column, cit: Column, urls: Column, titles: Column, items: Column | None = None) -> Column:
    """What the report shares with its evidence: ``items`` pieces (by default as many as titles or URLs)."""
    return X.let(F.struct(F.array_sort(F.array_distinct(F.filter(F.transform(urls, X.normal_url), lambda u: u != ""))).alias("own"), F.lower(X.text(report)).alias("low")), lambda x: _shared(x["own"], x["low"], report, cit, urls, titles, items))


def _shared(own: Column, low: Column, report: Column, cit: Column, urls: Column, titles: Column, items: Column | None) -> Column:
    hosts = F.array_distinct(F.filter(F.transform(own, X.url_host), lambda h: h != ""))
    said = F.array_distinct(F.transform(X.urls(report), X.normal_url))
    both = F.size(F.array_intersect(cit["mapped_urls"], own))
    return F.struct(
        F.coalesce(items if items is not None else F.greatest(F.size(titles), F.size(urls)), F.lit(0)).alias("items"),
        F.size(own).alias("url_count"), F.size(F.array_intersect(own, said)).alias("exact_hits"), F.size(F.filter(hosts, lambda h: F.contains(low, h))).alias("host_hits"), F.size(hosts).alias("host_count"),
        F.size(F.filter(titles, lambda t: (F.length(t) >= 4) & F.contains(low, F.lower(t)))).alias("title_hits"), both.alias("supported"),
        per(both, F.size(cit["mapped_urls"])).alias("precision"), F.when(F.size(own) > 0, _up_to(1.0, both / F.least(F.lit(6), F.size(own)))).otherwise(0.0).alias("coverage"),
    )


def local_score(report: Column, cit: Column, loc: Column, provenance: bool = True, strength: float = ALIGNMENT) -> Column:
    """A part by names and hosts, and a part by precision and coverage of cited URLs against the evidence."""
    section = X.text(report).rlike(SECTION)
    seen = lambda k: loc[k] if provenance else F.lit(0.0)
    known = 0.28 + 0.42 * _up_to(1.0, seen("host_hits") / F.greatest(F.lit(1), F.least(F.lit(3), loc["host_count"]))) + 0.18 * _up_to(1.0, seen("exact_hits") / F.greatest(F.lit(1), F.least(F.lit(2), loc["url_count"])))
    titles = _up_to(1.0, seen("title_hits") / 2)
    legacy = clamp(F.when(loc["url_count"] > 0, known + F.when(section, 0.07).otherwise(0.0) + 0.05 * titles).otherwise(0.42 + 0.30 * titles + F.when(section, 0.08).otherwise(0.0)))
    full = 0.05 + 0.30 * seen("precision") + 0.15 * seen("coverage") + 0.20 * cit["integrity"] + 0.25 * cit["claim_coverage"] + F.when(section, 0.05).otherwise(0.0) - _up_to(0.25, 0.25 * cit["orphan_ratio"])
    full = F.when(cit["count"] == 0, _up_to(0.20, full)).when(cit["integrity"] == 0, _up_to(0.30, full)).otherwise(full)
    near = F.when(loc["url_count"] == 0, 0.50).when(F.size(cit["mapped_urls"]) == 0, 0.08).otherwise(full)
    return F.when(loc["items"] == 0, 0.50).otherwise(clamp((1.0 - strength) * legacy + strength * clamp(near)))


def task_following(report: Column, prompt: Column, counted: Column | None = None) -> Column:
    """C7."""
    headings, bullets, tables = _n(report, "heading"), _n(report, "bullet"), _n(report, "table")
    add = lambda cond, n, other=0.0: F.when(cond, n).otherwise(other)
    x = 0.45 + _up_to(0.20, headings * 0.03) + _up_to(0.12, bullets * 0.01) + _up_to(0.08, tables * 0.02)
    x = x - add(_asked(prompt, "markdown") & (headings == 0), 0.12) - add(_asked(prompt, "table") & (tables == 0), 0.18) - add(_asked(prompt, "list") & (bullets < 2), 0.12)
    x = x + add(_asked(prompt, "three"), add(_n(report, "three") >= 3, 0.08, -0.10)) + add(_asked(prompt, "two"), add(_n(report, "hypothesis", counted) >= 2, 0.06, -0.08))
    x = x - add(_asked(prompt, "short") & (F.length(report) > SHORT), 0.18)
    return clamp(x - add(_asked(prompt, "chinese") & (_n(report, "chinese") < _n(report, "latin")), 0.10))


def quantitative(report: Column, prompt: Column, counted: Column | None = None) -> Column:
    """C8."""
    numbers = _n(report, "number")
    wanted = 0.30 + _up_to(0.35, numbers * 0.015) + _up_to(0.20, _n(report, "formula", counted) * 0.03) + F.when(_n(report, "no_number", counted) > 0, 0.05).otherwise(0.0)
    return clamp(F.when(_asked(prompt, "numbers"), wanted).otherwise(0.55 + _up_to(0.12, numbers * 0.004)))


def quality(report: Column, task: Column, penalty: Column, counted: Column | None = None) -> Column:
    """C9."""
    body = X.strip(X.text(report))
    blocks = F.when(body == "", 0).otherwise(F.size(F.split(body, r"\n\s*\n+")))
    x = 0.38 + 0.30 * task + _up_to(0.25, _n(report, "heading") * 0.035) + _up_to(0.12, blocks * 0.004) - penalty * 0.75
    x = x - _up_to(0.20, _n(report, "contradiction", counted) * 0.08) + _up_to(0.05, _n(report, "caveat", counted) * 0.01)
    return clamp(x - F.when(F.length(report) > LONG, 0.12).otherwise(0.0))


def reason_tags(reason: Column) -> Column:
    """Failure tags of a judge's reason."""
    return F.filter(F.array(*[F.when(X.text(reason).rlike(p), t) for t, p in REASONS.items()]), lambda x: x.isNotNull())


def classify_reason(reason: Column) -> Column:
    """C17: tags, cap, positive, failed."""
    tags = reason_tags(reason)
    cap = F.coalesce(F.array_min(F.transform(tags, cap_of)), F.lit(1.0))
    return F.struct(tags.alias("tags"), cap.alias("cap"), X.text(reason).rlike("(?i)excellent|outstanding|near-perfect|high-quality|accurate").alias("positive"), ((F.size(tags) > 0) | X.text(reason).rlike("(?i)catastrophic|complete failure|fundamentally flawed|invalidates|misleading")).alias("failed"))


def cap_of(tag: Column) -> Column:
    out = F.lit(1.0)
    for t, c in CAPS.items():
        out = F.when(tag == t, c).otherwise(out)
    return out


def gates(report: Column, prompt: Column, cit: Column, loc: Column, severe_: Column, reason: Column, year: int, provenance: bool = True, counted: Column | None = None) -> Column:
    """The gates that a report has hit."""
    body, urls = X.strip(X.text(report)), X.urls(report)
    n = F.size(urls)
    fake = ((n > 0) & (X.bad_urls(urls) >= F.greatest(F.lit(2), F.ceil(n * 0.5)))) | (X.future_years(report, year) >= 3) | ((cit["count"] >= 4) & (n == 0) & (cit["mapping_count"] == 0))
    fake = fake | ((cit["count"] >= 40) & (cit["mapping_count"] >= 6) & (cit["integrity"] < 0.20)) | ((cit["count"] >= 80) & (cit["claim_coverage"] < 0.08)) | ((cit["mapping_count"] >= 8) & (cit["orphan_ratio"] >= 0.60))
    if provenance:
        fake = fake | ((loc["items"] > 0) & (F.size(cit["mapped_urls"]) >= 4) & (loc["precision"] < 0.25))
    form = (_asked(prompt, "200") & (F.length(body) > 1200)) | (_asked(prompt, "real_table") & (_n(report, "table") == 0))
    own = F.array(F.when((F.length(body) < 100) | (_n(report, "crash", counted) > 0), "empty_or_crashed"), F.when(fake, "fabricated_source_data"), F.when(form, "format_instruction_fail"), F.when(F.size(severe_) > 0, "repetition_collapse"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(own, reason_tags(reason)), lambda x: x.isNotNull())))


def score_reports(reports: DataFrame, year: int, local_strength: float = 0.45, criteria: DataFrame | None = None, claim_evidence: DataFrame | None = None, hard_gates: bool = True, provenance: bool = True) -> DataFrame:
    """Every report's scores, penalties, gates and final reward.

    ``criteria``: with rubrics (see ``rubric_scores``), reports that have a rubric_id mix 0.7 of each score with 0.3 of its
    dimension's. ``claim_evidence``: what sources say (see claims.combined_evidence) moves the evidence score. ``hard_gates``
    false: neither caps nor penalties; ``provenance`` false: matches with the evidence pool don't count."""
    c = F.col
    x = citations(reports).withColumns({"r__": prose.repeats(c("report")), "n__": word_counts(c("report"))}).withColumns(judged(lambda k: c(f"r__.{k}")))
    items = c("evidence_items") if "evidence_items" in reports.columns else None
    x = x.withColumns({"loc": local_evidence(c("report"), c("cit"), c("evidence_urls"), c("evidence_titles"), items), "visual": visual(c("report"), c("expected_images"), c("n__")), "legacy": factuality(c("report"), year, c("n__")), "task": task_following(c("report"), c("task_prompt"), c("n__")), "quant": quantitative(c("report"), c("task_prompt"), c("n__"))})
    x = x.withColumns({"aligned": aligned(c("report"), c("cit"), c("legacy")), "quality": quality(c("report"), c("task"), c("penalty"), c("n__"))})
    x = x.withColumn("evidence", F.when(c("loc.items") > 0, clamp((1 - local_strength) * c("aligned") + local_strength * local_score(c("report"), c("cit"), c("loc"), provenance))).otherwise(c("aligned")))
    x = x.withColumn("gates", gates(c("report"), c("task_prompt"), c("cit"), c("loc"), c("severe"), c("judge_reason"), year, provenance, c("n__")))
    if criteria is not None:
        dims = rubric_dimensions(x.where("rubric_id is not null").select("doc_id", "rubric_id", "report", "cit"), criteria)
        got = dims.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "s"))).alias("dims__"))  # five at most
        x = x.join(got, "doc_id", "left")
        mixed = lambda k: F.when(c("rubric_id").isNull(), c(k)).otherwise(0.70 * c(k) + 0.30 * F.coalesce(c("dims__")[RUBRIC_OF[k]], F.lit(0.0)))
        x = x.withColumns({k: mixed(k) for k in WEIGHTS})
    if claim_evidence is not None:
        moved = claims.combined_evidence(x.select("doc_id", "report", c("evidence").alias("base")), claim_evidence)
        x = x.drop("evidence").join(moved.select("doc_id", clamp(c("combined")).alias("evidence")), "doc_id")
    invalid, repeat = (_up_to(0.20, c("tool_errors") * 0.05), c("penalty")) if hard_gates else (F.lit(0.0), F.lit(0.0))
    x = x.withColumn("raw_reward", sum((w * c(k) for k, w in WEIGHTS.items()), F.lit(0.0)) - invalid - repeat)
    x = x.withColumn("reward_cap", F.coalesce(F.array_min(F.transform("gates", cap_of)), F.lit(1.0)) if hard_gates else F.lit(1.0))
    return x.select("doc_id", *WEIGHTS, "penalty", "gates", "raw_reward", "reward_cap", F.least(clamp(c("raw_reward")), c("reward_cap")).alias("final_reward"))


# --- rubrics ------------------------------------------------------------------------------------------------------


def rubric_dimensions(reports: DataFrame, criteria: DataFrame) -> DataFrame:
    """(doc_id, dim, s, w): the mean score and the weight of each of a rubric's dimensions, for reports with cit and a
    rubric_id, against criteria (rubric_id, dim, weight, criterion, evaluation). Criteria with citations count the sentences
    that cite a resolved id for four fifths. A report's tokens are found once, and only its rubric's own meet each criterion."""
    body = F.array_join(F.filter(F.split(X.text(F.col("report")), r"\r?\n"), lambda s: ~s.rlike(r"^\s*(?:[-*+]\s*)?\[\d+\]\s*(?::|\s).*https?://")), "\n")
    told = F.filter(F.split(body, r"(?<=[.!?。！？])\s*(?!\[\d+\])|\n+"), lambda s: F.arrays_overlap(F.regexp_extract_all(s, F.lit(r"\[(\d+)\]"), 1), F.col("cit.resolved_ids")))
    need = criteria.withColumn("need__", X.tokens(F.col("criterion")))
    known = need.groupBy("rubric_id").agg(F.array_distinct(F.flatten(F.collect_list("need__"))).alias("known__"))  # a rubric's own words
    x = reports.select("doc_id", "rubric_id", X.tokens(F.col("report")).alias("have__"), X.tokens(F.array_join(told, "\n")).alias("told__"))
    x = x.join(known, "rubric_id").select("doc_id", "rubric_id", *[F.array_intersect(k, "known__").alias(k) for k in ("have__", "told__")]).join(need, "rubric_id")
    plain = X.token_coverage(F.col("have__"), F.col("need__"))
    s = F.when(F.col("evaluation") == "claim_with_citation", 0.20 * plain + 0.80 * X.token_coverage(F.col("told__"), F.col("need__"))).otherwise(plain)
    w = F.when(F.col("weight").isNull(), 1.0).when(F.isnan("weight") | (F.abs("weight") == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("weight")))
    return x.groupBy("doc_id", "dim").agg(F.avg(s).alias("s"), F.max(w).alias("w"))


def rubric_scores(reports: DataFrame, criteria: DataFrame) -> DataFrame:
    """(doc_id, rubric): the dimensions' mean by weight."""
    return rubric_dimensions(reports, criteria).groupBy("doc_id").agg(F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("s")) / F.sum("w")).otherwise(0.0).alias("rubric"))


def dimension_reward(rubric: Column, gates_: Column, rules: Column) -> Column:
    """The rubric's score under the caps of those rules (structs id, overall_cap) whose reason was detected."""
    reason = lambda r: F.when(r["id"].startswith("EVI"), "fabricated_source_data").when(r["id"].startswith("PRES"), "repetition_collapse").when(r["id"].startswith("GEN"), "format_instruction_fail")
    hit = F.transform(F.filter(rules, lambda r: F.coalesce(F.array_contains(gates_, reason(r)), F.lit(False))), lambda r: clamp(F.coalesce(r["overall_cap"], F.lit(1.0))))
    return clamp(F.least(rubric, F.coalesce(F.array_min(hit), F.lit(1.0))))


# --- claims -------------------------------------------------------------------------------------------------------


def claim_status(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims (claim_id, subject, field, value, cited array) against facts (source, subject, field, value,
    exclusive): supported, contradicted, wrong_source or unknown."""
    k = lambda c: F.lower(X.strip(X.text(F.col(c))))
    c = claims.select("claim_id", k("subject").alias("s"), k("field").alias("f"), X.value_key(F.col("value")).alias("v"), "cited")
    t = facts.select("source", k("subject").alias("s"), k("field").alias("f"), X.value_key(F.col("value")).alias("w"), "exclusive")
    own, same = F.array_contains("cited", F.col("source")), F.col("v") == F.col("w")
    j = c.join(t, ["s", "f"]).groupBy("claim_id").agg(F.max((own & same).cast("int")).alias("yes"), F.max((own & ~same & F.col("exclusive")).cast("int")).alias("no"), F.max((~own & same).cast("int")).alias("other"))
    status = F.when(F.col("yes") == 1, "supported").when(F.col("no") == 1, "contradicted").when(F.col("other") == 1, "wrong_source").otherwise("unknown")
    return claims.select("claim_id").join(j, "claim_id", "left").select("claim_id", status.alias("status"))


# --- structure ----------------------------------------------------------------------------------------------------


def lines_of(reports: DataFrame) -> DataFrame:
    return reports.select("doc_id", F.posexplode(F.split(X.text(F.col("report")), r"\r?\n")).alias("ln", "line"))


def headings(reports: DataFrame) -> DataFrame:
    """(doc_id, ln, level, title, key, parent): headings outside fences with the key of the level-2 heading above."""
    by = Window.partitionBy("doc_id").orderBy("ln")
    x = lines_of(reports).withColumn("fence", F.sum(F.col("line").rlike(r"^\s*```").cast("int")).over(by) % 2)
    x = x.where((F.col("fence") == 0) & F.col("line").rlike(r"^#{1,6}\s+\S"))
    x = x.select("doc_id", "ln", F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), X.strip(F.regexp_replace("line", r"^#+\s+", "")).alias("title"))
    x = x.withColumn("key", X.heading_key(F.col("title")))
    return x.withColumn("parent", F.last(F.when(F.col("level") == 2, F.col("key")), ignorenulls=True).over(by))


def repeated_headings(reports: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, key, n): headings that come three times or more."""
    return headings(reports).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


#: The headings that a report has besides its sections, by its language.
LABELS = {"zh": ("目录", "参考文献"), "de": ("Inhaltsverzeichnis", "Quellen"), "fr": ("Table des matières", "Références"), "es": ("Índice", "Referencias"), "en": ("Table of Contents", "Reference")}


def structure_issues(reports: DataFrame, outline: DataFrame) -> DataFrame:
    """(doc_id, has_issues, headings, expected, unexpected, repeated, problem_sections) of reports (doc_id, report,
    title, query, references int) against their outlines (doc_id, sec, title, subsections array).

    Expected are the title, the table of contents, sections with their subsections, and the references if there are any.
    Repeated are headings that come three times or more and more often than expected. A section is a problem if a heading under
    it is unexpected or repeated, or if it has over two subheadings more than expected."""
    lang = X.report_language(F.coalesce(F.nullif("query", F.lit("")), F.nullif("title", F.lit("")), F.lit("Report")))
    label = lambda k: F.create_map(*[F.lit(x) for lg, two in LABELS.items() for x in (lg, two[k])])[lang]
    key = X.heading_key
    own = reports.select("doc_id", F.explode(F.array_distinct(F.array(key(F.coalesce(F.nullif("title", F.lit("")), F.lit("Report"))), key(label(0))))).alias("key"), F.lit(1).alias("n"))
    refs = reports.where("references > 0").select("doc_id", key(label(1)).alias("key"), F.lit(1).alias("n"))
    subs = F.coalesce("subsections", F.array().cast("array<string>"))
    sub = lambda s, i: key(F.coalesce(F.nullif(s, F.lit("")), F.concat_ws(".", "sec", (i + 1).cast("string"))))
    sec = outline.select("doc_id", "sec", key(F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Section "), F.col("sec").cast("string")))).alias("key"), F.transform(subs, sub).alias("subs"))
    below = sec.select("doc_id", F.explode(F.concat(F.array("key"), "subs")).alias("key"), F.lit(1).alias("n"))
    expected = own.unionAll(below).unionAll(refs).groupBy("doc_id", "key").agg(F.sum("n").alias("wanted"))
    size = sec.groupBy("doc_id").agg(F.sum(F.size("subs") + 1).alias("s"))
    sections = sec.groupBy("doc_id", F.col("key").alias("parent")).agg(F.max_by(F.size("subs"), "sec").alias("n_subs"))
    h = headings(reports)
    counts = h.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c")).join(expected, ["doc_id", "key"], "left")
    counts = counts.withColumns({"odd": F.col("wanted").isNull(), "again": (F.col("key") != "") & (F.col("c") >= 3) & (F.col("c") > F.coalesce("wanted", F.lit(0)))})
    total = counts.groupBy("doc_id").agg(F.sum("c").alias("headings"), F.sum(F.when(F.col("odd"), F.col("c")).otherwise(0)).alias("unexpected"), F.array_sort(F.collect_list(F.when(F.col("again"), F.concat("key", F.lit(" x"), F.col("c").cast("string"))))).alias("repeated"))
    x = h.join(counts.select("doc_id", "key", "odd", "again"), ["doc_id", "key"]).join(sections, ["doc_id", "parent"])
    bad = x.groupBy("doc_id", "parent").agg((F.max("odd") | F.max("again") | (F.count_if(F.col("level") >= 3) > F.max("n_subs") + 2)).alias("bad")).where("bad")
    bad = bad.groupBy("doc_id").agg(F.array_sort(F.collect_list("parent")).alias("problem_sections"))
    y = reports.select("doc_id", (F.col("references") > 0).cast("int").alias("r")).join(size, "doc_id", "left").join(total, "doc_id", "left").join(bad, "doc_id", "left")
    y = y.withColumns({"headings": F.coalesce("headings", F.lit(0)), "unexpected": F.coalesce("unexpected", F.lit(0)), "expected": 2 + F.coalesce("s", F.lit(0)) + F.coalesce("r", F.lit(0)), "repeated": F.coalesce("repeated", F.array().cast("array<string>")), "problem_sections": F.coalesce("problem_sections", F.array().cast("array<string>"))})
    many = F.col("headings") > F.col("expected") + F.greatest(F.lit(3), F.floor(F.col("expected") / 4))
    return y.select("doc_id", ((F.size("repeated") > 0) | many).alias("has_issues"), "headings", "expected", "unexpected", F.slice("repeated", 1, 8).alias("repeated"), "problem_sections")


def without_repeated_headings(reports: DataFrame) -> DataFrame:
    """(doc_id, ln, line) without headings equal to the one right before, blank lines aside."""
    by = Window.partitionBy("doc_id").orderBy("ln")
    full = lines_of(reports).withColumn("blank", X.strip(F.col("line")) == "")
    prev = F.last(F.when(~F.col("blank"), F.col("line")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    head = F.col("line").rlike(r"^#{1,6}\s")
    same = head & F.coalesce(prev.rlike(r"^#{1,6}\s") & (X.heading_key(prev) == X.heading_key(F.col("line"))), F.lit(False))
    return full.withColumn("same", same).where("not same").select("doc_id", "ln", "line")


def dedup_sections(reports: DataFrame, least: int = 2000, section: int = 80) -> DataFrame:
    """(doc_id, text): long documents of over two sections lose sections that repeat an earlier one (by 4000 characters)."""
    parts = F.split(X.text(F.col("report")), r"(?m)(?=^#{1,6}\s)")
    x = reports.select("doc_id", "report", F.filter(parts, lambda p: p != "").alias("parts"))
    long_ = (F.length("report") >= least) & (F.size("parts") > 2)
    key = lambda p: F.left(F.regexp_replace(F.lower(p), r"\s+", " "), F.lit(4000))
    keep = F.filter("parts", lambda p, i: (F.length(p) <= section) | (F.array_position(F.transform("parts", key), key(p)) == i + 1))
    return x.select("doc_id", F.when(long_, F.array_join(keep, "")).otherwise(F.col("report")).alias("text"))
