"""Prompts, workspace joins and trajectory rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.pyfuncs import assign


def evidence_prompt(items: Column) -> Column:
    """Numbered blocks of an array of items (title, source_ref, urls, text), five URLs a block at most (its format)."""

    def block(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        urls = F.filter(x["urls"], lambda u: u.isNotNull() & (u != ""))
        ref = X.text(x["source_ref"])
        return F.concat(
            F.lit("["), n, F.lit("] "), F.coalesce(F.nullif(x["title"], F.lit("")), F.concat(F.lit("Evidence "), n)),
            F.when(ref != "", F.concat(F.lit("\nSource: "), ref)).otherwise(""),
            F.when(F.coalesce(F.size(urls), F.lit(0)) > 0, F.concat(F.lit("\nURLs: "), F.array_join(F.slice(urls, 1, 5), "; "))).otherwise(""),
            F.lit("\n"), X.strip(X.text(x["text"])),
        )

    return F.array_join(F.transform(items, block), "\n\n")


def prompt(body: Column, images: Column, items: Column, suffix: Column) -> Column:
    """The user's message: an image mark for each image, the task, the evidence if any, what the report must be like."""
    ev = evidence_prompt(items)
    marks = F.array_join(F.array_repeat(F.lit("<image>"), images), "\n")
    return X.strip(F.concat(marks, F.lit("\n"), X.text(body), F.when(ev != "", F.concat(F.lit("\n\nEvidence:\n"), ev)).otherwise(""), F.lit("\n\n"), X.text(suffix)))


def images_of(pages: DataFrame, images: DataFrame, all_if_none: bool = False) -> DataFrame:
    """(task_id, md, image): images of a task that a file's name names, else its first 4000 characters, else the task's
    only image, else all or none."""
    stem = F.regexp_replace(F.element_at(F.split("image", "/"), -1), r"\.[^.]*$", "")
    j = pages.join(images.select("task_id", "image", stem.alias("stem")), "task_id").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("task_id", "md")))
    head = F.left(X.text(F.col("text")), F.lit(4000))
    tier = F.when(F.contains(F.col("md"), F.col("stem")), 0).when(F.contains(head, F.col("stem")), 1).when(F.col("n") == 1, 2).otherwise(3 if all_if_none else None)
    j = j.withColumn("tier", tier).where("tier is not null")
    return j.withColumn("best", F.min("tier").over(Window.partitionBy("task_id", "md"))).where("tier = best").select("task_id", "md", "image")


def by_number(left: DataFrame, quiz: DataFrame, name: str = "name") -> DataFrame:
    """Workspaces with the quiz of the number in their name; of equal numbers the last quiz."""
    q = quiz.withColumn("num", X.quiz_number(F.col("id"))).withColumn("rn__", F.row_number().over(Window.partitionBy("num").orderBy(F.desc("ord")))).where("rn__ = 1").select("num", F.struct("*").alias("quiz"))
    return left.withColumn("num", X.quiz_number(F.col(name))).join(q, "num", "left")


def referenced(content: DataFrame, refs: DataFrame) -> DataFrame:
    """Contents whose URL is among the references."""
    return content.withColumn("u__", X.normal_url(F.col("url"))).join(refs.select(X.normal_url(F.col("url")).alias("u__")).distinct(), "u__", "left_semi").drop("u__")


def fits_trainer(samples: DataFrame, most: int, index: DataFrame | None = None) -> DataFrame:
    """samples whose estimated tokens fit, and whose images all exist."""
    out = samples.where(X.est_tokens(F.col("text")) <= most)
    if index is None:
        return out
    lost = out.select("sample_id", F.explode("images").alias("path")).join(index.select("path"), "path", "left_anti").select("sample_id").distinct()
    return out.join(lost, "sample_id", "left_anti")


def history_shaped(c: Column) -> Column:
    """JSON that is a list of {type, value}."""
    v = F.from_json(c, "array<map<string,string>>")
    return F.coalesce(v.isNotNull() & F.forall(v, lambda m: m.isNotNull() & F.map_contains_key(m, "type") & F.map_contains_key(m, "value")), F.lit(False))


def report_artifacts(files: DataFrame, workspace: str, least: int = 128) -> DataFrame:
    """F16: Markdown files (path, length) in the workspace of at least so many bytes."""
    return files.where(F.col("path").startswith(workspace.rstrip("/") + "/") & F.lower("path").endswith(".md") & (F.col("length") >= least))


def unless_mentioned(prompt_: Column, urls: Column, rule: str) -> Column:
    """the prompt with a rule after it, unless one of the rule's URLs is in it already."""
    return F.when(F.exists(urls, lambda u: F.contains(prompt_, u)), prompt_).otherwise(F.concat(prompt_, F.lit("\n\n" + rule)))


def sliced(df: DataFrame, start: int, most: int) -> DataFrame:
    """rows with idx from ``start`` on, ``most`` of them (a run's parameter)."""
    return df.where(F.col("idx") >= start).orderBy("idx").limit(most)


def attachment_counts(files: DataFrame) -> DataFrame:
    """By task ``n type`` of its files, by type."""
    n = files.groupBy("task_id", "type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["type"])), ", ").alias("files"))


def first_embeds(lines: DataFrame) -> DataFrame:
    """(doc_id, ln, line) without lines that embed an image embedded before."""
    img = F.regexp_extract("line", r"!\[[^\]]*\]\(([^)]+)\)", 1)
    rn = F.row_number().over(Window.partitionBy("doc_id", img).orderBy("ln"))
    return lines.withColumn("keep", (img == "") | (rn == 1)).where("keep").drop("keep")


def lexical_matches(statements: DataFrame, snippets: DataFrame) -> DataFrame:
    """Statement ids that a snippet of their group bears out: five common phrases, 0.55 of the statement's and 0.45 of
    the snippet's, the same numbers, the same polarity. Phrases meet in an equi-join."""

    def features(df: DataFrame, id_: str) -> DataFrame:
        low = F.lower(X.text(F.col("text")))
        w = F.regexp_extract_all(low, F.lit(r"([a-z0-9]+|[一-鿿])"), 1)
        ph = F.array_distinct(F.when(low.rlike("[一-鿿]"), X.ngrams(w, 3)).otherwise(X.ngrams(w, 2)))
        nums = F.array_join(F.array_sort(F.transform(F.regexp_extract_all(low, F.lit(r"(\d[\d,]*(?:\.\d+)?%?)"), 1), X.value_key)), "|")
        return df.select("grp", F.col("id").alias(id_), F.size(ph).alias(f"n_{id_}"), nums.alias(f"x_{id_}"), low.rlike(X.NEGATIONS).alias(f"p_{id_}"), ph.alias("ph"))

    s, t = features(statements, "s").where("n_s >= 5"), features(snippets, "t")
    j = s.withColumn("p", F.explode("ph")).drop("ph").join(t.withColumn("p", F.explode("ph")).drop("ph"), ["grp", "p"])
    c = j.where("x_s = x_t and p_s = p_t").groupBy("s", "t").agg(F.count(F.lit(1)).alias("c"), F.first("n_s").alias("n_s"), F.first("n_t").alias("n_t"))
    return c.where("c >= 5 and c / n_s >= 0.55 and c / n_t >= 0.45").select(F.col("s").alias("id")).distinct()


def credibility(result: Column, fallback: Column, cut: Column) -> Column:
    """Of a category's lines the first two, trimmed, cut with dots, distinct; the fallback's 50 characters if none."""
    lines = F.when(F.coalesce(F.size(result), F.lit(0)) > 0, result).otherwise(F.array(F.left(fallback, F.lit(50))))
    short = F.transform(F.slice(lines, 1, 2), lambda s: F.when(F.length(X.strip(X.text(s))) > cut, F.concat(F.left(X.strip(X.text(s)), cut), F.lit("..."))).otherwise(X.strip(X.text(s))))
    return F.array_distinct(F.filter(short, lambda s: s != ""))


def step_rewards(state: DataFrame, teacher: DataFrame, generated: DataFrame, completed: DataFrame) -> DataFrame:
    """(grp, plan_alignment, mean_step, final_reward) of step trajectories.

    state (grp, submitted boolean, invalid int), teacher (grp, t, objective, final boolean), generated (grp, c, text),
    completed (grp, c, text). A trajectory has a few steps of each; pairs are scored as columns, matched greedily."""
    cov = lambda a, b: X.coverage(F.col(a), F.col(b), 0.45, 0.65, X.STEP_STOPWORDS)
    t = teacher.select("grp", F.col("t").cast("int").alias("t"), "objective", "final")
    plan = assign(t.join(generated, "grp").select("grp", "t", F.col("c").cast("int").alias("c"), cov("text", "objective").alias("score")), high_index=True)
    done = assign(t.where("not final").join(completed, "grp").select("grp", "t", F.col("c").cast("int").alias("c"), cov("text", "objective").alias("score")))
    n = lambda df, c: df.groupBy("grp").agg(F.count(F.lit(1)).alias(c))
    x = state.join(n(t, "nt"), "grp", "left").join(n(t.where("not final"), "nf"), "grp", "left").join(n(generated, "ng"), "grp", "left").join(n(completed, "nc"), "grp", "left")
    x = x.join(plan.groupBy("grp").agg(F.sum("score").alias("ps")), "grp", "left").join(done.groupBy("grp").agg(F.sum("score").alias("ds")), "grp", "left").na.fill(0)
    one = lambda c: F.greatest(F.lit(1), F.col(c))
    align = F.when((F.col("nt") > 0) & (F.col("ng") > 0), X.clamp(F.col("ps") / F.col("nt") * (0.70 + 0.30 * F.least("ng", "nt") / F.greatest("ng", "nt")))).otherwise(0.0)
    mean = (F.col("ds") + F.col("submitted").cast("int")) / (F.col("nf") + 1)
    x = x.select("grp", align.alias("plan_alignment"), mean.alias("mean_step"), F.least(F.lit(1.0), F.col("nc") / one("nf")).alias("ratio"), F.least(F.lit(0.20), F.col("invalid") * 0.04).alias("off"), "ng", "nc", "nf", "submitted")
    raw = X.clamp(0.15 * F.col("plan_alignment") + 0.75 * F.col("mean_step") + 0.10 * F.col("ratio") - F.col("off"))
    cap = F.least(F.when(F.col("ng") == 0, 0.40).otherwise(1.0), F.when(~F.col("submitted"), 0.60).otherwise(1.0), F.when(F.col("nc") < F.greatest(F.lit(1), F.floor(F.col("nf") / 2)), 0.55).otherwise(1.0))
    return x.select("grp", "plan_alignment", "mean_step", F.least(raw, cap).alias("final_reward"))


def joint_reward(report: Column, step: Column) -> Column:
    """The mean where both kinds are scored, else the one that is."""
    return F.when(report.isNotNull() & step.isNotNull(), (report + step) / 2).otherwise(F.coalesce(report, step, F.lit(0.0)))
