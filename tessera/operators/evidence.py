"""Evidence for tasks: scoring, top-k, priority join, round robin, budgets, lexical retrieval.

Items are rows (task_id, ord, source_type, source_ref, title, urls, text); ``ord`` is the input order and breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.ordinals import running
from tessera.functions.shared import written

#: A final report's names, and what in a name hints at evidence.
FINAL_NAMES = ("最终报告", "final_report", "final-report", "final_answer", "final-answer")
FINAL_STAMP = r"20\d{6}[_-]\d{6}"
HINTS = ("检索", "来源", "验证", "资料", "证据", "图像分析", "应用场景", "URL", "url", "source", "evidence", "search")


def item_id(source_type: Column, task: Column, ref: Column, text: Column) -> Column:
    """The first 16 hex digits of a SHA-1 over type, task, reference and the text's first 500 characters."""
    return F.left(F.sha1(F.concat_ws("\n", source_type, task, ref, F.left(X.text(text), F.lit(500)))), F.lit(16))


def is_final_report(name: Column) -> Column:
    """by the name's stem: a hint, the words for final and report, or a time stamp."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    out = (F.contains(stem, F.lit("最终")) & F.contains(stem, F.lit("报告"))) | stem.rlike(FINAL_STAMP)
    for hint in FINAL_NAMES:
        out = out | F.contains(F.lower(stem), F.lit(hint))
    return out


def doc_score(name: Column, text: Column) -> Column:
    """O1's score: 5 for a URL, 2 for each hint that the name has as it stands or in lower case, -20 for a final report, 1 for
    over 500 characters."""
    hints = F.lit(0)
    for h in HINTS:
        hints = hints + (F.contains(name, F.lit(h)) | F.contains(F.lower(name), F.lit(h))).cast("int")
    return 5 * X.text(text).rlike(r"https?://[^\s)\]}>\"'。，；：！？]").cast("int") + 2 * hints - 20 * is_final_report(name).cast("int") + (F.length(X.text(text)) > 500).cast("int")


def top_docs(items: DataFrame, k: int, score: str = "score", size: str = "n_chars", name: str = "name") -> DataFrame:
    """O1: each task's k best, by score, then short, then name."""
    rn = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc(score), size, name))
    return items.withColumn("rank", rn).where(F.col("rank") <= k)


def distinct_items(items: DataFrame) -> DataFrame:
    """The first of the items with one id in a task."""
    rn = F.row_number().over(Window.partitionBy("task_id", "id").orderBy("ord"))
    return items.withColumn("rn__", rn).where("rn__ = 1").drop("rn__")


def ordered(items: DataFrame) -> DataFrame:
    """An item's place in its task: with URLs first, then traces', then many URLs, then short."""
    w = Window.partitionBy("task_id").orderBy(F.desc((F.col("url_count") > 0).cast("int")), F.desc((F.col("source_type") == "trace_tool").cast("int")), F.desc("url_count"), "n_chars", "ord")
    return items.withColumn("place", F.row_number().over(w))


def round_robin(items: DataFrame) -> DataFrame:
    """O3: four buckets (traces with URLs, workspaces with URLs, other traces, other workspaces) take turns; within one,
    many URLs first, then short."""
    trace, url = F.col("source_type") == "trace_tool", F.col("url_count") > 0
    b = F.when(trace & url, 0).when(url, 1).when(trace, 2).otherwise(3)
    x = items.withColumn("bucket", b)
    x = x.withColumn("turn", F.row_number().over(Window.partitionBy("task_id", "bucket").orderBy(F.desc("url_count"), "n_chars", "ord")))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("turn", "bucket")))


def fair_share(items: DataFrame, total: int, least: int = 320) -> DataFrame:
    """(task_id, packed array<struct<place, allowed, used>>): items in order get at least their share of the characters
    and what is left over a head; an item uses what its cut text has without blanks at the end; stops when all is used."""
    g = items.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("xs"))
    start = F.struct(F.lit(total).cast("int").alias("left"), F.lit(0).alias("i"), F.array().cast("array<struct<place:int,allowed:int,used:int>>").alias("out"))
    n = F.size("xs")

    def step(acc: Column, x: Column) -> Column:
        share = F.greatest(F.lit(least), F.floor(F.lit(total) / n).cast("int"))
        allowed = F.least(F.length(x["text"]), F.greatest(share, F.floor(acc["left"] / (n - acc["i"])).cast("int")), acc["left"])
        used = F.length(F.regexp_replace(F.left(x["text"], allowed), r"\s+$", ""))
        more = F.concat(acc["out"], F.array(F.struct(x["place"].cast("int").alias("place"), allowed.alias("allowed"), used.alias("used"))))
        done = acc["left"] <= 0
        return F.struct(F.when(done, acc["left"]).otherwise(acc["left"] - used).alias("left"), (acc["i"] + 1).alias("i"), F.when(done, acc["out"]).otherwise(more).alias("out"))

    return g.select("task_id", F.aggregate("xs", start, step, lambda a: a["out"]).alias("packed"))


def first_key(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """Tasks (task, keys array) with the items of the first of their keys that has any; tasks without stay."""
    k = tasks.select("task", F.posexplode("keys").alias("prio", "task_id")).where("task_id is not null")
    have = items.select("task_id").distinct()
    best = k.join(have, "task_id").groupBy("task").agg(F.min_by("task_id", "prio").alias("task_id"), F.min("prio").alias("prio"))
    return tasks.select("task").join(best, "task", "left").join(items, "task_id", "left")


def task_keys(qid: Column, id_: Column) -> Column:
    """J1's keys: qid, its last digits, id, its last digits; empty ones and repeats left out."""
    digits = lambda c: F.regexp_extract(X.text(c), r"(\d+)$", 1)
    return F.array_distinct(F.filter(F.array(qid, digits(qid), id_, digits(id_)), lambda x: x.isNotNull() & (x != "")))


#: Query tokens that are sent to the documents at a time (some 20 MB).
MOST_SENT = 400_000


def _sent_hits(docs: DataFrame, queries: list, k: int) -> DataFrame:
    """(item_id, doc_id, n, c): of documents (doc_id, n, ts) each partition's k best of each query, by tokens in common, then longer,
    then first. Counts come from the queries' posting lists; only the best so far are held."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = pa.array([r.item_id for r in queries])
    vocab = sorted({t for r in queries for t in r.ts})
    place = {t: i for i, t in enumerate(vocab)}
    pairs = np.array(sorted((place[t], q) for q, r in enumerate(queries) for t in r.ts), np.int64).reshape(-1, 2)
    start = np.searchsorted(pairs[:, 0], np.arange(len(vocab) + 1))
    n_queries = len(queries)
    sent = docs.sparkSession.sparkContext.broadcast((names, start, pairs[:, 1], np.diff(start), pa.array(vocab, pa.string())))

    def run(batches):  # noqa: ANN001, ANN202
        names, start, posting, size, known = sent.value
        best = [np.zeros(0, np.int64)] * 4  # query, count, length, document
        least = np.ones(n_queries, np.int64)
        for b in batches:
            lists = b.column(2)
            tokens = pc.index_in(lists.flatten(), known)
            doc = np.asarray(pc.list_parent_indices(lists))[np.asarray(tokens.is_valid())]
            tokens = np.asarray(tokens.drop_null()).astype(np.int64)
            for lo in range(0, b.num_rows, 64):
                at = slice(*np.searchsorted(doc, [lo, lo + 64]))
                t, many = tokens[at], size[tokens[at]]
                ends = np.cumsum(many)
                hit = posting[np.repeat(start[t] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]
                got = np.bincount(np.repeat(doc[at] - lo, many) * n_queries + hit, minlength=64 * n_queries).reshape(64, n_queries)
                d, q = np.nonzero(got >= least)
                own = [q, got[d, q], b.column(1).to_numpy()[lo + d], b.column(0).to_numpy()[lo + d]]
                best = [np.concatenate(x) for x in zip(best, own, strict=True)]
                order = np.lexsort((best[3], -best[2], -best[1], best[0]))
                best = [x[order] for x in best]
                first = np.searchsorted(best[0], best[0])
                rank = np.arange(len(first)) - first
                last = rank == k - 1
                least[best[0][last]] = best[1][last]
                best = [x[rank < k] for x in best]
        q, c, n, ids = best
        yield pa.record_batch([names.take(pa.array(q)), pa.array(ids), pa.array(n), pa.array(c)], names=["item_id", "doc_id", "n", "c"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n"), "ts").mapInArrow(run, "item_id long, doc_id long, n long, c long")


def retrieve(queries: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """(item_id, rank, doc_id, score): documents by the share of the query's tokens that they have, then longer, then
    first; fillers without a common token only where fewer than k have one. Documents and queries without an id don't count.

    k is held to 1 to 5. The queries go to the documents, a block of MOST_SENT tokens at a time, and a partition sends its k best
    of each query and nothing else; documents are cut into tokens once. No join on common words, whatever the number of queries.
    Fillers come from the k first documents, which every query could need."""
    k = min(max(k, 1), 5)
    q = queries.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), X.tokens(F.col("text")).alias("ts"))
    d = docs.select("doc_id", F.length("text").alias("n"), X.tokens(F.col("text")).alias("ts"))
    total = q.agg(F.sum(F.size("ts"))).first()[0] or 0
    if total <= MOST_SENT:
        hits = _sent_hits(d, q.collect(), k)
    else:
        d = written(d, "tokens")
        by, _ = running(q.withColumn("m", F.size("ts")), ["item_id"], "m")
        by = written(by.withColumn("block", F.floor((F.col("upto") - 1) / MOST_SENT)), "blocks")
        hits = None
        for block in range((total - 1) // MOST_SENT + 1):
            one = written(_sent_hits(d, by.where(F.col("block") == block).select("item_id", "ts").collect(), k), "hits")
            hits = one if hits is None else hits.unionAll(one)
    order = Window.partitionBy("item_id").orderBy(F.desc("c"), F.desc("n"), "doc_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = best.join(q.select("item_id", F.size("ts").alias("m")), "item_id").select("item_id", "doc_id", "n", F.bround(F.col("c") / F.col("m"), 6).alias("score"))
    fill = docs.select("doc_id", F.length("text").alias("n")).where("n is not null").orderBy(F.desc("n"), "doc_id").limit(2 * k)
    short = score.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    need = q.join(short, "item_id", "left").where(F.coalesce("c", F.lit(0)) < k).select("item_id")
    zero = need.crossJoin(F.broadcast(fill)).join(score.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti").select("item_id", "doc_id", "n", F.lit(0.0).alias("score"))
    rn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("n"), "doc_id"))
    return score.union(zero).withColumn("rank", rn).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def visual_top(items: DataFrame, k: int) -> DataFrame:
    """The first k items of a task that speak of images."""
    hit = items.where(F.lower(X.text(F.col("text"))).rlike("image|figure|chart|screenshot|图"))
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("ord"))).where(F.col("rank") <= k)


def admitted(items: DataFrame, tools: list[str], visual: list[str]) -> DataFrame:
    """a tool's result from an allowed tool, 80 characters or more, with a URL unless the tool sees or reads files."""
    t = X.text(F.col("text"))
    return items.where((F.col("role") == "tool") & F.col("tool_name").isin(tools + visual) & (F.length(t) >= 80) & (t.rlike("https?://") | F.col("tool_name").isin(visual)))


def coverage(tasks: DataFrame) -> DataFrame:
    """(tasks, covered, coverage) of tasks with has_evidence."""
    return tasks.agg(F.count(F.lit(1)).alias("tasks"), F.count_if("has_evidence").alias("covered"), F.bround(F.avg(F.col("has_evidence").cast("double")), 6).alias("coverage"))


def only_tasks(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Items of the given tasks; all, if none are given."""
    return items.join(tasks.select("task_id").distinct(), "task_id", "left_semi") if tasks.limit(1).count() else items


def capped(items: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` items of a task, in order, after duplicates went (the feature is the cap)."""
    return items.withColumn("rn__", F.row_number().over(Window.partitionBy("task_id").orderBy("ord"))).where(F.col("rn__") <= cap).drop("rn__")
