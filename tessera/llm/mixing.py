"""Mixing sources to target weights: iterative proportional fitting, by DataFrame operations only.

Documents fall into cells (source, language, topic). Cells' token weights are raked in turn to the target shares of
sources, languages and topics, over and over; no cell may get more weight than its tokens bear (a probability of 1), which
each round sees to, and what that takes away the next round gives to others. A document is kept with its cell's
probability, weight x budget / tokens, by a hash of its id: the same decision in every run, and a copy's is the same too.

One pass adds up tokens by cell (summed before the shuffle, so a source with a third of all rows is one partial sum a task),
raking works on cells, one pass samples. Raking goes on, ROUNDS rounds at a time, until no cell's weight moves by more than
TOLERANCE of itself over ROUNDS rounds (MOST times at most); ``unmet`` tells how far each value's share is from its target,
which is what the caps leave over. Cells are joined to documents by a shuffle unless they are few; the cells of most
documents are broadcast, fewer than 256 whatever the input.

Targets: each value's token share to the power ``flatten``, but no more than FULL of what the value has against a budget of
``keep`` of all tokens, the others sharing the rest in proportion; so they can be met without taking a document twice. Or
``targets`` (dimension, value, share), taken as they are: then the budget shrinks to FULL of the most that all values can bear.
``strict`` raises where a share still is further off.

Defined results: null source, language or topic is the value ''; null or empty text has no tokens and probability 1 (it
takes nothing from the budget); null ids share one draw; repeated rows are all kept or all dropped; no documents: no rows;
other columns stay as they are, but in ``mix`` input columns named topic, n_tokens, probability or kept give way to the
results (``sample`` returns them as they were).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import attach, written

DIMS = ("source", "lang", "topic")
ROUNDS, FLATTEN, KEEP, FULL, SEED = 8, 0.7, 0.8, 0.95, "mix-1"
TOLERANCE, MOST, FEW = 0.01, 40, 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: (topic, what a text of that topic contains); the first that fits.
TOPICS = [("licence", "icense"), ("table", " | "), ("shouting", "!!"), ("symbols", "%%%")]


def topic_of(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    out = None
    for name, mark in TOPICS:
        out = F.when(F.contains(t, F.lit(mark)), name) if out is None else out.when(F.contains(t, F.lit(mark)), name)
    return out.otherwise("prose")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from an id, 48 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def shares(cells: DataFrame, dim: str, flatten: float, targets: DataFrame | None, keep: float = KEEP) -> DataFrame:
    """(value, share) of a dimension. Values without a target keep their share of what the targets leave."""
    own = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
    every = Window.partitionBy()
    if targets is None and keep < FULL:
        # values are filled up in order of how little they can bear: those before the first that gets its full part are at their limit
        x = own.withColumns({"a": F.pow("tokens", F.lit(flatten)), "c": FULL / keep * F.col("tokens") / F.sum("tokens").over(every)}).withColumn("bears", F.col("c") / F.col("a"))
        order = Window.orderBy("bears", "value")  # a row a value
        taken = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        x = x.withColumn("part", (1 - taken) / F.sum("a").over(order.rowsBetween(0, Window.unboundedFollowing)))
        x = x.withColumn("part", F.min(F.when(F.col("part") <= F.col("bears"), F.struct("bears", "value", "part"))).over(every)["part"])
        x = x.withColumn("share", F.least(F.col("part") * F.col("a"), F.col("c")))
    elif targets is None:
        x = own.withColumn("share", F.pow("tokens", F.lit(flatten)))
    else:
        t = targets.where(F.col("dimension") == dim).select("value", F.col("share").cast("double").alias("share"))
        x = own.join(t, "value", "left")
        rest = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("share").over(every), F.lit(0.0)))
        left = F.sum(F.when(F.col("share").isNull(), F.col("tokens"))).over(every)
        x = x.withColumn("share", F.coalesce("share", rest * F.col("tokens") / left))
    return x.select("value", (F.col("share") / F.sum("share").over(every)).alias("share"))


def rake(cells: DataFrame, rounds: int = ROUNDS, flatten: float = FLATTEN, keep: float = KEEP, targets: DataFrame | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens, docs) with w, their share of the budget, cap, the most it may be, and t_source, t_lang
    and t_topic, the targets."""
    x = cells
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))
    x = x.crossJoin(F.broadcast(total)).withColumn("w", F.col("tokens") / F.col("total"))  # one row
    for d in DIMS:
        x = x.join(shares(cells, d, flatten, targets, keep).select(F.col("value").alias(d), F.col("share").alias(f"t_{d}")), d)
    x = written(x, "shares")
    borne = [x.groupBy(d).agg((F.sum("w") / F.first(f"t_{d}")).alias("k"), F.first(f"t_{d}").alias("t")).where("t > 0").select("k") for d in DIMS]
    most = borne[0].union(borne[1]).union(borne[2]).agg(F.least(F.lit(float(keep)), FULL * F.min("k")).alias("keep__"))
    x = written(x.crossJoin(F.broadcast(most)).withColumn("cap", F.col("w") / F.col("keep__")).drop("keep__"), "cells")  # one row
    # few cells are raked in one task, where windows need no shuffle; more are shuffled by each dimension
    few = x.count() <= FEW
    for _ in range(MOST):
        x = x.withColumn("before", F.col("w"))
        for r in range(rounds):
            x = x.coalesce(1) if few else x
            for d in DIMS:
                x = x.withColumn("w", F.col("w") * F.col(f"t_{d}") / F.sum("w").over(Window.partitionBy(d)))
            x = x.withColumn("w", F.least("w", "cap"))
            if r % 4 == 3 or r == rounds - 1:
                x = written(x, "raked")
        moved = x.agg(F.max(F.abs(F.col("w") - F.col("before")) / F.col("before"))).first()[0]
        if not moved or moved <= TOLERANCE:
            break
    return x.drop("before")


def worst(raked: DataFrame) -> float:
    """How far the share that is furthest off is from its target, in parts of the target."""
    x = unmet(raked).where("target > 0").agg(F.max(F.abs(F.col("share") / F.col("target") - 1))).first()[0]
    return float(x or 0.0)


def unmet(raked: DataFrame) -> DataFrame:
    """(dimension, value, target, share) of raked cells: the shares that the weights have."""
    every = F.sum("w").over(Window.partitionBy())
    parts = [raked.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.first(f"t_{d}").alias("target"), F.sum("w").alias("w")).select("dimension", "value", "target", (F.col("w") / every).alias("share")) for d in DIMS]
    return parts[0].union(parts[1]).union(parts[2])


def tokens_of(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """docs with their cell (source__, lang__, topic__) and tokens__."""
    value = lambda c: F.coalesce(c, F.lit(""))
    n = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("*", value(F.col("source")).alias("source__"), value(F.col("lang")).alias("lang__"), value(topic if topic is not None else topic_of(F.col("text"))).alias("topic__"), n.alias("tokens__"))


def cells_of(x: DataFrame) -> DataFrame:
    return x.where("tokens__ > 0").groupBy(*[F.col(f"{d}__").alias(d) for d in DIMS]).agg(F.sum("tokens__").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _weighed(docs: DataFrame, rounds: int, flatten: float, keep: float, targets: DataFrame | None, topic: Column | None, strict: float | None) -> DataFrame:
    x = tokens_of(docs, topic)
    raked = rake(written(cells_of(x), "tokens"), rounds, flatten, keep, targets)
    if strict is not None and (off := worst(raked)) > strict:
        raise ValueError(f"a share is {off:.3f} of its target off; see unmet()")
    p = written(raked.select(*[F.col(d).alias(f"{d}__") for d in DIMS], F.col("docs").alias("docs__"), (F.col("w") / F.col("cap")).alias("p__")), "p")
    y = attach(x, p, [f"{d}__" for d in DIMS], "docs__", F.col("doc_id"))
    prob = F.when(F.col("tokens__") > 0, F.least(F.col("p__"), F.lit(1.0))).otherwise(F.lit(1.0))
    return y.withColumn("p__", prob).withColumn("kept__", draw(F.col("doc_id")) < F.col("p__"))


def mix(docs: DataFrame, rounds: int = ROUNDS, flatten: float = FLATTEN, keep: float = KEEP, targets: DataFrame | None = None, topic: Column | None = None, strict: float | None = None) -> DataFrame:
    """docs with topic, n_tokens, probability and kept."""
    own = [c for c in docs.columns if c not in ("topic", "n_tokens", "probability", "kept")]
    new = [F.col(f"{a}__").alias(b) for a, b in (("topic", "topic"), ("tokens", "n_tokens"), ("p", "probability"), ("kept", "kept"))]
    return _weighed(docs, rounds, flatten, keep, targets, topic, strict).select(*own, *new)


def sample(docs: DataFrame, rounds: int = ROUNDS, flatten: float = FLATTEN, keep: float = KEEP, targets: DataFrame | None = None, topic: Column | None = None, strict: float | None = None) -> DataFrame:
    """The pipeline's form: the kept documents, as they were."""
    return _weighed(docs, rounds, flatten, keep, targets, topic, strict).where("kept__").select(*docs.columns)


def oracle(source: str = "documents") -> str:
    """The same in DuckDB's SQL, with flattened shares as targets: a recursion whose steps are rounds."""
    topic = " ".join(f"WHEN contains(coalesce(text, ''), '{m}') THEN '{n}'" for n, m in TOPICS)
    out = [f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topic} ELSE 'prose' END AS topic,
      coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens FROM {source})""", "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL)"]
    for k in DIMS:
        out.append(f"""t_{k} AS (SELECT {k}, least(part * a, c) AS t_{k} FROM (SELECT *, max(CASE WHEN i = first THEN l END) OVER () AS part FROM (SELECT *, min(CASE WHEN l <= c / a THEN i END) OVER () AS first
      FROM (SELECT *, row_number() OVER (ORDER BY c / a, {k}) AS i, (1 - coalesce(sum(c) OVER (ORDER BY c / a, {k} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(a) OVER (ORDER BY c / a, {k} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l
      FROM (SELECT {k}, pow(sum(tokens), {FLATTEN}) AS a, {FULL / KEEP} * sum(tokens) / sum(sum(tokens)) OVER () AS c FROM cells GROUP BY {k})))))""")
    borne = " UNION ALL ".join(f"SELECT sum(tokens) / any_value(total) / any_value(t_{k}) AS k FROM a GROUP BY {k}" for k in DIMS)
    out.append(f"""a AS (SELECT *, sum(tokens) OVER () AS total FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
    b AS (SELECT least({KEEP}, {FULL} * min(k)) AS keep FROM ({borne}))""")
    out.append("c AS (SELECT source, lang, topic, tokens / total AS w, tokens / total / keep AS cap, t_source, t_lang, t_topic FROM a, b)")
    step = f"(SELECT * EXCLUDE (w, before), w, CASE WHEN k % {ROUNDS} = 0 THEN w ELSE before END AS before FROM r WHERE NOT rests AND k < {ROUNDS * MOST})"
    for d in DIMS:
        step = f"(SELECT * EXCLUDE (w), w * t_{d} / sum(w) OVER (PARTITION BY {d}) AS w FROM {step})"
    cols = "source, lang, topic, cap, t_source, t_lang, t_topic"
    out.append(f"""r AS (SELECT 0 AS k, {cols}, w, w AS before, false AS rests FROM c
      UNION ALL SELECT k, {cols}, w, before, k % {ROUNDS} = 0 AND max(abs(w - before) / before) OVER () <= {TOLERANCE} AS rests
      FROM (SELECT k + 1 AS k, {cols}, least(w, cap) AS w, before FROM {step}))""")
    return "WITH RECURSIVE " + ",\n".join(out) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 12))::BIGINT / {float(1 << 48)} < p AS kept
FROM (SELECT d.*, CASE WHEN n_tokens > 0 THEN least(w / cap, 1.0) ELSE 1.0 END AS p
      FROM d LEFT JOIN (SELECT * FROM r WHERE k = (SELECT max(k) FROM r)) USING (source, lang, topic))"""
