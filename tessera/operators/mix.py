"""Mixing of samples: counts that are exact, picks by hash, so runs repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ordinals import running


def hash_order(seed: int, *keys: str) -> Column:
    """An order that looks random and depends on seed and keys alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def allowed(mode: Column, patterns: list[str]) -> Column:
    """a mode that is listed, or starts like a listed prefix*."""
    out = F.lit(False)
    for p in patterns:
        out = out | (mode.startswith(p[:-1]) if p.endswith("*") else mode == p)
    return out


def replay_count(primary: int, ratio: float) -> int:
    """How many replay samples make a share of ``ratio``: p r / (1 - r), rounded half to even, 1 at least."""
    if not 0 <= ratio < 1:
        raise ValueError(f"ratio {ratio} is not in [0, 1)")
    return max(1, round(primary * ratio / (1 - ratio))) if ratio else 0


def limit_count(n: int, reference: int, ratio: float, cap: int | None = None) -> int:
    """At most a ratio of the reference, and a cap."""
    out = min(n, max(1, int(reference * ratio)))
    return out if cap is None else min(out, cap)


def pick(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly n rows, the first by hash: a distributed top-n by a threshold, not a sort of all in one task.

    Hash prefixes are counted, the prefix in which the n-th row lies is found, and only its rows are ranked."""
    x = df.withColumn("h__", hash_order(seed, *keys)).withColumn("p__", F.substring("h__", 1, 3))
    counts = x.groupBy("p__").agg(F.count(F.lit(1)).alias("c")).orderBy("p__").collect()  # 4096 rows at most
    left, edge = n, None
    for r in counts:
        if r.c >= left:
            edge = r["p__"]
            break
        left -= r.c
    if edge is None:
        return df
    sure = x.where(F.col("p__") < edge)
    rest = x.where(F.col("p__") == edge).withColumn("rn__", F.row_number().over(Window.partitionBy("p__").orderBy("h__", *keys))).where(F.col("rn__") <= left).drop("rn__")
    return sure.union(rest).drop("h__", "p__")


def split(df: DataFrame, ratio: float, seed: int, *keys: str) -> DataFrame:
    """Val: exactly max(1, int(n * ratio)) rows."""
    n = df.count()
    val = pick(df, max(1, int(n * ratio)), seed, *keys).select(*keys, F.lit(True).alias("val"))
    return df.join(val, list(keys), "left").withColumn("val", F.coalesce("val", F.lit(False)))


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Every row so many times, numbered by repeat_index from 0."""
    return df.withColumn("repeat_index", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))


def first_of(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first of the rows with equal keys, in the given order."""
    return df.withColumn("rn__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn__ = 1").drop("rn__")


def canonical(df: DataFrame, *cols: str) -> Column:
    """A record's canonical JSON, keys sorted."""
    return F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})


def vision_key(images: Column, messages: Column) -> Column:
    """D3: what makes two samples with images the same: the images in order, the first message's text and the last one's."""
    text = lambda i: F.coalesce(F.try_element_at(messages, F.lit(i)), F.lit(""))
    return F.to_json(F.struct(F.coalesce(images, F.array().cast("array<string>")).alias("images"), text(1).alias("first"), text(-1).alias("last")))


def squeezed(text: Column) -> Column:
    """A text without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def stats(df: DataFrame, kind: str) -> DataFrame:
    """(primary, replay, total, achieved) of rows tagged primary or replay."""
    return df.agg(F.count_if(F.col(kind) == "primary").alias("n_primary"), F.count_if(F.col(kind) == "replay").alias("n_replay"), F.count(F.lit(1)).alias("n_total"), F.bround(F.count_if(F.col(kind) == "replay") / F.count(F.lit(1)), 6).alias("achieved"))


def renumbered(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Sources one after another; idx numbers their rows on, source by source."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("source_no", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    x, _ = running(out, ["source_no", *order], name="idx")
    return x.withColumn("idx", F.col("idx") - 1)
