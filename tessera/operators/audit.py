"""Summaries of scored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ordinals import at_ranks


def summary(scored: DataFrame, reward: str = "final_reward") -> DataFrame:
    """A2: count, mean, least and greatest reward, and rates of gates and caps."""
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    r = lambda c: F.bround(c, 6)
    return scored.agg(F.count(F.lit(1)).alias("n"), r(F.avg(reward)).alias("mean"), r(F.min(reward)).alias("low"), r(F.max(reward)).alias("high"), r(F.count_if(F.size("gates") > 0) / n).alias("gate_rate"), r(F.count_if(F.col("reward_cap") < 1) / n).alias("cap_rate"))


def frequencies(scored: DataFrame, tags: str = "gates", order: str = "doc_id") -> DataFrame:
    """A5: tags by count, then by where they came first."""
    x = scored.select(order, F.posexplode_outer(tags).alias("pos", "tag")).where("tag is not null")  # outer: no filter on the array is made up and pushed down
    return x.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "pos")).alias("first")).orderBy(F.desc("n"), "first").select("tag", "n")


def percentiles(df: DataFrame, col: str, shares: list[float]) -> DataFrame:
    """A3: (p, value): nearest-rank percentiles: the values at round((n - 1) p), half to even. Values are counted once, and all
    ranks are found in one pass over their running counts."""
    return at_ranks(df.groupBy(col).agg(F.count(F.lit(1)).alias("c")), col, "c", shares)


def histogram(df: DataFrame, col: str) -> DataFrame:
    """A4: (bin, n): tenths, cut down."""
    return df.groupBy(F.call_function("format_number", F.floor(F.col(col) * 10) / 10, F.lit("0.0")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def extremes(scored: DataFrame, col: str, k: int = 20) -> DataFrame:
    """The k worst reports (a report's list, by contract)."""
    return scored.orderBy(col, "doc_id").limit(k).select("doc_id", col)


def lengths(df: DataFrame, col: str) -> DataFrame:
    """Least, greatest and mean, rounded to 2 places."""
    return df.agg(F.min(col).alias("low"), F.max(col).alias("high"), F.bround(F.avg(col), 2).alias("mean"))
