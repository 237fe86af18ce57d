"""Exact running numbers and sums over a whole table, by ranges: rows are range-sorted and written once, each part's total goes
to the driver (a number a part), and a row's number is what the parts before hold and its place in its own part. No row meets
another in a join, and no task sees more than its part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import written


def running(df: DataFrame, order: list[str | Column], weight: str | None = None, name: str = "upto") -> tuple[DataFrame, int]:
    """The rows with the sum of ``weight`` (or the count) of all rows up to each one, itself included; and the total. Rows that
    ``order`` doesn't tell apart come one after another in some order that is the same whenever the result is read."""
    x = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m__", F.monotonically_increasing_id())
    x = written(x, "ranges").withColumn("part__", F.shiftright("m__", 33))
    total, offsets = 0, []
    for part, n in sorted(map(tuple, x.groupBy("part__").agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long")).collect())):
        offsets.append((part, total))
        total += n or 0
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "part__ long, before__ long"))
    if weight:
        own = F.sum(weight).over(Window.partitionBy("part__").orderBy("m__"))
    else:
        own = F.col("m__").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return x.join(base, "part__").withColumn(name, (F.col("before__") + own).cast("long")).drop("part__", "m__", "before__"), total


def at_ranks(counts: DataFrame, value: str, count: str, shares: list[float]) -> DataFrame:
    """(p, value): for each share the value at rank round((n - 1) p), half to even, of a table of values and how often each
    occurs. All ranks are picked in one pass over the running counts."""
    x, n = running(counts.where(F.col(value).isNotNull()).select(F.col(value).alias("value"), F.col(count).alias("c__")), ["value"], "c__")
    ranks = [F.struct(F.lit(float(p)).alias("p"), F.lit(round((n - 1) * p)).cast("long").alias("at")) for p in shares] if n else []
    if not ranks:
        return x.select(F.lit(0.0).alias("p"), "value").limit(0)
    hit = F.filter(F.array(*ranks), lambda r: (r["at"] < F.col("upto")) & (r["at"] >= F.col("upto") - F.col("c__")))
    return x.select("value", F.explode(hit).alias("r")).select("r.p", "value")
