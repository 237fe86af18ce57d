"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Input partitions put their rows into random order by themselves and are written. How many rows each sends to each shard is then
drawn exactly as a uniform shuffle would: without replacement, the shards' sizes being the places that are left. A partition's
first so many rows go to shard 0, the next to shard 1, and so on; they are exchanged, and every shard is put into random order
again, spread over many tasks by a second random number whose counts give each task its first slot. No shard is ever in one task.

The matrix is drawn in two steps: the driver draws for at most ``GROUPS`` groups of partitions, tasks draw for the partitions of
a group. Law ``rows``: shards differ by one row at most, the first ones having more.

Equal texts and hot sources don't matter: rows move by drawn counts, not by value. All draws come from ``seed`` and the written
partitions, so a lost task gives the same rows again. Defined results: a null text has 8 bytes and checksum 0; null and repeated
ids are rows like others; an empty table gives no rows; columns of the input stay, but for those named like the results, which
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import new_path, written

GROUPS = 1024
MOST_SENT = 2_000_000
ROWS_A_TASK = 50_000
RESULTS = ("law", "shard", "slot", "grown_shard")


def log_chance(k: int, good: int, bad: int, n: int) -> float:
    """Log of the hypergeometric chance up to a constant of (good, bad, n), from factorials' logarithms."""
    return -sum(math.lgamma(x + 1) for x in (k, good - k, n - k, bad - n + k))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good: the library's draw within its range (10**9), else by ratio of uniforms."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    # points under a hat of the mode's chance; exact but for rounding of logarithms (about 1e-5 far from the mode)
    total = good + bad
    mean = n * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - n) / max(1, total - 1)) + 0.5)
    mode = min(max((n + 1) * (good + 1) // (total + 2), n - bad, 0), good, n)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if max(0, n - bad) <= k <= min(good, n) and 2 * math.log(u) <= _log_ratio(k, mode, good, bad, n):
            return k


def _log_ratio(k: int, m: int, good: int, bad: int, n: int) -> float:
    """log chance(k) - log chance(m): as a sum of logarithms of ratios where few, else by factorials' logarithms."""
    if abs(k - m) > 200_000:
        return log_chance(k, good, bad, n) - log_chance(m, good, bad, n)
    a, b = min(k, m), max(k, m)
    x = np.arange(a, b, dtype=np.float64)
    up = np.log((good - x) * (n - x) / ((x + 1) * (bad - n + x + 1))).sum()
    return float(up if k > m else -up)


def drawn(rng: np.random.Generator, rows: list[int], places: list[int]) -> list[list[int]]:
    """A matrix with these sums of rows and columns, as a uniform shuffle has it; rows are drawn one after another."""
    left, out = list(places), []
    for n in rows:
        free, row = sum(left), []
        for j, c in enumerate(left):
            free -= c
            x = hypergeometric(rng, c, free, n)
            row.append(x)
            left[j] -= x
            n -= x
        out.append(row)
    return out


def shard_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, upto array): how many of a partition's rows go to the shards up to each one."""
    spark = counts.sparkSession
    by_group = counts.groupBy((F.col("part") % GROUPS).alias("g")).agg(F.sum("n").alias("n")).orderBy("g").collect()
    places = shard_sizes(sum(r.n for r in by_group), shards)
    rows = drawn(np.random.default_rng([seed, 0]), [r.n for r in by_group], places)
    drawn_for = spark.createDataFrame([(r.g, row) for r, row in zip(by_group, rows, strict=True)], "g long, places array<long>")

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        m = drawn(np.random.default_rng([seed, 1, int(pdf.g.iloc[0])]), pdf.n.tolist(), list(pdf.places.iloc[0]))
        return pd.DataFrame({"part": pdf.part, "upto": [np.cumsum(r) for r in m]})

    x = counts.withColumn("g", F.col("part") % GROUPS).join(F.broadcast(drawn_for), "g")
    return x.groupBy("g").applyInPandas(of_group, "part long, upto array<long>")


def shuffled(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """The rows with law, shard (from 0), slot (gapless from 0 in each shard) and grown_shard (null: no law of keys)."""
    spark = df.sparkSession
    df = df.drop(*RESULTS)
    plain = df.columns
    own = [f"{c}__in" for c in plain]  # names of our own can't clash
    x = df.toDF(*own).withColumn("at__", F.monotonically_increasing_id())
    x = x.withColumn("key__", F.xxhash64(F.lit(seed), F.lit("first"), "at__")).sortWithinPartitions("key__", "at__").drop("key__", "at__")
    x = x.withColumn("m__", F.monotonically_increasing_id())
    x = written(x.select("*", F.shiftright("m__", 33).alias("part"), F.col("m__").bitwiseAND(F.lit((1 << 33) - 1)).alias("place__")), "permuted")
    matrix = written(_matrix(x.groupBy("part").agg(F.count(F.lit(1)).alias("n")), shards, seed), "matrix")
    size, parts = matrix.agg(F.coalesce(F.sum(F.element_at("upto", -1)), F.lit(0)), F.count(F.lit(1))).first()
    x = x.join(F.broadcast(matrix) if parts * shards <= MOST_SENT else matrix, "part")
    x = x.withColumn("shard", F.size(F.filter("upto", lambda u: u <= F.col("place__"))))
    tasks = max(-(-size // (shards * ROWS_A_TASK)), -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    x = x.withColumn("sub__", F.pmod(F.xxhash64(F.lit(seed), F.lit("second"), "m__"), F.lit(tasks)))
    first = x.groupBy("shard", "sub__").agg(F.count(F.lit(1)).alias("n__"))
    first = first.withColumn("first__", F.sum("n__").over(Window.partitionBy("shard").orderBy("sub__")) - F.col("n__")).drop("n__")
    x = x.drop("part", "place__", "upto").join(first, ["shard", "sub__"])
    order = Window.partitionBy("shard", "sub__").orderBy(F.xxhash64(F.lit(seed), F.lit("third"), "m__"), "m__")
    slot = F.col("first__") + F.row_number().over(order) - 1
    return x.select(*[F.col(a).alias(b) for a, b in zip(own, plain, strict=True)], F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, shards: int, path: str | None = None, seed: int = 0, rows_a_file: int = 1_000_000) -> str:
    """Writes the shuffled rows as Parquet folders ``shard=j``, whose files hold consecutive slots in order; gives the path."""
    x = shuffled(df, shards, seed)
    path = path or new_path(df.sparkSession, "shards")
    x = x.withColumn("file", F.floor(F.col("slot") / rows_a_file))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x.repartition(n, "shard", "file").sortWithinPartitions("shard", "file", "slot").write.partitionBy("shard", "file").parquet(path)
    return path
