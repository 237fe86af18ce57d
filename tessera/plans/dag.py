"""Plans as tables: steps (plan_id, idx, status) and dependencies (plan_id, idx, dep), idx from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import tasks


def zero_based(deps: DataFrame, steps: DataFrame) -> DataFrame:
    """M8: dependencies that count from 1 (none names 0, and the greatest is the number of steps) count from 0 afterwards."""
    n = steps.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    low = deps.groupBy("plan_id").agg(F.least(F.min("idx"), F.min("dep")).alias("low"), F.greatest(F.max("idx"), F.max("dep")).alias("high"))
    by = low.join(n, "plan_id").select("plan_id", ((F.col("low") >= 1) & (F.col("high") >= F.col("n"))).cast("int").alias("shift"))
    return deps.join(by, "plan_id").select("plan_id", (F.col("idx") - F.col("shift")).alias("idx"), (F.col("dep") - F.col("shift")).alias("dep"))


def ready(steps: DataFrame, deps: DataFrame, parts: int | None = None) -> DataFrame:
    """(plan_id, idx): steps not started whose dependencies are all completed; one out of range never is. Rows meet in
    ``parts`` tasks; steps that are dealt out by (plan_id, idx) to as many stay where they are."""
    n = parts or tasks(steps.sparkSession)
    own = steps.select("plan_id", F.col("idx").alias("dep"), "status")
    d = deps.repartition(n, "plan_id", "dep").join(own, ["plan_id", "dep"], "left").select("plan_id", "idx", "status")
    ok = d.repartition(n, "plan_id", "idx").groupBy("plan_id", "idx").agg(F.every(F.coalesce(F.col("status") == "completed", F.lit(False))).alias("ok"))
    return steps.where("status = 'not_started'").join(ok, ["plan_id", "idx"], "left").where(F.coalesce("ok", F.lit(True))).select("plan_id", "idx")


def progress(steps: DataFrame) -> DataFrame:
    """A plan's five counters."""
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return steps.groupBy("plan_id").agg(F.count(F.lit(1)).alias("total"), one("completed"), one("in_progress"), one("blocked"), one("not_started"))


def closure(deps: DataFrame) -> DataFrame:
    """(plan_id, idx, dep): all direct and indirect dependencies; a step in a cycle depends on itself. A plan's own list is
    followed in one place, so dependencies are shuffled once, however long the chains."""
    import pyarrow as pa

    kind = deps.schema["plan_id"].dataType.simpleString()

    def follow(batches):  # noqa: ANN001, ANN202
        for b in batches:
            plans, idx, dep = [], [], []
            for k, pairs in enumerate(b.column(1).to_pylist()):
                needs: dict[int, list[int]] = {}
                for p in pairs:
                    needs.setdefault(p["idx"], []).append(p["dep"])
                for start in needs:
                    seen, todo = set(), list(needs[start])
                    while todo:
                        x = todo.pop()
                        if x not in seen:
                            seen.add(x)
                            todo += needs.get(x, ())
                    plans += [k] * len(seen)
                    idx += [start] * len(seen)
                    dep += seen
            yield pa.record_batch([b.column(0).take(pa.array(plans, pa.int64())), pa.array(idx, pa.int64()), pa.array(dep, pa.int64())], names=["plan_id", "idx", "dep"])

    whole = deps.where("idx is not null and dep is not null").groupBy("plan_id").agg(F.collect_set(F.struct(F.col("idx").cast("long").alias("idx"), F.col("dep").cast("long").alias("dep"))).alias("pairs"))
    out = whole.mapInArrow(follow, f"plan_id {kind}, idx long, dep long")
    return out.select("plan_id", F.col("idx").cast(deps.schema["idx"].dataType).alias("idx"), F.col("dep").cast(deps.schema["dep"].dataType).alias("dep"))


def claimable(events: DataFrame) -> DataFrame:
    """(plan_id, idx, ts, status): state changes that hold: completed never goes back."""
    from pyspark.sql import Window

    w = Window.partitionBy("plan_id", "idx").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max((F.col("status") == "completed").cast("int")).over(w), F.lit(0))
    return events.withColumn("done", done).where("done = 0").drop("done")


def rollout_metrics(events: DataFrame) -> DataFrame:
    """By plan what its events say."""
    one = lambda k, n: F.count_if(F.col("event_type") == k).alias(n)
    return events.groupBy("plan_id").agg(F.max((F.col("event_type") == "signup").cast("int")).alias("created"), one("purchase", "completed"), one("view", "searches"), F.max((F.col("event_type") == "click").cast("int")).alias("submitted"), one("error", "errors"))
