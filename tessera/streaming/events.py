"""Event streams, as batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.streaming.fold import FoldedStream


def changed(events: DataFrame, key: str, order: list[str], *payload: str) -> DataFrame:
    """Events whose payload differs from the one before of the same key (A, B, A all stay)."""
    fp = F.md5(F.to_json(F.struct(*sorted(payload)), {"ignoreNullFields": "false"}))
    prev = F.lag(fp).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("fp__", fp).withColumn("prev__", prev).where(~F.col("fp__").eqNullSafe(F.col("prev__"))).drop("fp__", "prev__")


def once(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event of each key."""
    return events.withColumn("rn__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn__ = 1").drop("rn__")


def tail_window(events: DataFrame, done: str, seconds: int = 180) -> DataFrame:
    """T4: a user's events up to its first ``done`` event and those of so many seconds after."""
    end = F.min(F.when(F.col("event_type") == done, F.col("ts"))).over(Window.partitionBy("user_id"))
    return events.withColumn("end__", end).where(F.col("end__").isNull() | (F.col("ts") <= F.col("end__") + F.make_dt_interval(secs=F.lit(seconds)))).drop("end__")


def stream_of(spark: SparkSession, path: str, name: str, schema) -> DataFrame:  # noqa: ANN001
    """T5: a table's files as a stream, one file a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(path)


def changed_stream(events: DataFrame, key: str = "user_id") -> DataFrame:
    """T2 on a stream: the state of a key is the fingerprint it sent last, 32 characters."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        keep = rows["fp"].ne(rows["fp"].shift(fill_value=last if last is not None else ""))
        state.update((rows["fp"].iloc[-1],))
        yield rows.loc[keep, ["event_id", key, "event_type", "fp"]]

    x = events.withColumn("fp", F.md5(F.col("event_type")))
    return x.groupBy(key).applyInPandasWithState(step, f"event_id long, {key} long, event_type string, fp string", "fp string", "append", GroupStateTimeout.NoTimeout)


def once_stream(events: DataFrame, keys: list[str], watermark: str = "1 day") -> DataFrame:
    """T3 on a stream: state goes as the watermark passes."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and type; late rows up to the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_to_end(stream: DataFrame | FoldedStream, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is into a Parquet sink with its own checkpoint (exactly once), and read it."""
    if isinstance(stream, FoldedStream):
        return stream.run(path)
    q = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
