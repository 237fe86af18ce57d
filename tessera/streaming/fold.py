"""Folds: a state per key that each of its events moves on, in batch and on a stream, by the same step function.

``step(state, event)`` gets the state as a dict of JSON values (``start`` at first) and an event's columns as a dict; it changes
the state and gives a tuple of output values. In batch, events are shuffled by key and sorted within partitions, and one state at
a time is in memory, however many events a key has. A stream does the same with each micro-batch: of what has come, new or left
from before, the events that follow a key's last one without a gap are folded; the others wait in files, so arrival order does
not matter and what waits is never in memory: ``order`` counts a key's events from 1 without gaps.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tessera.functions.arrow import dicts

Step = Callable[[dict, dict], tuple]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # for processors with state


def folded(events: DataFrame, key: str, order: str, start: dict, step: Step, ddl: str, parts: int | None = None) -> DataFrame:
    """(key, order, and ``ddl``'s columns) of every event. Rows of a key and order beyond the first count as further events.
    ``parts``: tasks, where there are many keys and steps are slow; else Spark chooses by size."""
    head = [key, order]
    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in head)
    out = f"{kinds}, {ddl}"
    schema, fresh = to_arrow_schema(StructType.fromDDL(out)), pickle.dumps(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), {}
        for b in batches:
            rows = []
            for e in dicts(b):
                if e[key] != last:
                    last, state = e[key], pickle.loads(fresh)
                rows.append((e[key], e[order], *step(state, e)))
            cols = zip(*rows, strict=True) if rows else [()] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    dealt = events.where(F.col(key).isNotNull()).repartition(*([parts] if parts else []), key)
    return dealt.sortWithinPartitions(key, order).mapInArrow(run, out)


def resumed(events: DataFrame, states: DataFrame, key: str, order: str, start: dict, step: Step, schema: StructType) -> DataFrame:
    """``folded`` from where ``states`` (key, order, held__: JSON) ended. ``schema``: key, order and outputs. A key's last row is
    its new state: the order that comes next, the JSON in held__, no outputs; of other rows held__ is null."""
    whole = StructType([*schema.fields, StructField("held__", StringType())])
    arrow_schema, blank, fresh = to_arrow_schema(whole), (None,) * (len(schema) - 2), pickle.dumps(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [()] * len(arrow_schema)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, arrow_schema, strict=True)], schema=arrow_schema)

        last = state = None
        then = 1
        for b in batches:
            rows = []
            for e in dicts(b):
                if e[key] != last:
                    if last is not None:
                        rows.append((last, then, *blank, json.dumps(state)))
                    last, then = e[key], 1
                    state = pickle.loads(fresh) if e["held__"] is None else json.loads(e["held__"])
                if e["held__"] is None:
                    rows.append((last, e[order], *step(state, e), None))
                    then = e[order] + 1
                else:
                    then = e[order]
            yield out(rows)
        if last is not None:
            yield out([(last, then, *blank, json.dumps(state))])

    x = events.withColumn("held__", F.lit(None).cast("string")).unionByName(states, allowMissingColumns=True)
    return x.repartition(key).sortWithinPartitions(key, F.col("held__").isNull(), order).mapInArrow(run, whole)


@dataclass
class FoldedStream:
    """A fold of a stream of events; ``events.run_to_end`` runs it. Each micro-batch writes its version of what waits and of the
    states, and its outputs; one that runs again writes the same, so every event counts once."""

    events: DataFrame
    key: str
    order: str
    start: dict
    step: Step
    schema: StructType

    def run(self, path: str) -> DataFrame:
        spark, key, order = self.events.sparkSession, self.key, self.order
        came = StructType([*self.events.schema.fields, StructField("came__", LongType()), StructField("ready__", BooleanType())])
        done = StructType([*self.schema.fields, StructField("held__", StringType()), StructField("batch__", LongType()), StructField("kept__", BooleanType())])

        def micro(new: DataFrame, n: int) -> None:
            s = new.sparkSession

            def before(schema: StructType, name: str, part: str) -> DataFrame:
                own = StructType([f for f in schema if f.name not in ("batch__", "kept__", "ready__")])
                at = f"{path}/{name}/batch__={n - 1}/{part}"
                return s.read.schema(own).parquet(at) if n and _exists(s, at) else s.createDataFrame([], own)

            states = before(done, "data", "kept__=true").select(key, order, "held__")
            x = new.where(F.col(key).isNotNull()).withColumn("came__", F.lit(n).cast("long")).unionByName(before(came, "arrived", "ready__=false"))
            x = x.join(states.select(key, F.col(order).alias("next__")).hint("merge"), key, "left").withColumn("next__", F.coalesce("next__", F.lit(1))).where(F.col(order) >= F.col("next__"))
            by = Window.partitionBy(key).orderBy(order, "came__")
            x = x.withColumns({"again__": F.coalesce(F.lag(order).over(by) == F.col(order), F.lit(False)), "place__": F.dense_rank().over(Window.partitionBy(key).orderBy(order))})
            x = x.where("not again__").withColumn("ready__", F.col(order) == F.col("next__") + F.col("place__") - 1).select(*came.names)
            x.write.mode("overwrite").partitionBy("ready__").parquet(f"{path}/arrived/batch__={n}")
            here = f"{path}/arrived/batch__={n}/ready__=true"
            ready = s.read.schema(new.schema).parquet(here) if _exists(s, here) else s.createDataFrame([], new.schema)
            out = resumed(ready, states, key, order, self.start, self.step, self.schema)
            out.withColumn("kept__", F.col("held__").isNotNull()).write.mode("overwrite").partitionBy("kept__").parquet(f"{path}/data/batch__={n}")
            for old in (f"{path}/arrived/batch__={n - 2}", f"{path}/data/batch__={n - 2}/kept__=true"):  # a batch that runs again needs the one before it
                _exists(s, old, remove=True)

        q = self.events.writeStream.foreachBatch(micro).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        if not _exists(spark, f"{path}/data"):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(done).parquet(f"{path}/data").where("not kept__").select(*self.schema.names)


def _exists(spark: SparkSession, path: str, remove: bool = False) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.delete(at, True) if remove else fs.exists(at)


def folded_stream(events: DataFrame, key: str, order: str, start: dict, step: Step, ddl: str) -> FoldedStream:
    """The same on a stream; an event that comes twice counts once."""
    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in (key, order))
    return FoldedStream(events, key, order, start, step, StructType.fromDDL(f"{kinds}, {ddl}"))
