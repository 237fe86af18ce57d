"""Writers. Folders of part files; ``ord`` keeps the order across them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def jsonl(df: DataFrame, path: str, order: str = "ord", parts: int = 8) -> None:
    """K1, K8: JSON lines in order: ranges of ``order`` are sorted part files."""
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.mode("overwrite").json(path, ignoreNullFields=False)


def rows(df: DataFrame, path: str, copy: str | None = None, order: str = "ord") -> None:
    """K2: Parquet, and JSON lines if asked for."""
    df.write.mode("overwrite").parquet(path)
    if copy:
        jsonl(df.sparkSession.read.schema(df.schema).parquet(path), copy, order)


def corpus(items: DataFrame, path: str, per_task: int, per_text: int) -> dict:
    """K3: items flat and grouped by task, and a manifest of counts. A task has a bounded number of items by then."""
    rows(items, f"{path}/flat")
    spark = items.sparkSession
    flat = spark.read.schema(items.schema).parquet(f"{path}/flat")
    flat.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "title", "urls", "text"))).alias("items")).write.mode("overwrite").json(f"{path}/grouped")
    m = flat.agg(F.count(F.lit(1)).alias("items"), F.countDistinct("task_id").alias("tasks"), F.count_if(F.col("source_type") == "trace_tool").alias("trace_items")).first().asDict()
    m |= {"docs_per_task": per_task, "chars_per_doc": per_text}
    spark.createDataFrame([m]).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return m


def by_mode(samples: DataFrame, path: str, mode: str = "sample_mode") -> None:
    """K4: a folder for each mode."""
    samples.write.mode("overwrite").partitionBy(mode).json(path)


def appended(batch: DataFrame, path: str) -> None:
    """K5: for foreachBatch: a batch's traces, by plan and step, after what is there."""
    batch.groupBy("plan_id", "step").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")).write.mode("append").json(path)


@F.pandas_udf(StringType())
def scrubbed(values: pd.Series) -> pd.Series:
    """K6: JSON without save_mode and saveMode at any depth; what is no JSON stays as it is."""

    def walk(x):  # noqa: ANN001, ANN202
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items() if k not in ("save_mode", "saveMode")}
        return [walk(v) for v in x] if isinstance(x, list) else x

    def one(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(walk(json.loads(value)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return value

    return values.map(one)


def typed(df: DataFrame, path: str, kind: str) -> None:
    """K7: txt, md and html (one text column), csv, json, yaml (a list of flow mappings: each row's JSON)."""
    w = df.write.mode("overwrite")
    if kind in ("txt", "md", "html"):
        w.text(path)
    elif kind == "csv":
        w.option("header", True).csv(path)
    elif kind == "json":
        w.json(path)
    elif kind == "yaml":
        df.select(F.concat(F.lit("- "), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no writer for {kind}")
