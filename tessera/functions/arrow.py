"""Python functions over rows in Arrow batches, for what Spark has no expression for."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import tessera

cloudpickle.register_pickle_by_value(tessera)  # executors need no copy of the package


def values(a: pa.Array) -> list:
    """``a.to_pylist()``, by whole columns where Arrow has them as numbers, texts, lists, maps or structs of such: several times as fast."""
    kind, gaps = a.type, a.null_count
    if gaps == len(a):
        return [None] * len(a)
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        at = a.offsets.to_numpy().tolist()
        part = lambda x: values(x.slice(at[0], at[-1] - at[0]))
        flat = list(zip(part(a.keys), part(a.items), strict=True)) if pa.types.is_map(kind) else part(a.values)
        out: list = [None] * len(a)
        for i in np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False)).tolist():
            out[i] = flat[at[i] - at[0] : at[i + 1] - at[0]]
        return out
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, r, strict=True)) for r in zip(*map(values, a.flatten()), strict=True)] if names else a.to_pylist()
        for i in np.flatnonzero(a.is_null().to_numpy(zero_copy_only=False)).tolist() if gaps else ():
            out[i] = None
        return out
    if pa.types.is_integer(kind) or pa.types.is_float64(kind):
        out = (a.fill_null(0) if gaps else a).to_numpy().tolist()
        for i in np.flatnonzero(a.is_null().to_numpy(zero_copy_only=False)).tolist() if gaps else ():
            out[i] = None
        return out
    if pa.types.is_string(kind) or pa.types.is_boolean(kind):
        return a.to_numpy(zero_copy_only=False).tolist()  # null is None
    return a.to_pylist()


def tuples(b: pa.RecordBatch, size: int = 1 << 16) -> Iterator[tuple]:
    """A batch's rows, of which some ``size`` bytes at a time are Python values."""
    held = max(1, b.num_rows * size // max(1, b.nbytes))
    for i in range(0, b.num_rows, held):
        yield from zip(*(values(c) for c in b.slice(i, held).columns), strict=True)


def dicts(b: pa.RecordBatch, size: int = 1 << 16) -> Iterator[dict]:
    """A batch's rows as dicts, of which some ``size`` bytes at a time are Python values."""
    names = b.schema.names
    for r in tuples(b, size):
        yield dict(zip(names, r, strict=True))


def flat_map(df: DataFrame, one: Callable[..., Iterable[tuple]], ddl: str, held: int = 5000) -> DataFrame:
    """The rows (tuples of ``ddl``) that ``one`` makes of each row's values; at most ``held`` and one row's own are in memory,
    and some 64 KB of input rows as Python values."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [()] * len(schema)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for r in tuples(b):
                rows.extend(one(*r))
                if len(rows) >= held:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return df.mapInArrow(run, ddl)
