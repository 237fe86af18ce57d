"""What the two vector operators share: cleaned vectors as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tessera.llm.common  # noqa: F401


def usable(emb: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, v): vectors as little-endian doubles; those that are null, empty, zero or hold null or non-finite parts are left out."""
    x = emb.where(F.col(col).isNotNull() & (F.size(col) > 0) & F.forall(col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))) & F.exists(col, lambda c: c != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = b.column(1)
                flat, off = a.flatten().to_numpy(zero_copy_only=False).astype("<f8"), np.asarray(a.offsets) - a.offsets[0].as_py()
                data = flat.tobytes()
                yield pa.record_batch([b.column(0), pa.array([data[8 * i : 8 * j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], names=["id", "v"])

    return x.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v")).mapInArrow(run, "id long, v binary")


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles from a column of bytes of one length."""
    return np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(-1, dim)
