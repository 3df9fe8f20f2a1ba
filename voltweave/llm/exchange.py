"""Columns of numpy arrays sent through a Spark shuffle in blobs.

A mapper sorts its entries by bucket and writes one row per bucket that it has entries for, so the shuffle
moves few rows with long binary columns and a reducer sees whole arrays. A bucket is a hash of the entries'
key; the number of buckets follows the input's size, so a bucket's memory is the same at every scale.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import U64, mix

#: Entries that a mapper gathers before it writes blobs.
FLUSH_ENTRIES = 1 << 20
#: Buckets that a task may have to take one after another.
BUCKETS_A_TASK = 16


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys.astype(np.uint64) >> U64(20)) % U64(buckets)).astype(np.int64)


def bucket_of_ids(ids: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(mix(ids.astype(np.int64).view(np.uint64)), buckets)


def schema(fields: dict[str, str]) -> str:
    return "bucket long, kind int, " + ", ".join(f"{f} binary" for f in fields)


def blobs(fields: dict[str, str], bucket: np.ndarray, kind: int, **arrays: np.ndarray) -> pa.RecordBatch:
    """One row per bucket. fields: the dtype of each array."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    ordered = bucket[order]
    cut = np.flatnonzero(np.diff(ordered)) + 1 if len(ordered) else np.zeros(0, np.int64)
    start = np.concatenate([[0], cut]) if len(ordered) else np.zeros(0, np.int64)
    end = np.concatenate([cut, [len(ordered)]]) if len(ordered) else start
    columns = [pa.array(ordered[start], pa.int64()), pa.array(np.full(len(start), kind, np.int32))]
    for name, kind_of in fields.items():
        a = np.ascontiguousarray(arrays[name][order].astype(kind_of, copy=False))
        size = a.dtype.itemsize
        at = np.concatenate([start, end[-1:]]) * size if len(start) else np.zeros(1, np.int64)
        columns.append(pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(a.tobytes())]))
    return pa.record_batch(columns, names=["bucket", "kind", *fields])


def arrays(table: pa.Table | pa.RecordBatch, fields: dict[str, str], kind: int | None = None) -> dict[str, np.ndarray]:
    """All entries of some rows of blobs, of one kind if named."""
    if kind is not None:
        keep = np.flatnonzero(table.column("kind").to_numpy() == kind)
        table = table.take(pa.array(keep))
    out = {}
    for name, kind_of in fields.items():
        column = table.column(name)
        parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
        got = [np.frombuffer(x.as_py(), kind_of) for p in parts for x in p]
        out[name] = np.concatenate(got) if got else np.zeros(0, kind_of)
    return out


def reduce_buckets(df: DataFrame, fn: Callable[[pa.Table], pa.Table], out_schema: str, buckets: int = 0) -> DataFrame:
    """fn gets all rows of one bucket. There are partitions enough for a task to have few of so many buckets, whatever the session's setting."""
    least = -(-buckets // BUCKETS_A_TASK)
    if least > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(least, "bucket")
    return df.groupBy("bucket").applyInArrow(fn, out_schema)


class Gather:
    """Entries of a mapper until there are enough for a flush."""

    def __init__(self, fields: dict[str, str], limit: int = FLUSH_ENTRIES):
        self.fields, self.limit = fields, limit
        self.clear()

    def clear(self) -> None:
        self.parts: dict[str, list[np.ndarray]] = {f: [] for f in self.fields}
        self.size = 0

    def add(self, **arrays: np.ndarray) -> bool:
        """True if it is time to flush."""
        for name, a in arrays.items():
            self.parts[name].append(a.astype(self.fields[name], copy=False))
        self.size += len(next(iter(arrays.values())))
        return self.size >= self.limit

    def take(self) -> dict[str, np.ndarray]:
        out = {f: np.concatenate(p) if p else np.zeros(0, self.fields[f]) for f, p in self.parts.items()}
        self.clear()
        return out


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group starts in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def spans(start: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Start and end of each group among n entries."""
    return list(zip(start.tolist(), [*start[1:].tolist(), n][: len(start)], strict=True))
