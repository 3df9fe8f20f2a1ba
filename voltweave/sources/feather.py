"""Arrow IPC ("Feather") files as a Spark data source: one input partition per record batch, columns pruned."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from ..errors import DataSchemaError

#: How unsigned 64-bit columns arrive, as Spark has no such type.
U64 = pa.decimal128(20, 0)


def local_file(path: str, label: str = "source") -> str:
    if not os.path.isfile(path):
        raise DataSchemaError(f"{label} is not a local file: {path}")
    return path


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    try:
        return pa.ipc.open_file(pa.memory_map(path))
    except (OSError, pa.ArrowInvalid) as error:
        raise DataSchemaError(f"cannot read Arrow IPC file: {path}") from error


def columns(path: str) -> tuple[str, ...]:
    """The column names; no row is read."""
    return tuple(_open(local_file(path)).schema.names)


def _plain(field: pa.Field) -> pa.Field:
    kind = field.type.value_type if pa.types.is_dictionary(field.type) else field.type
    kind = U64 if pa.types.is_uint64(kind) else pa.int64() if pa.types.is_uint32(kind) else pa.int32() if pa.types.is_uint16(kind) else kind
    return pa.field(field.name, kind)


class Batch(InputPartition):
    def __init__(self, number: int):
        self.number = number


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], batch_rows: int):
        self.path, self.names, self.batch_rows = path, names, batch_rows

    def partitions(self) -> list[Batch]:
        return [Batch(k) for k in range(_open(self.path).num_record_batches)]

    def read(self, partition: Batch):
        if not isinstance(partition, Batch):
            return
        batch = _open(self.path).get_batch(partition.number).select(self.names)
        fields = [_plain(f) for f in batch.schema]
        batch = pa.record_batch([c.cast(f.type) for c, f in zip(batch.columns, fields, strict=True)], schema=pa.schema(fields))
        for start in range(0, batch.num_rows, self.batch_rows):
            yield batch.slice(start, self.batch_rows)


class FeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather"

    def _names(self) -> list[str]:
        found = _open(local_file(self.options["path"])).schema.names
        wanted = [c for c in self.options.get("columns", "").split("\x1f") if c] or found
        if missing := [c for c in wanted if c not in found]:
            raise DataSchemaError(f"missing columns: {', '.join(missing)}")
        return wanted

    def schema(self):
        arrow = _open(local_file(self.options["path"])).schema
        return from_arrow_schema(pa.schema([_plain(arrow.field(c)) for c in self._names()]))

    def reader(self, schema) -> FeatherReader:
        return FeatherReader(self.options["path"], self._names(), int(self.options.get("batch_rows", 65536)))


def read_feather(spark: SparkSession, path: str, names: list[str] | None = None, *, batch_rows: int = 65536) -> DataFrame:
    """The named columns of a file that every executor can open at this path."""
    if batch_rows <= 0:
        raise ValueError("batch_rows must be positive")
    found = columns(path)
    if missing := [c for c in names or () if c not in found]:
        raise DataSchemaError(f"missing columns: {', '.join(missing)}")
    spark.dataSource.register(FeatherSource)
    reader = spark.read.format("feather").option("path", os.path.abspath(path)).option("batch_rows", batch_rows)
    return (reader.option("columns", "\x1f".join(names)) if names else reader).load()
