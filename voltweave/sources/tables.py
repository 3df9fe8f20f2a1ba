"""Source tables under a caller's column names, validated while they are scanned."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import INT32, UINT64_MAX
from ..errors import DataSchemaError
from ..work import failing

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Columns:
    """Which source column has which role. Only the edge columns have defaults; None means there is no such column."""

    annotation_id: str
    label_id: str
    label_name: str
    annotation_type: str | None = None
    annotation_side: str | None = None
    pre: str = "body_pre"
    post: str = "body_post"
    weight: str = "weight"
    delay: str | None = None


def require(df: DataFrame, names: list[str]) -> None:
    if missing := [c for c in names if c not in df.columns]:
        raise DataSchemaError(f"missing columns: {', '.join(missing)}")


def _whole(df: DataFrame, name: str, low: int, high: int) -> Column:
    """An exact decimal; an error for nulls, fractions, booleans, strings and values out of range."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.NumericType):
        raise DataSchemaError(f"{name} must be numeric, not {kind.simpleString()}")
    column = F.col(f"`{name}`")
    fraction = F.isnan(column) | (column != F.floor(column)) if isinstance(kind, (T.FloatType, T.DoubleType)) else column != F.floor(column) if isinstance(kind, T.DecimalType) else F.lit(False)
    bad = column.isNull() | fraction | ~column.between(F.lit(Decimal(low)), F.lit(Decimal(high)))
    return failing(bad, DataSchemaError, f"{name} must be a whole number between {low} and {high}", column).cast("decimal(20,0)")


def body_id(df: DataFrame, name: str) -> Column:
    """An unsigned 64-bit id."""
    return _whole(df, name, 0, UINT64_MAX)


def raw_weight(df: DataFrame, name: str) -> Column:
    return _whole(df, name, *INT32).cast("int")


def category(name: str | None) -> Column:
    return F.lit(UNKNOWN) if name is None else F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(UNKNOWN))


def scan_edges(df: DataFrame, columns: Columns, delay: int = 1) -> DataFrame:
    """pre, post, raw_weight and delay, a row per source row: the graph is a multigraph."""
    require(df, [c for c in (columns.pre, columns.post, columns.weight, columns.delay) if c])
    step = F.lit(delay) if columns.delay is None else _whole(df, columns.delay, 1, 65535)
    return df.select(body_id(df, columns.pre).alias("pre"), body_id(df, columns.post).alias("post"), raw_weight(df, columns.weight).alias("raw_weight"), step.cast("int").alias("delay"))


def scan_annotations(df: DataFrame, columns: Columns) -> DataFrame:
    """body_id, type, side; not yet distinct."""
    require(df, [c for c in (columns.annotation_id, columns.annotation_type, columns.annotation_side) if c])
    return df.select(body_id(df, columns.annotation_id).alias("body_id"), category(columns.annotation_type).alias("type"), category(columns.annotation_side).alias("side"))


def scan_labels(df: DataFrame, columns: Columns) -> DataFrame:
    """body_id, nt; not yet distinct."""
    require(df, [columns.label_id, columns.label_name])
    return df.select(body_id(df, columns.label_id).alias("body_id"), category(columns.label_name).alias("nt"))


def conflicts(df: DataFrame, values: list[str]) -> DataFrame:
    """body_id of records that disagree."""
    return df.groupBy("body_id").agg(F.count_distinct(F.struct(*values)).alias("n_records")).where("n_records > 1").select("body_id", "n_records")


def one_each(df: DataFrame, values: list[str]) -> DataFrame:
    """One row per body_id; records that repeat collapse, records that disagree are an error. A single aggregate decides both."""
    low, high = F.min(F.struct(*values)), F.max(F.struct(*values))
    merged = df.groupBy("body_id").agg(low.alias("_low"), high.alias("_high"))
    same = failing(F.col("_low") != F.col("_high"), DataSchemaError, "conflicting records for one body id", F.col("_low"))
    return merged.select("body_id", same.alias("_same")).select("body_id", *(F.col(f"_same.{v}").alias(v) for v in values))
