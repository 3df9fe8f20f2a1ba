"""The leaky integrate-and-fire step as integer columns.

Spark's ANSI mode makes every 32-bit addition raise on overflow; require_ansi() insists on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SimulationConfig
from ..errors import ConfigurationError


def require_ansi(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.ansi.enabled") != "true":
        raise ConfigurationError("spark.sql.ansi.enabled must be true: overflow checks depend on it")


def checked_int(value: Column) -> Column:
    """A 32-bit value, or an error where it does not fit."""
    return value.cast("int")


def checked_add(a: Column, b: Column) -> Column:
    return a.cast("int") + b.cast("int")


def checked_sub(a: Column, b: Column) -> Column:
    return a.cast("int") - b.cast("int")


def shift_right(value: Column, places: int) -> Column:
    """Floors toward minus infinity; places 0 to 31."""
    if not 0 <= places <= 31:
        raise ConfigurationError("shift must be between 0 and 31")
    return F.shiftright(value, places)


def with_leak(df: DataFrame, column: str, shifts: tuple[int, ...]) -> DataFrame:
    """column less its own right shift, for each shift in turn; a projection each, so expressions do not double."""
    for k in shifts:
        df = df.withColumn(column, F.col(column) - shift_right(F.col(column), k))
    return df


def advance(df: DataFrame, config: SimulationConfig) -> DataFrame:
    """v, refr and current of each row become the next v and refr and a spike flag.

    A refractory row takes no input: the sum is not even formed for it, so it cannot overflow.
    """
    idle = F.col("refr") > 0
    df = with_leak(df.withColumn("_y", F.when(~idle, checked_add(F.col("v"), F.col("current")))), "_y", config.decay_shifts)
    df = df.withColumn("spike", F.coalesce(F.col("_y") >= config.threshold, F.lit(False)))
    reset = F.lit(config.reset).cast("int")
    v = F.when(idle | F.col("spike"), reset).otherwise(F.col("_y"))
    refr = F.when(idle, F.col("refr") - 1).when(F.col("spike"), F.lit(config.refractory_steps)).otherwise(F.lit(0)).cast("int")
    return df.withColumns({"v": v, "refr": refr}).drop("_y", "current")
