"""Weights as 16-bit integers: exact rational scaling, ties to even."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import INT16
from ..errors import ConfigurationError, QuantizationError
from ..work import failing


def half_even(numerator: Column, denominator: int) -> Column:
    """numerator / denominator to the nearest integer, ties to even, by integer division alone."""
    size = F.abs(numerator)
    whole, rest = F.call_function("div", size, F.lit(denominator)), size % denominator
    up = (2 * rest > denominator) | ((2 * rest == denominator) & (whole % 2 == 1))
    return F.signum(numerator).cast("bigint") * (whole + up.cast("bigint"))


@dataclass(frozen=True)
class WeightQuantizer:
    """value * numerator / denominator in 16 bits; what does not fit is an error (reject) or clamped and flagged (saturate)."""

    numerator: int = 1
    denominator: int = 1
    overflow: str = "reject"

    def __post_init__(self):
        if self.numerator < 1 or self.denominator < 1 or self.overflow not in ("reject", "saturate"):
            raise ConfigurationError("quantizer needs positive terms and reject or saturate")

    def weight(self, value: Column) -> Column:
        q = half_even(value.cast("bigint") * self.numerator, self.denominator)
        if self.overflow == "saturate":
            return F.least(F.greatest(q, F.lit(INT16[0])), F.lit(INT16[1])).cast("smallint")
        return failing(~q.between(*INT16), QuantizationError, "a quantized weight is outside the signed 16-bit range", q).cast("smallint")

    def saturated(self, value: Column) -> Column:
        return ~half_even(value.cast("bigint") * self.numerator, self.denominator).between(*INT16)
