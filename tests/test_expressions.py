import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voltweave.config import SimulationConfig
from voltweave.errors import ConfigurationError, FixedPointOverflowError, QuantizationError, translated
from voltweave.functions.lif import advance, checked_add, shift_right, with_leak
from voltweave.functions.quantize import WeightQuantizer, half_even

I32 = st.integers(-(2**31), 2**31 - 1)


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} int" for k in values))


def reference(v, refr, current, c):
    """One transition in plain integers; None if it leaves 32 bits."""
    if refr > 0:
        return c.reset, refr - 1, False
    y = v + current
    for k in c.decay_shifts:
        if not -(2**31) <= y < 2**31:
            return None
        y -= y >> k
    if not -(2**31) <= y < 2**31:
        return None
    return (c.reset, c.refractory_steps, True) if y >= c.threshold else (y, 0, False)


def test_shift_floors_and_leak_composes(spark):
    row = with_leak(one(spark, v=-3), "v", (1,)).first()
    assert row["v"] == -1
    assert one(spark, v=-3).select(shift_right(F.col("v"), 1).alias("v")).first()["v"] == -2
    with pytest.raises(ConfigurationError):
        shift_right(F.col("v"), 32)


def test_addition_is_checked(spark):
    with pytest.raises(PySparkException) as e:
        one(spark, a=2**31 - 1, b=1).select(checked_add(F.col("a"), F.col("b"))).collect()
    assert isinstance(translated(e.value), FixedPointOverflowError)


def test_refractory_rows_discard_input_before_it_is_added(spark):
    c = SimulationConfig(10, 7, (2,), 3)
    row = advance(one(spark, v=2**31 - 1, refr=2, current=2**31 - 1), c).first()
    assert (row["v"], row["refr"], row["spike"]) == (7, 1, False)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(-(2**30), 2**30), st.integers(0, 3), st.integers(-(2**30), 2**30)), min_size=1, max_size=30), shifts=st.lists(st.integers(0, 31), min_size=1, max_size=3), threshold=st.integers(-1000, 100000))
def test_transition_equals_plain_integers(spark, rows, shifts, threshold):
    c = SimulationConfig(threshold, -5, tuple(shifts), 2)
    wanted = [reference(*r, c) for r in rows]
    rows = [(k, *r) for k, (r, w) in enumerate(zip(rows, wanted, strict=True)) if w is not None]
    got = advance(spark.createDataFrame(rows, "k int, v int, refr int, current int"), c).collect()
    assert {r["k"]: (r["v"], r["refr"], r["spike"]) for r in got} == {r[0]: wanted[r[0]] for r in rows}


def test_rounding_is_half_even(spark):
    rows = [(5, 2, 2), (7, 2, 4), (-5, 2, -2), (-7, 2, -4), (10**17 + 1, 2, 5 * 10**16), (1, 3, 0), (2, 3, 1), (0, 5, 0)]
    for n, d, wanted in rows:
        assert spark.createDataFrame([(n,)], "n long").select(half_even(F.col("n"), d).alias("q")).first()["q"] == wanted


def test_quantizer_rejects_or_saturates(spark):
    df = spark.createDataFrame([(1,), (-1,)], "v long")
    clamp = WeightQuantizer(40000, 1, "saturate")
    assert sorted(r["w"] for r in df.select(clamp.weight(F.col("v")).alias("w")).collect()) == [-32768, 32767]
    assert all(r["s"] for r in df.select(clamp.saturated(F.col("v")).alias("s")).collect())
    with pytest.raises(PySparkException) as e:
        df.select(WeightQuantizer(40000, 1).weight(F.col("v"))).collect()
    assert isinstance(translated(e.value), QuantizationError)
    with pytest.raises(ConfigurationError):
        WeightQuantizer(0, 1)
