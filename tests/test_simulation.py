import hashlib

import pytest
from pyspark.sql import functions as F

from voltweave.config import SimulationConfig
from voltweave.errors import BackendNotImplementedError, ConfigurationError, FixedPointOverflowError
from voltweave.operators.graph import Graph, example, from_rows
from voltweave.plans import simulate as simulation
from voltweave.plans.backends import backend_of
from voltweave.plans.simulate import Stepper, check_buckets, simulate

CONFIG = SimulationConfig(20000, 0, (2,), 2)


def potentials(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, v int")


def matrix(result):
    out = [[0] * result.n for _ in range(result.timesteps)]
    for r in result.spikes.collect():
        out[r["t"]][r["id"]] = 1
    return out


@pytest.mark.parametrize("residency", ["resident", "streamed"])
def test_golden_spike_train(spark, residency):
    r = simulate(example(spark), CONFIG, timesteps=4, initial=potentials(spark, (32767, 0, 0, 0)), residency=residency)
    assert matrix(r) == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0]]
    assert [(x["v"], x["refr"]) for x in r.final_state.orderBy("id").collect()] == [(0, 0), (0, 0), (-5062, 0), (0, 1)]
    flat = bytes(x for row in matrix(r) for x in row)
    assert r.spike_count == 3 and r.spike_digest == hashlib.sha256(flat).hexdigest() == "475b670dc697419ff0aab7d67ebffe5e0dd90a783af4e409c53611e84afd48a9"
    assert r.spike_matrix.count() == 16 and tuple(r.final_nonzero.first()) == (1, 1)


def plain(n, rows, config, steps, v, refr):
    """The same run in plain integers."""
    pending, out = {}, []
    for t in range(steps):
        spikes = []
        for k in range(n):
            current = pending.pop((t, k), 0)
            if refr[k] > 0:
                v[k], refr[k] = config.reset, refr[k] - 1
                spikes.append(0)
                continue
            y = v[k] + current
            for s in config.decay_shifts:
                y -= y >> s
            hit = y >= config.threshold
            v[k], refr[k] = (config.reset, config.refractory_steps) if hit else (y, 0)
            spikes.append(int(hit))
        for a, b, w, d in rows:
            if spikes[a]:
                pending[t + d, b] = pending.get((t + d, b), 0) + w
        out.append(spikes)
    return out, v, refr


def test_initial_refractory_counts(spark):
    initial = spark.createDataFrame([(0, 0, 1), (1, 20000, 0), (2, 0, 2), (3, 0, 0)], "id long, v int, refr int")
    r = simulate(example(spark), CONFIG, timesteps=3, initial=initial)
    rows = [(0, 1, 32767, 1), (0, 2, -12000, 1), (1, 3, 32767, 1)]
    wanted, v, refr = plain(4, rows, CONFIG, 3, [0, 20000, 0, 0], [1, 0, 2, 0])
    assert matrix(r) == wanted
    assert [(x["v"], x["refr"]) for x in r.final_state.orderBy("id").collect()] == list(zip(v, refr, strict=True))


def test_parallel_edges_self_loops_and_delays(spark):
    rows = [(0, 0, 5, 2), (0, 1, 9, 1), (0, 1, 9, 1), (0, 2, 30, 3), (1, 0, 7, 1), (1, 2, -4, 2), (2, 1, 20, 1)]
    c = SimulationConfig(10, 1, (3, 1), 1)
    r = simulate(from_rows(spark, 3, rows, 2), c, timesteps=7, initial=potentials(spark, (40, 0, 0)))
    wanted, v, refr = plain(3, rows, c, 7, [40, 0, 0], [0, 0, 0])
    assert matrix(r) == wanted
    assert [(x["v"], x["refr"]) for x in r.final_state.orderBy("id").collect()] == list(zip(v, refr, strict=True))


def test_two_node_delayed_run(spark):
    r = simulate(from_rows(spark, 2, [(0, 1, 8, 1)], 2), SimulationConfig(4, 0, (1,), 0), timesteps=2, initial=potentials(spark, (10, 0)))
    assert matrix(r) == [[1, 0], [0, 1]]


def test_no_steps_and_bad_states(spark):
    g = example(spark)
    r = simulate(g, CONFIG, timesteps=0)
    assert r.spike_count == 0 and r.final_state.count() == 4 and r.spike_digest == hashlib.sha256(b"").hexdigest()
    for bad in (potentials(spark, (1, 2)), spark.createDataFrame([(k, 0, -1) for k in range(4)], "id long, v int, refr int")):
        with pytest.raises(ConfigurationError):
            simulate(g, CONFIG, timesteps=1, initial=bad)
    with pytest.raises(ConfigurationError):
        simulate(g, CONFIG, timesteps=-1)


def test_potential_overflow_is_an_error(spark):
    g = from_rows(spark, 2, [(0, 1, 32767, 1)], 2)
    with pytest.raises(FixedPointOverflowError):
        simulate(g, SimulationConfig(2**31 - 1, 0, (31,), 0), timesteps=2, initial=potentials(spark, (2**31 - 1, 2**31 - 2)))


def test_strict_check_sees_what_a_total_hides(spark):
    edges = spark.range(140000).select((F.col("id") >= 70000).cast("long").alias("source"), F.col("id").alias("ord"), F.lit(2).cast("long").alias("target"), F.when(F.col("id") < 70000, 32767).otherwise(-32767).alias("weight"), F.lit(1).alias("delay"))
    spikes = spark.createDataFrame([(0, 0), (0, 1)], "emit_t int, id long")
    check_buckets(spikes, edges, strict=False)
    with pytest.raises(FixedPointOverflowError):
        check_buckets(spikes, edges, strict=True)
    with pytest.raises(FixedPointOverflowError):
        check_buckets(spikes.where("id = 0"), edges, strict=False)


def test_overflow_is_reported_at_the_step_that_causes_it(spark):
    """Two sources whose weights cancel: no total leaves 32 bits, but a sum does on the way."""
    n = 70000
    rows = [(0, 2, 32767, 3)] * n + [(1, 2, -32767, 3)] * n
    edges = spark.createDataFrame([(k, s, t, w, d) for k, (s, t, w, d) in enumerate(rows)], "ord long, source long, target long, weight int, delay int")
    g = Graph(from_rows(spark, 3, [], 3).neurons, edges.selectExpr("0 AS block_id", "*"), 3, 3)
    initial = potentials(spark, (30000, 30000, 0))
    with pytest.raises(FixedPointOverflowError):
        simulate(g, CONFIG, timesteps=1, initial=initial)
    assert simulate(g, CONFIG, timesteps=1, initial=initial, strict=False).spike_count == 2
    s = Stepper(g, CONFIG, initial)
    with pytest.raises(FixedPointOverflowError):
        s.begin_step()


def test_hubs_are_dealt_out_by_target(spark, monkeypatch):
    monkeypatch.setattr(simulation, "HUB_EDGES", 3)
    rows = sorted([(0, k % 7, 3 + k, 1 + k % 2) for k in range(40)] + [(k, (k * 5) % 7, 40, 2) for k in range(1, 7)])
    c = SimulationConfig(30, 0, (2,), 1)
    g = from_rows(spark, 7, rows, 3)
    many = simulation.hubs(g.edges)
    assert many.count() == 2 and simulation.dealt(g.edges, many).where("source = 0").select("delay", "part").distinct().count() > 4
    wanted, v, refr = plain(7, rows, c, 6, [50, 0, 0, 0, 0, 0, 0], [0] * 7)
    for residency in ("resident", "streamed"):
        r = simulate(g, c, timesteps=6, initial=potentials(spark, (50, 0, 0, 0, 0, 0, 0)), residency=residency)
        assert matrix(r) == wanted and [(x["v"], x["refr"]) for x in r.final_state.orderBy("id").collect()] == list(zip(v, refr, strict=True))


def test_long_delays_keep_spikes_in_a_table(spark):
    rows = [(0, 1, 50, 11), (0, 2, 50, 3), (1, 0, 90, 1), (2, 1, 5, 9)]
    c = SimulationConfig(30, 0, (2,), 1)
    r = simulate(from_rows(spark, 3, rows, 2), c, timesteps=14, initial=potentials(spark, (50, 0, 0)))
    assert matrix(r) == plain(3, rows, c, 14, [50, 0, 0], [0] * 3)[0]
    flags = [bytes(x) for x in matrix(r)]
    assert r.range_digest == hashlib.sha256(b"".join(hashlib.sha256(f).digest() for f in flags)).hexdigest()


def test_runs_leave_no_names_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    simulate(example(spark), CONFIG, timesteps=2, residency="streamed").spike_count
    assert {t.name for t in spark.catalog.listTables()} == before


def test_backends(spark):
    g, start = example(spark), potentials(spark, (32767, 0, 0, 0))
    for device in ("auto", "cpu"):
        backend = backend_of(device)
        assert backend.device == "cpu"
        assert matrix(backend.run(g, CONFIG, timesteps=2, initial=start)) == [[1, 0, 0, 0], [0, 1, 0, 0]]
    stepper = backend.stepper(g, CONFIG, start)
    stepper.begin_step()
    assert matrix(stepper.result) == [[1, 0, 0, 0]]
    with pytest.raises(BackendNotImplementedError):
        backend_of("cuda")
    with pytest.raises(ConfigurationError):
        backend_of("abacus")


def test_stepper_protocol(spark):
    s = Stepper(example(spark), CONFIG, potentials(spark, (32767, 0, 0, 0)))
    with pytest.raises(ConfigurationError):
        s.schedule_block(0, 2)
    s.begin_step()
    with pytest.raises(ConfigurationError):
        s.begin_step()
    with pytest.raises(ConfigurationError):
        s.schedule_block(1, 1)
    s.schedule_block(0, 2)
    with pytest.raises(ConfigurationError):
        s.finish_step()
    s.schedule_block(2, 2)
    s.finish_step()
    assert matrix(s.result) == [[1, 0, 0, 0]]


def test_streamed_spikes(spark, tmp_path):
    from voltweave.streaming.arrivals import arriving_current

    spark.createDataFrame([(0, "2024-01-01 00:00:00"), (0, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:00")], "id long, ts string").select("id", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))
    edges = spark.createDataFrame([(0, 1, 5, 1), (0, 2, -3, 2), (1, 2, 4, 1)], "source long, target long, weight int, delay int")
    stream = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = arriving_current(stream, edges).writeStream.outputMode("complete").format("memory").queryName("arrived").start()
    try:
        q.processAllAvailable()
        got = {(r["target"], r["arrive_ts"].second): r["current"] for r in spark.table("arrived").collect()}
    finally:
        q.stop()
    assert got == {(1, 1): 5, (1, 2): 5, (2, 2): -3, (2, 3): -3, (2, 1): 4}
