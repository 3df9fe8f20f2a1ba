"""Registered queries of stored graphs, refused inputs, plans and streams, and the SQL that states their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixture
from .catalog import DEGREES, STEPS, SUMMARY, longs
from .config import DEFAULT_CONFIG, PRESETS, RuntimeAxes, SimulationConfig, resolve_axes, resolve_device
from .errors import DataSchemaError, EngineError, translated
from .functions.lif import checked_sub
from .functions.quantize import WeightQuantizer
from .operators import etl, graph as graphs
from .plans import planner, simulate
from .plans.oracle import BASE, graph_sql, unrolled
from .sources import artifact, blocks
from .sources.tables import Columns, one_each, scan_annotations, scan_edges
from .streaming.arrivals import arriving_current
from .work import work_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


EDGES_SQL = "SELECT CAST(source // 500 AS BIGINT) AS block_id, source, target, CAST(weight AS BIGINT) AS weight, CAST(delay AS BIGINT) AS delay FROM e"


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, dict]:
    """An artifact of the derived graph, and its manifest."""
    path = f"{work_dir(spark)}/artifact-{uuid.uuid4().hex}"
    return path, artifact.write_artifact(fixture.graph(spark, sf_dir, delays=True, ordered=True), path, dataset_id="derived")


@query(graph_sql(True) + DEGREES + "SELECT CAST(block_id AS BIGINT) AS block_id, source_start, source_count, edge_count, byte_size FROM z")
def artifact_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks as a published artifact's manifest, read back, names them."""
    path, _ = _stored(spark, sf_dir)
    names = ("block_id", "source_start", "source_count", "edge_count", "byte_size")
    rows = [tuple(b[c] for c in names) for b in artifact.read_manifest(spark, path)["blocks"]]
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))


@query(graph_sql(True) + EDGES_SQL)
def artifact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of an artifact that was written, opened and verified."""
    return longs(artifact.open_artifact(spark, _stored(spark, sf_dir)[0]).graph.edges, "block_id", "source", "target", "weight", "delay")


@query(graph_sql(True) + "SELECT id, body_id AS external_id FROM idx")
def artifact_neurons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of an artifact that was loaded and validated."""
    return longs(artifact.load_artifact(spark, _stored(spark, sf_dir)[0]).graph.neurons, "id", "external_id")


@query(graph_sql(True) + "SELECT CAST(block_id AS BIGINT) AS block_id, 'ChecksumMismatchError' AS error FROM (SELECT DISTINCT source // 500 AS block_id FROM e WHERE target % 1000 = 7)")
def artifact_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose rows differ from the manifest's digests after some weights are changed."""
    path, manifest = _stored(spark, sf_dir)
    edges = artifact.open_artifact(spark, path, verify_checksums=False).graph.edges
    changed = edges.withColumn("weight", F.when(F.col("target") % 1000 == 7, F.col("weight") + 1).otherwise(F.col("weight")))
    wanted = spark.createDataFrame([(b["block_id"], b["sha256"]) for b in manifest["blocks"]], "block_id int, wanted string")
    bad = artifact.block_digests(changed).join(wanted, "block_id").where("sha256 <> wanted")
    return bad.select(F.col("block_id").cast("long").alias("block_id"), F.lit("ChecksumMismatchError").alias("error"))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, data in zip(batch.column("block_id").to_pylist(), batch.column("data"), strict=True):
            start, offsets, targets, weights, delays = blocks.decode_block(data.as_py())
            source = np.repeat(start + np.arange(len(offsets) - 1), np.diff(offsets))
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in (np.full(len(source), block), source, targets, weights, delays)], names=["block_id", "source", "target", "weight", "delay"])


@query(graph_sql(True) + EDGES_SQL)
def block_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block encoded in the binary layout and decoded again."""
    encoded = artifact.encode_blocks(fixture.graph(spark, sf_dir, delays=True, ordered=True))
    return encoded.mapInArrow(_decoded, "block_id long, source long, target long, weight long, delay long")


@query(graph_sql(True) + DEGREES + "SELECT CAST(block_id AS BIGINT) AS block_id, byte_size FROM z")
def block_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each encoded block."""
    encoded = artifact.encode_blocks(fixture.graph(spark, sf_dir, delays=True, ordered=True))
    return encoded.select(F.col("block_id").cast("long").alias("block_id"), F.octet_length("data").cast("long").alias("byte_size"))


def _neurons_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.zeros(batch.num_rows, blocks.NEURON)
        rows["id"] = np.arange(batch.num_rows)  # a table's numbers are contiguous from zero
        for name in ("external_id", "type_code", "transmitter_code", "side_code"):
            rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
        again = blocks.decode_neurons(blocks.encode_neurons(rows), batch.num_rows)
        yield pa.record_batch([batch.column("id"), *(pa.array(again[c].astype(np.int64)) for c in ("external_id", "type_code", "transmitter_code", "side_code"))], names=["id", "external_id", "type_code", "transmitter_code", "side_code"])


@query(graph_sql(True) + "SELECT id, body_id AS external_id, CAST(body_id % 60000 AS BIGINT) AS type_code, CAST(body_id % 3 - 1 AS BIGINT) AS transmitter_code, CAST(body_id % 250 - 125 AS BIGINT) AS side_code FROM idx")
def neuron_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with codes of every size, encoded in the binary layout and decoded again."""
    at = F.col("external_id")
    nodes = fixture.graph(spark, sf_dir, delays=True).neurons.select("id", at.cast("long").alias("external_id"), (at % 60000).cast("long").alias("type_code"), (at % 3 - 1).cast("long").alias("transmitter_code"), (at % 250 - 125).cast("long").alias("side_code"))
    return nodes.mapInArrow(_neurons_again, "id long, external_id long, type_code long, transmitter_code long, side_code long")


@query(graph_sql(True) + "SELECT CAST(source // 64 AS BIGINT) AS block_id, source, target, CAST(weight AS BIGINT) AS weight, CAST(delay AS BIGINT) AS delay FROM e")
def graph_from_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph built from rows in any order, in blocks of 64 sources."""
    g = fixture.graph(spark, sf_dir, delays=True)
    made = graphs.from_frame(g.edges.select("source", "target", "weight", "delay"), g.n, 64)
    return longs(made.edges, "block_id", "source", "target", "weight", "delay")


@query(graph_sql(False) + DEGREES + """
, f AS (SELECT block_id, source_start + 1 - (block_id % 2) AS source_start, source_count FROM z)
, c AS (SELECT *, coalesce(sum(source_count) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected_start FROM f)
SELECT CAST(block_id AS BIGINT) AS block_id, CAST(source_start AS BIGINT) AS source_start, CAST(expected_start AS BIGINT) AS expected_start FROM c WHERE source_start <> expected_start""")
def block_contiguity_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of which the first and every second after it start one source too late."""
    g = fixture.graph(spark, sf_dir)
    found = graphs.block_descriptors(graphs.source_degrees(g.edges, g.neurons, g.block_size))
    return longs(graphs.contiguity_violations(found.withColumn("source_start", F.col("source_start") + 1 - F.col("block_id") % 2)), "block_id", "source_start", "expected_start")


def refusal(run: Callable[[], DataFrame]) -> str:
    """The name of the error that a query ends with, or accepted."""
    try:
        run().write.format("noop").mode("overwrite").save()
    except EngineError as error:
        return type(error).__name__
    except PySparkException as error:
        return type(translated(error)).__name__
    return "accepted"


@query(BASE + """
SELECT * FROM (
  SELECT 'good' AS name, 'accepted' AS outcome
  UNION ALL SELECT 'negative id', CASE WHEN (SELECT min(pre - 100) FROM w) < 0 THEN 'DataSchemaError' ELSE 'accepted' END
  UNION ALL SELECT 'null id', CASE WHEN (SELECT count(*) FROM w WHERE post % 11 = 0) > 0 THEN 'DataSchemaError' ELSE 'accepted' END
  UNION ALL SELECT 'text id', 'DataSchemaError'
  UNION ALL SELECT 'fractional weight', CASE WHEN (SELECT count(*) FROM lineitem WHERE l_extendedprice <> floor(l_extendedprice)) > 0 THEN 'DataSchemaError' ELSE 'accepted' END
  UNION ALL SELECT 'weight beyond 32 bits', CASE WHEN (SELECT max(raw_weight) FROM w) * 1e9 > 2147483647 THEN 'DataSchemaError' ELSE 'accepted' END
  UNION ALL SELECT 'delay of zero', CASE WHEN (SELECT min(delay - 1) FROM w) < 1 THEN 'DataSchemaError' ELSE 'accepted' END
  UNION ALL SELECT 'missing column', 'DataSchemaError'
  UNION ALL SELECT 'conflicting records', CASE WHEN (SELECT count(*) FROM a WHERE body_id % 10 = 0 AND type <> 'changed') > 0 THEN 'DataSchemaError' ELSE 'accepted' END
  UNION ALL SELECT 'label without a sign', CASE WHEN (SELECT count(*) FROM i WHERE nt = 'BUILDING') > 0 THEN 'DataSchemaError' ELSE 'accepted' END
  UNION ALL SELECT 'weight beyond 16 bits', CASE WHEN (SELECT max(raw_weight) FROM i) * 1000 > 32768 THEN 'QuantizationError' ELSE 'accepted' END
  UNION ALL SELECT 'too many categories', CASE WHEN (SELECT count(DISTINCT type) FROM a) + 1 > 20 THEN 'GraphValidationError' ELSE 'accepted' END
) AS r""")
def refused_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How whole tables with one fault each are refused."""
    weights, notes, _ = fixture.tables(spark, sf_dir)
    edges, one, labels = fixture.sources(spark, sf_dir)
    ids = fixture.index(spark, sf_dir)
    scan = lambda df, **names: lambda: scan_edges(df, Columns(**{**fixture.COLUMNS.__dict__, **names}))
    kept = etl.included(etl.label_edges(edges, labels), fixture.EXCLUDED)
    convert = lambda **changes: lambda: etl.indexed_edges(kept, ids, etl.Conversion(**{**fixture.CONVERSION.__dict__, **changes}))
    found = scan_annotations(notes, fixture.COLUMNS)
    cases = {
        "good": scan(weights),
        "negative id": scan(weights.withColumn("o_custkey", F.col("o_custkey") - 100)),
        "null id": scan(weights.withColumn("l_partkey", F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey")))),
        "text id": scan(weights.withColumn("o_custkey", F.col("o_custkey").cast("string"))),
        "fractional weight": scan(spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_suppkey", "o_custkey"), weight="l_extendedprice"),
        "weight beyond 32 bits": scan(weights.withColumn("l_quantity", F.col("l_quantity") * 1e9)),
        "delay of zero": scan(weights.withColumn("l_linenumber", F.col("l_linenumber") - 1), delay="l_linenumber"),
        "missing column": scan(weights.drop("l_quantity")),
        "conflicting records": lambda: one_each(found.union(found.where("body_id % 10 = 0").withColumn("type", F.lit("changed"))), ["type", "side"]),
        "label without a sign": convert(signs={k: v for k, v in fixture.SIGNS.items() if k != "BUILDING"}),
        "weight beyond 16 bits": convert(quantizer=WeightQuantizer(1000, 1)),
        "too many categories": lambda: etl.category_codes(one, "type", 20),
    }
    return spark.createDataFrame([(name, refusal(run)) for name, run in cases.items()], "name string, outcome string")


@query(graph_sql(False) + DEGREES + """
, b2 AS (SELECT CAST(sum(byte_size) + 28 * (SELECT count(*) FROM idx) AS BIGINT) AS resident, CAST(max(byte_size) + 28 * (SELECT count(*) FROM idx) AS BIGINT) AS streamed FROM z)
SELECT residency, CAST(slack AS BIGINT) AS slack, CASE residency WHEN 'resident' THEN resident ELSE streamed END AS required_bytes,
       CASE WHEN slack IS NULL THEN 'not tested' WHEN slack < 0 THEN 'insufficient' ELSE 'feasible' END AS capacity_status
FROM b2, (VALUES ('resident'), ('streamed')) AS r(residency), (VALUES (-1), (0), (5), (NULL)) AS s(slack)""")
def plan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the planner says of capacities just below, at and above the need, and of none."""
    g, rows = fixture.graph(spark, sf_dir), []
    for residency in ("resident", "streamed"):
        axes = RuntimeAxes(residency=residency)
        need = planner.plan(g, axes).required_bytes
        for slack in (-1, 0, 5, None):
            p = planner.plan(g, axes, capacity_bytes=None if slack is None else need + slack)
            rows.append((residency, slack, p.required_bytes, p.capacity_status))
    return spark.createDataFrame(rows, "residency string, slack long, required_bytes long, capacity_status string")


@query(graph_sql(True) + """
, p AS (SELECT target, delay, sum(CAST(weight AS BIGINT) * 2000000) OVER (PARTITION BY target, delay ORDER BY source, o) AS s FROM (SELECT *, row_number() OVER (ORDER BY source, target, raw_weight, delay) AS o FROM e))
SELECT target, CAST(delay AS BIGINT) AS arrive_t, count(*) AS n_sums, CAST(max(s) AS BIGINT) AS high, CAST(min(s) AS BIGINT) AS low FROM p WHERE s NOT BETWEEN -2147483648 AND 2147483647 GROUP BY target, delay""")
def overflowing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets that leave 32 bits after some edge, if every node spikes at step 0 and weights are two million times as large."""
    g = fixture.graph(spark, sf_dir, delays=True, ordered=True)
    edges = g.edges.withColumn("weight", F.col("weight").cast("long") * 2000000)
    bad = simulate.overflowing(g.neurons.select(F.lit(0).alias("emit_t"), "id"), edges, strict=True)
    return longs(bad.groupBy("target", "arrive_t").agg(F.count(F.lit(1)).alias("n_sums"), F.max("s").alias("high"), F.min("s").alias("low")), "target", "arrive_t", "n_sums", "high", "low")


@query(graph_sql(False) + "SELECT id, CAST(CASE WHEN body_id % 20 = 0 THEN 5000 ELSE 0 END AS BIGINT) AS v, CAST(0 AS BIGINT) AS refr FROM idx")
def initial_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture.graph(spark, sf_dir)
    return longs(simulate.initial_state(g, fixture.start(g)), "id", "v", "refr")


def _final(spark: SparkSession, sf_dir: str, residency: str = "resident") -> simulate.SimulationResult:
    g = fixture.graph(spark, sf_dir, delays=True)
    return simulate.simulate(g, fixture.CONFIG, timesteps=STEPS, initial=fixture.start(g), residency=residency)


@query(unrolled(True, STEPS) + f"SELECT count(*) FILTER (WHERE v <> 0) AS potentials, count(*) FILTER (WHERE refr <> 0) AS refractory FROM every WHERE t = {STEPS - 1}")
def final_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir).final_nonzero


@query(unrolled(True, STEPS) + SUMMARY)
def simulate_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that scans its edges at every step."""
    return _final(spark, sf_dir, "streamed").step_summary


@query(unrolled(True, STEPS) + "SELECT t, CAST(id // 65536 AS BIGINT) AS part, sha256(unhex(string_agg(CASE WHEN spike THEN '01' ELSE '00' END, '' ORDER BY id))) AS sha256 FROM every GROUP BY t, id // 65536")
def spike_range_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir).range_digests


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_partkey - l_suppkey AS BIGINT) AS difference FROM lineitem")
def checked_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return longs(lines.select("l_orderkey", "l_linenumber", checked_sub(F.col("l_partkey"), F.col("l_suppkey")).alias("difference")), "l_orderkey", "l_linenumber", "difference")


@query(graph_sql(True) + """
SELECT target, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS emitted_us, epoch_us(ts) + CAST(delay AS BIGINT) * 3600000000 AS arrive_us, CAST(sum(weight) AS BIGINT) AS current, count(*) AS n_spikes
FROM events JOIN idx ON user_id = body_id JOIN e ON e.source = idx.id WHERE event_type = 'error' GROUP BY ALL""")
def streamed_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as a stream of spikes of the users they name: what each sends, by hour of emission and time of arrival."""
    g = fixture.graph(spark, sf_dir, delays=True)
    path = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'")
    nodes = g.neurons.select("id", F.col("external_id").cast("long").alias("user_id"))
    events.select("ts", "user_id").join(nodes, "user_id").select("id", "ts").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("id long, ts timestamp_ntz" if dict(events.dtypes)["ts"] == "timestamp_ntz" else "id long, ts timestamp").parquet(f"{path}/in")
    sent = arriving_current(stream.withColumn("ts", F.col("ts").cast("timestamp")), g.edges, step="1 hour", late="10 seconds")
    save = lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/out")
    sent.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select("target", F.unix_micros("emitted_from").alias("emitted_us"), F.unix_micros("arrive_ts").alias("arrive_us"), "current", "n_spikes")


def _feather(spark: SparkSession, sf_dir: str) -> str:
    """The parts as an Arrow IPC file of several batches, in a folder that executors see."""
    folder = work_dir(spark)
    if not folder.startswith(("file:/", "/")):
        raise DataSchemaError("Arrow IPC files are read from a folder that every executor can open")
    path = f"{folder.removeprefix('file://')}/part-{uuid.uuid4().hex}.feather"
    table = spark.read.parquet(f"{sf_dir}/part.parquet").toArrow()
    with pa.ipc.new_file(path, table.schema) as writer:
        for batch in table.to_batches(max_chunksize=4096):
            writer.write_batch(batch)
    return path


@query("SELECT p_partkey, p_type, p_brand FROM part")
def feather_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of an Arrow IPC file."""
    from .sources.feather import read_feather

    return read_feather(spark, _feather(spark, sf_dir), ["p_partkey", "p_type", "p_brand"])


@query("""
SELECT * FROM (VALUES ('portable', 'cpu', 'resident', 'compact'), ('compact', 'auto', 'resident', 'compact'), ('accelerated', 'cuda', 'resident', 'full'), ('streamed', 'auto', 'streamed', 'full'), ('full', 'auto', 'resident', 'full')) AS p(preset, device, residency, scope)""")
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axes that each preset stands for."""
    rows = [(name, axes.device, axes.residency, axes.scope) for name in PRESETS if (axes := resolve_axes(preset=name))]
    return spark.createDataFrame(rows, "preset string, device string, residency string, scope string")


def _outcome(run: Callable[[], object]) -> str:
    try:
        run()
    except EngineError as error:
        return type(error).__name__
    return "accepted"


@query("""
SELECT * FROM (VALUES ('preset and the same axis', 'accepted'), ('preset and another axis', 'ConfigurationError'), ('unknown preset', 'ConfigurationError'), ('unknown device', 'ConfigurationError'), ('general processor', 'accepted'),
  ('device that is not driven', 'BackendNotImplementedError'), ('threshold beyond 32 bits', 'ConfigurationError'), ('shift of 32', 'ConfigurationError'), ('no shift', 'ConfigurationError'), ('both signed and excluded', 'ConfigurationError'),
  ('compact with annotations only', 'ConfigurationError'), ('quantizer without a denominator', 'ConfigurationError')) AS s(name, outcome)""")
def refused_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How settings that contradict each other or are out of range are refused."""
    cases = {
        "preset and the same axis": lambda: resolve_axes(preset="portable", device="cpu"), "preset and another axis": lambda: resolve_axes(preset="portable", device="cuda"), "unknown preset": lambda: resolve_axes(preset="none"),
        "unknown device": lambda: resolve_axes(device="abacus"), "general processor": lambda: resolve_device("auto"), "device that is not driven": lambda: resolve_device("cuda"),
        "threshold beyond 32 bits": lambda: SimulationConfig(2**31, 0, (2,), 0), "shift of 32": lambda: SimulationConfig(1, 0, (32,), 0), "no shift": lambda: SimulationConfig(1, 0, (), 0),
        "both signed and excluded": lambda: etl.Conversion(signs={"a": 1}, excluded=frozenset({"a"})), "compact with annotations only": lambda: etl.Conversion(signs={"a": 1}, node_filter="annotations", scope="compact"),
        "quantizer without a denominator": lambda: WeightQuantizer(1, 0),
    }
    return spark.createDataFrame([(name, _outcome(run)) for name, run in cases.items()], "name string, outcome string")


@query("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 1::BIGINT, 32767::BIGINT, 1::BIGINT), (0, 0, 2, -12000, 1), (0, 1, 3, 32767, 1)) AS e(block_id, source, target, weight, delay)")
def example_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in graph."""
    return longs(graphs.example(spark).edges, "block_id", "source", "target", "weight", "delay")


@query("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (1, 1), (2, 3)) AS s(t, id)")
def example_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes of four steps of the built-in graph from a high first node, block by block."""
    g = graphs.example(spark)
    stepper = simulate.Stepper(g, DEFAULT_CONFIG, g.neurons.select("id", F.when(F.col("id") == 0, 32767).otherwise(0).alias("v")))
    for _ in range(4):
        stepper.begin_step()
        stepper.schedule_block(0, 2)
        stepper.schedule_block(2, 2)
        stepper.finish_step()
    stepper.close()
    return longs(stepper.result.spikes, "t", "id")


@query(unrolled(True, STEPS) + "SELECT t, id, spike FROM every")
def spike_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's flag at every step."""
    return _final(spark, sf_dir).spike_matrix.select(F.col("t").cast("long").alias("t"), "id", "spike")


@query(graph_sql(True) + "SELECT id AS source, CAST(count(e.source) AS BIGINT) AS degree, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight_sum, CAST(coalesce(sum(target * delay), 0) AS BIGINT) AS mix FROM idx LEFT JOIN e ON e.source = idx.id GROUP BY id")
def adjacency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's edges as one array, told by its length and sums."""
    rows = graphs.adjacency(fixture.graph(spark, sf_dir, delays=True, ordered=True).resident())
    total = lambda f: F.aggregate("edges", F.lit(0).cast("long"), lambda a, e: a + f(e))
    return rows.select("source", F.size("edges").cast("long").alias("degree"), total(lambda e: e["weight"]).alias("weight_sum"), total(lambda e: e["target"] * e["delay"]).alias("mix"))


@query("SELECT column_name AS name, row_number() OVER () AS place FROM (DESCRIBE SELECT * FROM part)")
def feather_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of an Arrow IPC file, known without reading a row."""
    from .sources.feather import columns

    rows = [(name, k) for k, name in enumerate(columns(_feather(spark, sf_dir)), 1)]
    return spark.createDataFrame(rows, "name string, place long")
