"""Registered queries of the graph engine, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixture
from .functions.lif import with_leak
from .functions.quantize import WeightQuantizer
from .operators import etl, graph as graphs
from .plans import planner, simulate
from .plans.oracle import BASE, graph_sql, unrolled
from .sources.tables import conflicts, one_each, scan_annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
STEPS = 4


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(n).cast("long").alias(n) for n in names))


@query(BASE + "SELECT pre, post, CAST(raw_weight AS BIGINT) AS raw_weight, CAST(delay AS BIGINT) AS delay FROM w")
def edge_scan_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(fixture.sources(spark, sf_dir, delays=True)[0], "pre", "post", "raw_weight", "delay")


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = scan_annotations(fixture.tables(spark, sf_dir)[1], fixture.COLUMNS)
    return notes.union(notes)


@query(BASE + "SELECT DISTINCT body_id, type, side FROM (SELECT * FROM a UNION ALL SELECT * FROM a)")
def annotation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_each(_twice(spark, sf_dir), ["type", "side"]).select(F.col("body_id").cast("long").alias("body_id"), "type", "side")


@query(BASE + """
SELECT body_id, CAST(count(DISTINCT (type, side)) AS BIGINT) AS n_records
FROM (SELECT * FROM a UNION ALL SELECT body_id, 'changed', side FROM a WHERE body_id % 10 = 0) GROUP BY body_id HAVING count(DISTINCT (type, side)) > 1""")
def annotation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = scan_annotations(fixture.tables(spark, sf_dir)[1], fixture.COLUMNS)
    changed = notes.where("body_id % 10 = 0").withColumn("type", F.lit("changed"))
    return longs(conflicts(notes.union(changed), ["type", "side"]), "body_id", "n_records")


@query(BASE + "SELECT pre, nt, count(*) AS n_edges, CAST(sum(raw_weight) AS BIGINT) AS raw_sum FROM x GROUP BY pre, nt")
def label_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, labels = fixture.sources(spark, sf_dir)
    out = etl.label_edges(edges, labels).groupBy("pre", "nt").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("raw_weight").alias("raw_sum"))
    return out.select(F.col("pre").cast("long").alias("pre"), "nt", "n_edges", "raw_sum")


def _universe(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    edges, notes, labels = fixture.sources(spark, sf_dir)
    conversion = etl.Conversion(**{**fixture.CONVERSION.__dict__, **changes})
    kept = etl.included(etl.label_edges(edges, labels), conversion.excluded)
    return longs(etl.node_universe(edges, kept, notes, conversion), "body_id")


@query(BASE + "SELECT body_id FROM u")
def node_universe_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir)


@query(BASE + "SELECT pre AS body_id FROM i UNION SELECT post FROM i")
def node_universe_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir, scope="compact")


@query(BASE + "SELECT body_id FROM a")
def node_universe_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir, node_filter="annotations")


@query(BASE + "SELECT body_id FROM (SELECT pre AS body_id FROM w UNION SELECT post FROM w) EXCEPT SELECT body_id FROM a WHERE body_id % 4 < 3")
def unannotated_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, notes, _ = fixture.sources(spark, sf_dir)
    return longs(etl.unannotated_endpoints(edges, notes.where("body_id % 4 < 3")), "body_id")


@query(BASE + "SELECT body_id, id FROM idx")
def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(fixture.index(spark, sf_dir), "body_id", "id")


CODES = "SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT {0} AS label FROM a UNION SELECT 'unknown')"


@query(BASE + CODES.format("type"))
def type_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.category_codes(fixture.sources(spark, sf_dir)[1], "type", etl.MOST_TYPES).select("label", F.col("code").cast("long").alias("code"))


@query(BASE + CODES.format("side"))
def side_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.category_codes(fixture.sources(spark, sf_dir)[1], "side", etl.MOST_SIDES).select("label", F.col("code").cast("long").alias("code"))


@query(BASE + f"""
, tc AS ({CODES.format('type')}), sc AS ({CODES.format('side')})
SELECT id, body_id AS external_id, tc.code AS type_code, CAST(coalesce(sign, 0) AS BIGINT) AS transmitter_code, sc.code AS side_code
FROM idx LEFT JOIN a USING (body_id) LEFT JOIN l USING (body_id) LEFT JOIN g ON g.nt = coalesce(l.nt, 'unknown')
JOIN tc ON tc.label = coalesce(a.type, 'unknown') JOIN sc ON sc.label = coalesce(a.side, 'unknown')""")
def neuron_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, notes, labels = fixture.sources(spark, sf_dir)
    return longs(etl.neuron_table(fixture.index(spark, sf_dir), notes, labels, fixture.SIGNS), "id", "external_id", "type_code", "transmitter_code", "side_code")


@query(BASE + "SELECT pre, post, CAST(raw_weight AS BIGINT) AS raw_weight FROM w WHERE pre IN (SELECT body_id FROM a WHERE body_id % 4 < 3) AND post IN (SELECT body_id FROM a WHERE body_id % 4 < 3)")
def semi_filtered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, notes, _ = fixture.sources(spark, sf_dir)
    return longs(etl.filter_edges(edges, notes.where("body_id % 4 < 3"), "annotations"), "pre", "post", "raw_weight")


def _quantized(spark: SparkSession, sf_dir: str, quantizer: WeightQuantizer) -> DataFrame:
    edges, _, labels = fixture.sources(spark, sf_dir)
    kept = etl.included(etl.label_edges(edges, labels), fixture.EXCLUDED)
    signed = F.col("raw_weight").cast("bigint") * etl.sign_of(F.col("nt"), fixture.SIGNS)
    return longs(kept.select("pre", "post", "raw_weight", quantizer.weight(signed).alias("weight"), quantizer.saturated(signed).cast("int").alias("saturated")), "pre", "post", "raw_weight", "weight", "saturated")


QUANTIZED = """
SELECT pre, post, CAST(raw_weight AS BIGINT) AS raw_weight, CAST(least(greatest(q, -32768), 32767) AS BIGINT) AS weight, CAST(q < -32768 OR q > 32767 AS BIGINT) AS saturated
FROM (SELECT *, sign * ((abs(m) // {den}) + CASE WHEN 2 * (abs(m) % {den}) > {den} OR (2 * (abs(m) % {den}) = {den} AND (abs(m) // {den}) % 2 = 1) THEN 1 ELSE 0 END) AS q
      FROM (SELECT i.*, g.sign, CAST(raw_weight AS BIGINT) * {num} AS m FROM i JOIN g USING (nt)))"""


@query(BASE + QUANTIZED.format(num=10, den=1))
def signed_quantized_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantized(spark, sf_dir, WeightQuantizer(10, 1))


@query(BASE + QUANTIZED.format(num=1, den=2))
def quantize_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantized(spark, sf_dir, WeightQuantizer(1, 2))


@query(BASE + QUANTIZED.format(num=1000, den=1))
def quantize_saturate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantized(spark, sf_dir, WeightQuantizer(1000, 1, "saturate"))


@query(BASE + """
SELECT (SELECT count(*) FROM u) AS n_neurons, (SELECT count(*) FROM i) AS n_edges, (SELECT count(*) FROM x) - (SELECT count(*) FROM i) AS excluded_edges,
       (SELECT count(*) FROM i WHERE raw_weight * 1000 > 32767 + (nt = 'BUILDING')::INT) AS saturated_weights""")
def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversion = etl.Conversion(**{**fixture.CONVERSION.__dict__, "quantizer": WeightQuantizer(1000, 1, "saturate")})
    return longs(etl.convert(*fixture.tables(spark, sf_dir), fixture.COLUMNS, conversion).report, "n_neurons", "n_edges", "excluded_edges", "saturated_weights")


@query(graph_sql(False) + "SELECT source, target, CAST(weight AS BIGINT) AS weight, row_number() OVER (ORDER BY source, target, raw_weight) - 1 AS ord FROM e")
def edge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(fixture.graph(spark, sf_dir, ordered=True).edges, "source", "target", "weight", "ord")


DEGREES = """
, d AS (SELECT id // 500 AS block_id, id AS source, count(e.source) AS deg FROM idx LEFT JOIN e ON e.source = idx.id GROUP BY id)
, b AS (SELECT block_id, min(source) AS source_start, count(*) AS source_count, CAST(sum(deg) AS BIGINT) AS edge_count FROM d GROUP BY block_id)
, z AS (SELECT *, CAST(20 + 4 * (source_count + 1) + 8 * edge_count AS BIGINT) AS byte_size FROM b)
"""


def _degrees(spark: SparkSession, sf_dir: str) -> tuple[graphs.Graph, DataFrame]:
    g = fixture.graph(spark, sf_dir)
    return g, graphs.source_degrees(g.edges, g.neurons, g.block_size)


@query(graph_sql(False) + DEGREES + "SELECT CAST(block_id AS BIGINT) AS block_id, source_start, source_count, edge_count, byte_size FROM z")
def block_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(graphs.block_descriptors(_degrees(spark, sf_dir)[1]), "block_id", "source_start", "source_count", "edge_count", "byte_size")


@query(graph_sql(False) + DEGREES + """
SELECT CAST(block_id AS BIGINT) AS block_id, source, CAST(sum(deg) OVER o - deg AS BIGINT) AS row_start, CAST(sum(deg) OVER o AS BIGINT) AS row_end
FROM d WINDOW o AS (PARTITION BY block_id ORDER BY source)""")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(graphs.csr_offsets(_degrees(spark, sf_dir)[1]), "block_id", "source", "row_start", "row_end")


@query(graph_sql(False) + DEGREES + """
, o AS (SELECT block_id, source, CAST(sum(deg) OVER o - deg AS BIGINT) + (source % 7 = 3)::INT AS row_start, CAST(sum(deg) OVER o AS BIGINT) AS row_end FROM d WINDOW o AS (PARTITION BY block_id ORDER BY source))
SELECT CAST(block_id AS BIGINT) AS block_id, source, row_start, row_end
FROM (SELECT *, coalesce(lag(row_end) OVER (PARTITION BY block_id ORDER BY source), 0) AS before FROM o) WHERE row_start <> before OR row_end < row_start""")
def csr_offset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of which every seventh is made wrong."""
    offsets = graphs.csr_offsets(_degrees(spark, sf_dir)[1]).withColumn("row_start", F.col("row_start") + (F.col("source") % 7 == 3).cast("int"))
    return longs(graphs.offset_violations(offsets), "block_id", "source", "row_start", "row_end")


@query(graph_sql(False) + DEGREES + ", c AS (SELECT *, coalesce(sum(source_count) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected_start FROM z) SELECT CAST(block_id AS BIGINT) AS block_id, source_start, CAST(expected_start AS BIGINT) AS expected_start FROM c WHERE source_start <> expected_start")
def block_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(graphs.contiguity_violations(graphs.block_descriptors(_degrees(spark, sf_dir)[1])), "block_id", "source_start", "expected_start")


@query(graph_sql(True) + "SELECT CAST(coalesce(min(delay), 0) AS BIGINT) AS min_delay, CAST(coalesce(max(delay), 0) AS BIGINT) AS max_delay FROM e")
def delay_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.delay_bounds(fixture.graph(spark, sf_dir, delays=True).edges)


@query(graph_sql(False) + DEGREES + "SELECT CAST(sum(byte_size) + 28 * (SELECT count(*) FROM idx) AS BIGINT) AS resident_bytes, CAST(max(byte_size) + 28 * (SELECT count(*) FROM idx) AS BIGINT) AS streamed_bytes FROM z")
def plan_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, degrees = _degrees(spark, sf_dir)
    return planner.plan_bytes(graphs.block_descriptors(degrees), g.n)


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, CAST((l_partkey - 1000) * CAST(l_quantity AS BIGINT) AS BIGINT) AS v FROM lineitem), a AS (SELECT *, v - (v >> 2) AS y FROM v)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(y - (y >> 5) AS BIGINT) AS y FROM a""")
def lif_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    v = ((F.col("l_partkey") - 1000) * F.col("l_quantity").cast("bigint")).cast("int")
    return longs(with_leak(lines.select("l_orderkey", "l_linenumber", v.alias("y")), "y", (2, 5)), "l_orderkey", "l_linenumber", "y")


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS refr, CAST(l_partkey - 1000 AS BIGINT) AS v, 10 * CAST(l_quantity AS BIGINT) AS current FROM lineitem),
y AS (SELECT *, CASE WHEN refr = 0 THEN (v + current) - ((v + current) >> 2) END AS y FROM i)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CASE WHEN refr > 0 OR y >= 400 THEN 0 ELSE y END AS BIGINT) AS v,
       CAST(CASE WHEN refr > 0 THEN refr - 1 WHEN y >= 400 THEN 2 ELSE 0 END AS BIGINT) AS refr, coalesce(y >= 400, false) AS spike FROM y""")
def lif_single_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lines.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).cast("int").alias("refr"), (F.col("l_partkey") - 1000).cast("int").alias("v"), (10 * F.col("l_quantity").cast("long")).alias("current"))
    return simulate.advance(rows, fixture.CONFIG).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("v").cast("long").alias("v"), F.col("refr").cast("long").alias("refr"), "spike")


@query(graph_sql(True) + "SELECT target, CAST(1 + delay AS BIGINT) AS arrive_t, CAST(sum(weight) AS BIGINT) AS current FROM e JOIN idx ON e.source = idx.id WHERE body_id % 20 = 0 GROUP BY target, delay")
def scatter_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the spikes of one step send, by target and arrival."""
    g = fixture.graph(spark, sf_dir, delays=True)
    spiking = g.neurons.where("external_id % 20 = 0").select(F.col("id").alias("source"))
    sent = g.edges.join(spiking, "source").groupBy("target", (1 + F.col("delay")).alias("arrive_t")).agg(F.sum(F.col("weight").cast("long")).alias("current"))
    return longs(sent, "target", "arrive_t", "current")


def _run(spark: SparkSession, sf_dir: str, delays: bool, residency: str = "resident") -> simulate.SimulationResult:
    g = fixture.graph(spark, sf_dir, delays)
    return simulate.simulate(g, fixture.CONFIG, timesteps=STEPS, initial=fixture.start(g), residency=residency)


SUMMARY = "SELECT t, count(*) FILTER (WHERE spike) AS spikes, CAST(sum(v) AS BIGINT) AS sum_v, CAST(sum(refr) AS BIGINT) AS sum_refr FROM every GROUP BY t"


@query(unrolled(False, STEPS) + SUMMARY)
def simulate_spike_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, False).step_summary


@query(unrolled(False, STEPS) + "SELECT t, id FROM every WHERE spike")
def simulate_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_run(spark, sf_dir, False).spikes, "t", "id")


@query(unrolled(False, STEPS) + f"SELECT id, CAST(v AS BIGINT) AS v, CAST(refr AS BIGINT) AS refr FROM every WHERE t = {STEPS - 1}")
def simulate_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_run(spark, sf_dir, False).final_state, "id", "v", "refr")


@query(unrolled(True, STEPS) + SUMMARY)
def simulate_multi_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, True).step_summary


@query("SELECT CAST(0 AS BIGINT) AS differences")
def simulate_streamed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and steps in which a run over cached edges and one over scanned edges differ."""
    g = fixture.graph(spark, sf_dir, True)
    a, b = (simulate.simulate(g, fixture.CONFIG, timesteps=STEPS, initial=fixture.start(g), residency=r) for r in ("resident", "streamed"))
    tagged = lambda r: [s.select(F.lit(t).alias("t"), "id", F.struct("v", "refr", "spike").alias("s")) for t, s in enumerate(r.states)]
    out = None
    for x, y in zip(tagged(a), tagged(b), strict=True):
        d = x.join(y.withColumnRenamed("s", "o"), ["t", "id"], "full").where(~F.col("s").eqNullSafe(F.col("o"))).select("id")
        out = d if out is None else out.union(d)
    return out.agg(F.count(F.lit(1)).alias("differences"))


@query(unrolled(True, STEPS) + "SELECT sha256(unhex(string_agg(CASE WHEN spike THEN '01' ELSE '00' END, '' ORDER BY t, id))) AS digest, count(*) FILTER (WHERE spike) AS spikes FROM every")
def spike_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _run(spark, sf_dir, True)
    return spark.createDataFrame([(r.spike_digest, r.spike_count)], "digest string, spikes long")


@query(graph_sql(True) + """
, p AS (SELECT target, delay, sum(weight) OVER (PARTITION BY target, delay ORDER BY source, o) AS s FROM (SELECT *, row_number() OVER (ORDER BY source, target, raw_weight, delay) AS o FROM e))
SELECT target, CAST(delay AS BIGINT) AS arrive_t, CAST(min(s) AS BIGINT) AS low, CAST(max(s) AS BIGINT) AS high FROM p GROUP BY target, delay""")
def strict_overflow_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest partial sum of each bucket, if every node spiked at step 0, in source and edge order."""
    g = fixture.graph(spark, sf_dir, delays=True, ordered=True)
    w = Window.partitionBy("target", "delay").orderBy("source", "ord").rowsBetween(Window.unboundedPreceding, 0)
    sums = g.edges.select("target", F.col("delay").alias("arrive_t"), F.sum(F.col("weight").cast("long")).over(w).alias("s"))
    return longs(sums.groupBy("target", "arrive_t").agg(F.min("s").alias("low"), F.max("s").alias("high")), "target", "arrive_t", "low", "high")


@query(graph_sql(True) + """
, n AS (SELECT count(*) AS n FROM idx)
, q AS (SELECT unnest(['source_range', 'target_range', 'weight_range', 'delay_range', 'block_of_source', 'id_range', 'external_id_range', 'type_code_range', 'transmitter_code_range', 'side_code_range', 'ids_are_dense']) AS "check")
SELECT "check", CAST(CASE "check" WHEN 'target_range' THEN (SELECT count(*) FROM e WHERE target % 100 = 7) WHEN 'delay_range' THEN (SELECT count(*) FROM e WHERE delay = 7) ELSE 0 END AS BIGINT) AS violations FROM q""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a graph that is made wrong in some targets and delays."""
    g = fixture.graph(spark, sf_dir, delays=True)
    bad = g.edges.withColumn("target", F.when(F.col("target") % 100 == 7, -1).otherwise(F.col("target"))).withColumn("delay", F.when(F.col("delay") == 7, 0).otherwise(F.col("delay")))
    return graphs.validation_report(graphs.Graph(g.neurons, bad, g.n, g.block_size))
