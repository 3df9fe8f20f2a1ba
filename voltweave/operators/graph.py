"""A graph as two DataFrames, its views and its validation."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import INT16, UINT16_MAX, UINT64_MAX
from ..errors import GraphValidationError
from ..work import ranked

# Bytes of a stored block's header, of an offset and of an edge, of a stored neuron and of a neuron's state.
HEADER_BYTES, OFFSET_BYTES, EDGE_BYTES, NEURON_BYTES, STATE_BYTES = 20, 4, 8, 16, 12


@dataclass
class Graph:
    """neurons(id, external_id, type_code, transmitter_code, side_code), edges(block_id, source, ord, target, weight, delay), and the node count."""

    neurons: DataFrame
    edges: DataFrame
    n: int
    block_size: int

    @property
    def spark(self) -> SparkSession:
        return self.neurons.sparkSession

    def resident(self) -> Graph:
        """Edges kept in executors' memory, spilling to their disks."""
        return Graph(self.neurons, self.edges.persist(StorageLevel.MEMORY_AND_DISK), self.n, self.block_size)

    @property
    def edge_count(self) -> int:
        return self.edges.count()

    @property
    def min_delay(self) -> int:
        return delay_bounds(self.edges).first()["min_delay"]

    @property
    def max_delay(self) -> int:
        return delay_bounds(self.edges).first()["max_delay"]


def from_rows(spark: SparkSession, n: int, rows: list[tuple[int, int, int, int]], block_size: int, neurons: DataFrame | None = None) -> Graph:
    """rows: source, target, weight, delay in source order."""
    if any(a[0] > b[0] for a, b in zip(rows, rows[1:], strict=False)):
        raise GraphValidationError("rows are not in source order")
    if any(not 0 <= r[0] < n for r in rows):
        raise GraphValidationError("a source is out of range")
    edges = spark.createDataFrame([(r[0] // block_size, r[0], k, *r[1:]) for k, r in enumerate(rows)], "block_id int, source long, ord long, target long, weight int, delay int")
    default = spark.range(n).select("id", F.col("id").cast("decimal(20,0)").alias("external_id"), F.lit(0).alias("type_code"), F.lit(0).cast("tinyint").alias("transmitter_code"), F.lit(0).cast("tinyint").alias("side_code"))
    graph = Graph(neurons or default, edges, n, block_size)
    validate(graph)
    return graph


def from_frame(edges: DataFrame, n: int, block_size: int, neurons: DataFrame | None = None) -> Graph:
    """A graph from a table of source, target, weight and delay in any order, of any size: edges are ranked by source, target, weight and delay. Rows out of range are an error."""
    if block_size < 1:
        raise GraphValidationError("block size must be positive")
    spark = edges.sparkSession
    placed = ranked(edges.select(*(F.col(c).cast("long").alias(c) for c in ("source", "target", "weight", "delay"))), ["source", "target", "weight", "delay"], "ord")
    block = F.call_function("div", F.col("source"), F.lit(block_size)).cast("int")
    default = spark.range(n).select("id", F.col("id").cast("decimal(20,0)").alias("external_id"), F.lit(0).alias("type_code"), F.lit(0).cast("tinyint").alias("transmitter_code"), F.lit(0).cast("tinyint").alias("side_code"))
    graph = Graph(neurons or default, placed.select(block.alias("block_id"), "source", "ord", "target", "weight", "delay"), n, block_size)
    validate(graph)
    return Graph(graph.neurons, graph.edges.withColumns({"weight": F.col("weight").cast("int"), "delay": F.col("delay").cast("int")}), n, block_size)


def example(spark: SparkSession) -> Graph:
    """Four nodes, three edges, two blocks."""
    return from_rows(spark, 4, [(0, 1, 32767, 1), (0, 2, -12000, 1), (1, 3, 32767, 1)], 2)


def delay_bounds(edges: DataFrame) -> DataFrame:
    """0 where there are no edges."""
    return edges.agg(F.coalesce(F.min("delay"), F.lit(0)).cast("long").alias("min_delay"), F.coalesce(F.max("delay"), F.lit(0)).cast("long").alias("max_delay"))


def source_degrees(edges: DataFrame, neurons: DataFrame, block_size: int) -> DataFrame:
    """block_id, source and deg of every node, without edges included."""
    out = edges.groupBy("source").agg(F.count(F.lit(1)).alias("deg"))
    all_ = neurons.select(F.col("id").alias("source")).join(out, "source", "left")
    return all_.select(F.call_function("div", F.col("source"), F.lit(block_size)).cast("int").alias("block_id"), "source", F.coalesce("deg", F.lit(0)).alias("deg"))


def csr_offsets(degrees: DataFrame) -> DataFrame:
    """Of every row of a block, where it starts and ends among the block's edges."""
    w = Window.partitionBy("block_id").orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("deg").over(w)
    return degrees.select("block_id", "source", (end - F.col("deg")).alias("row_start"), end.alias("row_end"))


def offset_violations(offsets: DataFrame) -> DataFrame:
    """Rows that do not start where the row before ends, or that end before they start."""
    w = Window.partitionBy("block_id").orderBy("source")
    before = F.coalesce(F.lag("row_end").over(w), F.lit(0))
    return offsets.withColumn("_before", before).where("row_start <> _before OR row_end < row_start").select("block_id", "source", "row_start", "row_end")


def block_descriptors(degrees: DataFrame) -> DataFrame:
    """block_id, source_start, source_count, edge_count and byte_size of each block of sources."""
    d = degrees.groupBy("block_id").agg(F.min("source").alias("source_start"), F.count(F.lit(1)).alias("source_count"), F.sum("deg").alias("edge_count"))
    size = HEADER_BYTES + OFFSET_BYTES * (F.col("source_count") + 1) + EDGE_BYTES * F.col("edge_count")
    return d.withColumn("byte_size", size.cast("long"))


def contiguity_violations(descriptors: DataFrame) -> DataFrame:
    """Blocks that do not start where those before them end. A row per block, so one window is enough."""
    w = Window.orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    expected = F.coalesce(F.sum("source_count").over(w), F.lit(0))
    return descriptors.withColumn("expected_start", expected).where("source_start <> expected_start").select("block_id", "source_start", "expected_start")


def validation_report(graph: Graph) -> DataFrame:
    """check and violations for each rule, one scan of the neurons and one of the edges."""
    e, n = graph.edges, graph.neurons
    edge_rules = {
        "source_range": ~F.col("source").between(0, graph.n - 1), "target_range": ~F.col("target").between(0, graph.n - 1), "weight_range": ~F.col("weight").between(*INT16),
        "delay_range": ~F.col("delay").between(1, UINT16_MAX), "block_of_source": F.col("block_id") != F.call_function("div", F.col("source"), F.lit(graph.block_size)),
    }
    node_rules = {
        "id_range": ~F.col("id").between(0, graph.n - 1), "external_id_range": ~F.col("external_id").between(0, F.lit(Decimal(UINT64_MAX))), "type_code_range": ~F.col("type_code").between(0, UINT16_MAX),
        "transmitter_code_range": ~F.col("transmitter_code").between(-1, 1), "side_code_range": ~F.col("side_code").between(-128, 127),
    }
    def counts(df, rules, more=()):
        row = df.agg(*(F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()), *more)
        names = row.columns
        return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("violations")) for c in names))).alias("x")).select("x.check", "x.violations")

    ids = (F.abs(F.count(F.lit(1)) - graph.n) + F.abs(F.count(F.lit(1)) - F.count_distinct("id"))).alias("ids_are_dense")
    return counts(e, edge_rules).union(counts(n, node_rules, (ids,)))


def validate(graph: Graph) -> None:
    bad = validation_report(graph).where("violations > 0").collect()
    if bad:
        raise GraphValidationError("; ".join(f"{r['check']}: {r['violations']}" for r in sorted(bad)))


def adjacency(graph: Graph) -> DataFrame:
    """source and its edges as an array in stored order, every node included."""
    rows = graph.edges.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ord", "target", "weight", "delay"))).alias("edges"))
    return graph.neurons.select(F.col("id").alias("source")).join(rows, "source", "left").select("source", F.coalesce("edges", F.array().cast("array<struct<ord:bigint,target:bigint,weight:int,delay:int>>")).alias("edges"))


def edge_order(edges: DataFrame) -> DataFrame:
    return ranked(edges, ["source", "target", "raw_weight", "delay"], "ord")
