"""A recurrent graph derived from the order tables: who buys, which part, how many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import SimulationConfig
from .functions.quantize import WeightQuantizer
from .operators import etl
from .operators.graph import Graph
from .sources.tables import Columns, one_each, scan_annotations, scan_edges, scan_labels
from .work import written

SIGNS = {"AUTOMOBILE": 1, "FURNITURE": 1, "MACHINERY": 1, "BUILDING": -1}
EXCLUDED = frozenset({"HOUSEHOLD"})
COLUMNS = Columns(annotation_id="p_partkey", annotation_type="p_type", annotation_side="p_brand", label_id="c_custkey", label_name="c_mktsegment", pre="o_custkey", post="l_partkey", weight="l_quantity")
CONVERSION = etl.Conversion(signs=SIGNS, excluded=EXCLUDED, quantizer=WeightQuantizer(10, 1), block_size=500)
CONFIG = SimulationConfig(threshold=400, reset=0, decay_shifts=(2,), refractory_steps=2)
START_V = 5000


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """weights, annotations, labels as a source would give them."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    weights = lines.join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return weights.select("o_custkey", "l_partkey", "l_quantity", "l_linenumber"), read("part").select("p_partkey", "p_type", "p_brand"), read("customer").select("c_custkey", "c_mktsegment")


def sources(spark: SparkSession, sf_dir: str, delays: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validated edges, annotations and labels, a row per id in the last two."""
    weights, annotations, labels = tables(spark, sf_dir)
    columns = Columns(**{**COLUMNS.__dict__, "delay": "l_linenumber"}) if delays else COLUMNS
    return scan_edges(weights, columns), one_each(scan_annotations(annotations, columns), ["type", "side"]), one_each(scan_labels(labels, columns), ["nt"])


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, notes, _ = sources(spark, sf_dir)
    return etl.dense_index(etl.node_universe(edges, edges, notes, CONVERSION))


def graph(spark: SparkSession, sf_dir: str, delays: bool = False, ordered: bool = False) -> Graph:
    """Only what a run needs is made: the place of each edge in its row is left out unless asked for."""
    edges, notes, labels = sources(spark, sf_dir, delays)
    ids = written(etl.dense_index(etl.node_universe(edges, edges, notes, CONVERSION)), "index")
    kept = etl.included(etl.label_edges(edges, labels), EXCLUDED)
    made = etl.indexed_edges(kept, ids, CONVERSION)
    made = etl.in_csr_order(made) if ordered else made.withColumn("ord", F.lit(0).cast("long"))
    made = written(made.select("block_id", "source", "ord", "target", "weight", "delay", "raw_weight", "saturated"), "edges")
    neurons = ids.select("id", F.col("body_id").alias("external_id"), F.lit(0).alias("type_code"), F.lit(0).cast("tinyint").alias("transmitter_code"), F.lit(0).cast("tinyint").alias("side_code"))
    return Graph(neurons, made, ids.count(), CONVERSION.block_size)


def start(g: Graph) -> DataFrame:
    """Every twentieth body starts high."""
    return g.neurons.select("id", F.when(F.col("external_id") % 20 == 0, START_V).otherwise(0).alias("v"))
