"""From source tables to a densely indexed, signed and quantised graph."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import UINT16_MAX, UINT32_MAX
from ..errors import ConfigurationError, DataSchemaError, GraphValidationError
from ..functions.quantize import WeightQuantizer
from ..sources.tables import UNKNOWN, Columns, one_each, scan_annotations, scan_edges, scan_labels
from ..work import failing, ranked, written

NODE_FILTERS = ("raw_endpoints", "annotations")
MOST_TYPES, MOST_SIDES = 1 << 16, 1 << 7


@dataclass(frozen=True)
class Conversion:
    """What a conversion does. signs: label to +1 or -1. Edges of excluded labels are left out and counted."""

    signs: Mapping[str, int]
    excluded: frozenset[str] = frozenset()
    quantizer: WeightQuantizer = field(default_factory=WeightQuantizer)
    node_filter: str = "raw_endpoints"
    scope: str = "full"
    delay: int = 1
    block_size: int = 100_000

    def __post_init__(self):
        object.__setattr__(self, "excluded", frozenset(self.excluded))
        if self.node_filter not in NODE_FILTERS:
            raise ConfigurationError(f"unknown node filter: {self.node_filter}")
        if self.scope not in ("full", "compact"):
            raise ConfigurationError(f"unknown scope: {self.scope}")
        if self.node_filter == "annotations" and self.scope != "full":
            raise ConfigurationError("the annotations node filter requires full scope")
        if not 1 <= self.delay <= UINT16_MAX:
            raise ConfigurationError("delay must be between 1 and 65535")
        if self.block_size < 1:
            raise ConfigurationError("block size must be positive")
        if not self.signs or any(s not in (-1, 1) or isinstance(s, bool) for s in self.signs.values()):
            raise ConfigurationError("the sign mapping needs labels with +1 or -1")
        if both := sorted(self.excluded & set(self.signs)):
            raise ConfigurationError(f"labels are both signed and excluded: {', '.join(both)}")


def sign_of(label: Column, signs: Mapping[str, int]) -> Column:
    """Null for a label without a sign."""
    pairs = [F.lit(x) for item in sorted(signs.items()) for x in item]
    return F.create_map(*pairs)[label]


def filter_edges(edges: DataFrame, annotations: DataFrame, node_filter: str) -> DataFrame:
    """Under the annotations filter, edges with both ends annotated. Two semi-joins; Spark broadcasts the ids only if they are small."""
    if node_filter == "raw_endpoints":
        return edges
    ids = annotations.select("body_id")
    return edges.join(ids, edges["pre"] == ids["body_id"], "left_semi").join(ids, edges["post"] == ids["body_id"], "left_semi")


def label_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with the label of their source, unknown where there is none."""
    of = labels.withColumnRenamed("body_id", "_of")
    return edges.join(of, edges["pre"] == of["_of"], "left").drop("_of").withColumn("nt", F.coalesce("nt", F.lit(UNKNOWN)))


def included(labelled: DataFrame, excluded: Iterable[str]) -> DataFrame:
    names = sorted(excluded)
    return labelled.where(~F.col("nt").isin(names)) if names else labelled


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("pre", "post")).alias("body_id")).distinct()


def unannotated_endpoints(edges: DataFrame, annotations: DataFrame) -> DataFrame:
    return endpoints(edges).join(annotations.select("body_id"), "body_id", "left_anti")


def node_universe(edges: DataFrame, kept: DataFrame, annotations: DataFrame, conversion: Conversion) -> DataFrame:
    """body_id of every node. edges: all of them; kept: without excluded labels."""
    if conversion.node_filter == "annotations":
        return annotations.select("body_id")
    if conversion.scope == "compact":
        return endpoints(kept)
    return annotations.select("body_id").union(edges.select("pre")).union(edges.select("post")).distinct()


def dense_index(nodes: DataFrame) -> DataFrame:
    """body_id and id, its rank from 0."""
    return ranked(nodes.select("body_id"), ["body_id"], "id")


def category_codes(annotations: DataFrame, column: str, most: int) -> DataFrame:
    """label and code: the rank of each label among all, unknown included. Few rows by the limit on codes, so one window is enough."""
    labels = annotations.select(F.col(column).alias("label")).union(annotations.sparkSession.createDataFrame([(UNKNOWN,)], "label string")).distinct().limit(most + 1)  # one too many is enough to know
    ordered = labels.agg(F.array_sort(F.collect_set("label")).alias("_all")).select(F.posexplode("_all").alias("code", "label"))
    return ordered.select("label", failing(F.col("code") >= most, GraphValidationError, f"more than {most} distinct values of {column}", F.col("code")).alias("code"))


def neuron_table(index: DataFrame, annotations: DataFrame, labels: DataFrame, signs: Mapping[str, int]) -> DataFrame:
    """id, external_id, type_code, transmitter_code (the label's sign, 0 without one), side_code. Codes come from all annotations."""
    types, sides = category_codes(annotations, "type", MOST_TYPES), category_codes(annotations, "side", MOST_SIDES)
    out = index.join(annotations, "body_id", "left").join(labels, "body_id", "left")
    out = out.withColumns({"type": F.coalesce("type", F.lit(UNKNOWN)), "side": F.coalesce("side", F.lit(UNKNOWN)), "nt": F.coalesce("nt", F.lit(UNKNOWN))})
    out = out.join(types.select(F.col("label").alias("type"), F.col("code").alias("type_code")), "type").join(sides.select(F.col("label").alias("side"), F.col("code").alias("side_code")), "side")
    sign = F.coalesce(sign_of(F.col("nt"), signs), F.lit(0))
    return out.select("id", F.col("body_id").alias("external_id"), F.col("type_code").cast("int").alias("type_code"), sign.cast("tinyint").alias("transmitter_code"), F.col("side_code").cast("tinyint").alias("side_code"))


def indexed_edges(kept: DataFrame, index: DataFrame, conversion: Conversion) -> DataFrame:
    """source, target, weight, delay, raw_weight, saturated, block_id. A missing sign is reported before a missing node."""
    sign = sign_of(F.col("nt"), conversion.signs)
    signed = failing(sign.isNull(), DataSchemaError, "a label has no entry in the sign mapping", sign)
    edges = kept.withColumn("_signed", F.col("raw_weight").cast("bigint") * signed)
    pre, post = index.select(F.col("body_id").alias("pre"), F.col("id").alias("source")), index.select(F.col("body_id").alias("post"), F.col("id").alias("target"))
    edges = edges.join(pre, "pre", "left").join(post, "post", "left")
    lost = F.col("source").isNull() | F.col("target").isNull()
    return edges.select(
        failing(lost, DataSchemaError, "an edge end is missing from the node index", F.col("source")).alias("source"), "target",
        conversion.quantizer.weight(F.col("_signed")).alias("weight"), "delay", "raw_weight", conversion.quantizer.saturated(F.col("_signed")).alias("saturated"),
    ).withColumn("block_id", F.call_function("div", F.col("source"), F.lit(conversion.block_size)).cast("int"))


def in_csr_order(edges: DataFrame) -> DataFrame:
    """ord: the place of each edge by source, target, raw weight and delay. The order is by the weight before its sign."""
    return ranked(edges, ["source", "target", "raw_weight", "delay"], "ord")


@dataclass
class Converted:
    neurons: DataFrame
    edges: DataFrame
    report: DataFrame
    type_codes: DataFrame
    side_codes: DataFrame


def convert(weights: DataFrame, annotations: DataFrame, labels: DataFrame, columns: Columns, conversion: Conversion) -> Converted:
    """Neurons and edges as written tables, and a one-row report of their counts."""
    raw = scan_edges(weights, columns, conversion.delay)
    notes = one_each(scan_annotations(annotations, columns), ["type", "side"])
    names = one_each(scan_labels(labels, columns), ["nt"])
    # Written once: the universe, the edges and the count of excluded ones are all made from it.
    labelled = written(label_edges(filter_edges(raw, notes, conversion.node_filter), names), "labelled")
    kept = included(labelled, conversion.excluded)
    index = written(dense_index(node_universe(labelled, kept, notes, conversion)), "index")
    neurons = written(neuron_table(index, notes, names, conversion.signs), "neurons")
    edges = written(in_csr_order(indexed_edges(kept, index, conversion)), "edges")
    left_out = labelled.where(F.col("nt").isin(sorted(conversion.excluded))) if conversion.excluded else labelled.limit(0)
    report = conversion_report(neurons, edges, left_out)
    if neurons.count() > UINT32_MAX:
        raise GraphValidationError("too many nodes for 32-bit indices")
    return Converted(neurons, edges, report, category_codes(notes, "type", MOST_TYPES), category_codes(notes, "side", MOST_SIDES))


def conversion_report(neurons: DataFrame, edges: DataFrame, left_out: DataFrame) -> DataFrame:
    """One row of counts, each from its own aggregate; combined by union so that nothing is joined."""
    parts = [
        neurons.agg(F.count(F.lit(1)).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d")),
        edges.agg(F.lit(0).alias("a"), F.count(F.lit(1)).alias("b"), F.lit(0).alias("c"), F.count_if("saturated").alias("d")),
        left_out.agg(F.lit(0).alias("a"), F.lit(0).alias("b"), F.count(F.lit(1)).alias("c"), F.lit(0).alias("d")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.sum("a").alias("n_neurons"), F.sum("b").alias("n_edges"), F.sum("c").alias("excluded_edges"), F.sum("d").alias("saturated_weights"))
