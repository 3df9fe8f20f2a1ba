import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voltweave.errors import ConfigurationError, DataSchemaError, translated
from voltweave.functions.quantize import WeightQuantizer
from voltweave.operators import etl
from voltweave.sources.tables import Columns, one_each, scan_annotations, scan_edges

COLUMNS = Columns("body", "body", "nt", "kind", "side_name", "pre_id", "post_id", "strength")
SIGNS = {"acetylcholine": 1, "gaba": -1, "glutamate": 1}


def tables(spark, extra=(), label="acetylcholine"):
    weights = spark.createDataFrame([(200, 300, 4), (100, 300, 2), (100, 200, 3), *extra], "pre_id long, post_id long, strength long")
    notes = spark.createDataFrame([(300, "output", "right"), (100, "input", "left"), (200, "interneuron", "left")], "body long, kind string, side_name string")
    return weights, notes, spark.createDataFrame([(100, label), (200, "gaba"), (300, "glutamate")], "body long, nt string")


def converted(spark, extra=(), label="acetylcholine", **changes):
    return etl.convert(*tables(spark, extra, label), COLUMNS, etl.Conversion(**{"signs": SIGNS, "block_size": 2} | changes))


def raises(kind, fn):
    with pytest.raises(Exception) as e:
        fn()
    assert isinstance(translated(e.value) if isinstance(e.value, PySparkException) else e.value, kind)


def test_order_signs_and_index(spark):
    c = converted(spark)
    assert [(r["id"], int(r["external_id"])) for r in c.neurons.orderBy("id").collect()] == [(0, 100), (1, 200), (2, 300)]
    assert [(r["source"], r["target"], r["weight"], r["block_id"]) for r in c.edges.orderBy("ord").collect()] == [(0, 1, 3, 0), (0, 2, 2, 0), (1, 2, -4, 0)]
    assert c.report.first().asDict() == {"n_neurons": 3, "n_edges": 3, "excluded_edges": 0, "saturated_weights": 0}
    assert [(r["type_code"], r["transmitter_code"], r["side_code"]) for r in c.neurons.orderBy("id").collect()] == [(0, 1, 0), (1, -1, 0), (2, 1, 1)]


def test_parallel_edges_of_an_inhibitory_source_keep_their_raw_order(spark):
    c = converted(spark, [(200, 300, 9), (200, 300, 1)])
    assert [r["weight"] for r in c.edges.where("source = 1").orderBy("ord").collect()] == [-1, -4, -9]


def test_missing_sign_is_an_error(spark):
    raises(DataSchemaError, lambda: converted(spark, signs={"acetylcholine": 1}))


def test_excluded_labels_are_left_out_and_counted(spark):
    row = converted(spark, label="unclear", excluded={"unclear"}).report.first()
    assert (row["n_edges"], row["excluded_edges"], row["n_neurons"]) == (1, 2, 3)


def test_scopes_and_node_filter(spark):
    extra, signs = [(400, 300, 1)], SIGNS | {"unknown": 1}
    count = lambda **c: tuple(converted(spark, extra, signs=signs, **c).report.first())[:2]
    assert count() == (4, 4)
    assert count(node_filter="annotations") == (3, 3)
    row = converted(spark, extra, label="unclear", signs=signs, excluded={"unclear"}, scope="compact").report.first()
    assert (row["n_neurons"], row["n_edges"]) == (3, 2)


def test_edges_dropped_by_the_filter_need_no_sign(spark):
    assert converted(spark, [(400, 300, 1)], node_filter="annotations").report.first()["n_edges"] == 3


@pytest.mark.parametrize("changes", [{"signs": {}}, {"signs": {"a": 2}}, {"delay": 0}, {"delay": 65536}, {"excluded": {"gaba"}}, {"node_filter": "some"}, {"node_filter": "annotations", "scope": "compact"}, {"block_size": 0}])
def test_contradictory_settings(changes):
    with pytest.raises(ConfigurationError):
        etl.Conversion(**{"signs": SIGNS} | changes)


def test_saturation_is_counted(spark):
    assert converted(spark, quantizer=WeightQuantizer(40000, 1, "saturate")).report.first()["saturated_weights"] == 3


def test_duplicate_records_collapse_or_conflict(spark):
    _, notes, _ = tables(spark)
    twice = scan_annotations(notes.union(notes), COLUMNS)
    assert one_each(twice, ["type", "side"]).count() == 3
    bad = scan_annotations(notes.union(notes.withColumn("kind", F.lit("x"))), COLUMNS)
    raises(DataSchemaError, lambda: one_each(bad, ["type", "side"]).collect())


@pytest.mark.parametrize("rows, kinds", [([(None, 2, 3)], "pre_id long, post_id long, strength long"), ([(-1, 2, 3)], "pre_id long, post_id long, strength long"), ([(1, 2, 2**31)], "pre_id long, post_id long, strength long"), ([(1.5, 2, 3)], "pre_id double, post_id long, strength long")])
def test_bad_edge_values(spark, rows, kinds):
    raises(DataSchemaError, lambda: scan_edges(spark.createDataFrame(rows, kinds), COLUMNS).collect())


def test_bad_edge_columns(spark):
    with pytest.raises(DataSchemaError, match="missing"):
        scan_edges(spark.range(1), COLUMNS)
    with pytest.raises(DataSchemaError, match="numeric"):
        scan_edges(spark.createDataFrame([("1", 2, 3)], "pre_id string, post_id long, strength long"), COLUMNS)


def test_ids_of_64_bits_keep_their_order(spark):
    from decimal import Decimal

    ids = [0, 2**32, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(Decimal(i),) for i in reversed(ids)], "body_id decimal(20,0)")
    assert [int(r["body_id"]) for r in etl.dense_index(df).orderBy("id").collect()] == ids


def test_null_category_is_unknown_and_has_its_rank(spark):
    notes = spark.createDataFrame([(1, None, "z"), (2, "alpha", None)], "body long, kind string, side_name string")
    codes = etl.category_codes(one_each(scan_annotations(notes, COLUMNS), ["type", "side"]), "type", 10)
    assert {r["label"]: r["code"] for r in codes.collect()} == {"alpha": 0, "unknown": 1}
    sides = etl.category_codes(one_each(scan_annotations(notes, COLUMNS), ["type", "side"]), "side", 1)
    with pytest.raises(PySparkException):
        sides.collect()
