import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.feather as feather
import pytest

from voltweave import cli
from voltweave.config import RuntimeAxes
from voltweave.errors import ArtifactExistsError, ChecksumMismatchError, DataSchemaError, GraphFormatError, GraphValidationError, PathContainmentError
from voltweave.operators.graph import adjacency, block_descriptors, contiguity_violations, csr_offsets, delay_bounds, example, from_rows, offset_violations, source_degrees, validate
from voltweave.plans.planner import plan
from voltweave.sources import artifact, blocks
from voltweave.sources.feather import columns, read_feather

ROWS = [(0, 1, 7, 1), (2, 0, -2, 2)]


def test_offsets_descriptors_and_plan(spark):
    g = from_rows(spark, 3, ROWS, 2)
    d = source_degrees(g.edges, g.neurons, 2)
    assert [tuple(r) for r in csr_offsets(d).orderBy("source").collect()] == [(0, 0, 0, 1), (0, 1, 1, 1), (1, 2, 0, 1)]
    assert offset_violations(csr_offsets(d)).count() == 0
    assert [tuple(r) for r in block_descriptors(d).orderBy("block_id").collect()] == [(0, 0, 2, 1, 20 + 12 + 8), (1, 2, 1, 1, 20 + 8 + 8)]
    assert contiguity_violations(block_descriptors(d).where("block_id = 1")).count() == 1
    assert tuple(delay_bounds(g.edges).first()) == (1, 2) and (g.min_delay, g.max_delay, g.edge_count) == (1, 2, 2)
    assert tuple(delay_bounds(g.edges.limit(0)).first()) == (0, 0)
    assert [len(r["edges"]) for r in adjacency(g).orderBy("source").collect()] == [1, 0, 1]
    p = plan(g, RuntimeAxes())
    assert (p.capacity_status, p.required_bytes) == ("not tested", 28 * 3 + 40 + 36)
    assert plan(g, RuntimeAxes(residency="streamed"), capacity_bytes=1).capacity_status == "insufficient"
    assert plan(g, RuntimeAxes(), capacity_bytes=10**6).capacity_status == "feasible"


@pytest.mark.parametrize("row", [(0, 3, 1, 1), (0, 1, 40000, 1), (0, 1, 1, 0), (0, 1, 1, 70000), (5, 0, 1, 1)])
def test_bad_edges_are_refused(spark, row):
    with pytest.raises(GraphValidationError):
        from_rows(spark, 3, [row], 2)


def test_unsorted_rows_are_refused(spark):
    with pytest.raises(GraphValidationError):
        from_rows(spark, 3, ROWS[::-1], 2)


def test_parquet_round_trip(spark, tmp_path):
    g, path = example(spark), str(tmp_path / "g")
    artifact.write_artifact(g, path, dataset_id="example", conversion={"note": 1})
    a = artifact.load_artifact(spark, path)
    assert a.manifest["n_edges"] == 3 and a.manifest["conversion"] == {"note": 1} and len(a.manifest["blocks"]) == 2
    assert sorted(map(tuple, a.graph.edges.select(*g.edges.columns).collect())) == sorted(map(tuple, g.edges.collect()))
    with pytest.raises(ArtifactExistsError):
        artifact.write_artifact(g, path, dataset_id="example")
    assert not [p for p in os.listdir(tmp_path) if "staging" in p]


def test_changed_artifacts_are_noticed(spark, tmp_path):
    path = str(tmp_path / "g")
    artifact.write_artifact(example(spark), path, dataset_id="example")
    manifest = json.load(open(f"{path}/manifest.json"))
    for change, kind in (({"format_version": 2}, GraphFormatError), ({"blocks": [b | {"sha256": "0" * 64} for b in manifest["blocks"]]}, ChecksumMismatchError)):
        json.dump(manifest | change, open(f"{path}/manifest.json", "w"))
        if os.path.exists(f"{path}/.manifest.json.crc"):
            os.remove(f"{path}/.manifest.json.crc")
        with pytest.raises(kind):
            artifact.open_artifact(spark, path)
    with pytest.raises(GraphFormatError):
        artifact.open_artifact(spark, str(tmp_path / "none"))


def test_invalid_graph_is_not_published(spark, tmp_path):
    g = example(spark)
    g.edges = g.edges.withColumn("target", g.edges["target"] + 10)
    with pytest.raises(GraphValidationError):
        artifact.write_artifact(g, str(tmp_path / "g"), dataset_id="x")
    assert os.listdir(tmp_path) == []


def test_binary_round_trip(spark, tmp_path):
    g, path = from_rows(spark, 3, ROWS, 2), str(tmp_path / "g.scx")
    artifact.export_binary(g, path, dataset_id="rows")
    a = artifact.open_binary(spark, path)
    validate(a.graph)
    assert sorted(map(tuple, a.graph.edges.select("source", "target", "weight", "delay").collect())) == ROWS
    assert [b["source_count"] for b in a.manifest["blocks"]] == [2, 1]
    name = f"{path}/blocks/block_00000.scb"
    data = bytearray(open(name, "rb").read())
    data[-1] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="differs from the manifest"):
        artifact.open_binary(spark, path).graph.edges.collect()
    manifest = json.load(open(f"{path}/manifest.json"))
    manifest["blocks"][0]["filename"] = "../../etc/passwd"
    json.dump(manifest, open(f"{path}/manifest.json", "w"))
    with pytest.raises(PathContainmentError):
        artifact.open_binary(spark, path)


def test_binary_layout_is_read_through_spark(spark, tmp_path):
    g, path = from_rows(spark, 3, ROWS, 2), str(tmp_path / "g.scx")
    artifact.export_binary(g, path, dataset_id="rows")
    a = artifact.open_binary(spark, f"file://{path}")
    assert sorted(map(tuple, a.graph.edges.select("source", "target", "weight", "delay").collect())) == ROWS
    assert [(r["id"], int(r["external_id"])) for r in a.graph.neurons.orderBy("id").collect()] == [(0, 0), (1, 1), (2, 2)]
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(PathContainmentError):
            artifact.contained("store://host/g", bad)
    assert artifact.contained("store://host/g", "blocks/x.scb") == "store://host/g/blocks/x.scb"
    data = bytearray(open(f"{path}/neurons.bin", "rb").read())
    data[5] ^= 1
    open(f"{path}/neurons.bin", "wb").write(data)
    with pytest.raises(ChecksumMismatchError):
        artifact.open_binary(spark, path)
    with pytest.raises(GraphFormatError):
        artifact.open_binary(spark, str(tmp_path / "none"))


def test_block_codec():
    data = blocks.encode_block(4, np.array([1, 1]), np.array([7, 6]), np.array([1, -2]), np.array([1, 2]))
    start, offsets, targets, weights, delays = blocks.decode_block(data)
    assert (start, offsets.tolist(), targets.tolist(), weights.tolist(), delays.tolist()) == (4, [0, 1, 2], [7, 6], [1, -2], [1, 2])
    assert blocks.check_block(data, 8) == 2
    for bad in (b"XXXX" + data[4:], data[:-1], data[:10], data[:4] + b"\x02\0\0\0" + data[8:], data[:24] + b"\x09\0\0\0" + data[28:]):
        with pytest.raises(GraphFormatError):
            blocks.decode_block(bad)
    with pytest.raises(GraphValidationError):
        blocks.check_block(data, 7)
    with pytest.raises(GraphValidationError):
        blocks.encode_block(0, np.array([1]), np.array([0]), np.array([1]), np.array([0]))
    with pytest.raises(GraphFormatError):
        blocks.decode_neurons(b"123", 1)


def write_sources(folder):
    feather.write_feather(pa.table({"body_pre": pa.array([200, 100, 100], pa.uint64()), "body_post": pa.array([300, 300, 200], pa.uint64()), "weight": pa.array([4, 2, 3], pa.int32())}), f"{folder}/w.feather", compression="uncompressed", chunksize=1)
    feather.write_feather(pa.table({"bodyId": pa.array([300, 100, 200], pa.uint64()), "type": pa.array(["output", "input", None]).dictionary_encode()}), f"{folder}/a.feather")
    feather.write_feather(pa.table({"body": pa.array([100, 200, 300], pa.uint64()), "consensus_nt": ["acetylcholine", "gaba", "glutamate"]}), f"{folder}/n.feather")


def test_feather_source(spark, tmp_path):
    write_sources(tmp_path)
    path = str(tmp_path / "w.feather")
    assert columns(path) == ("body_pre", "body_post", "weight")
    df = read_feather(spark, path, ["weight", "body_pre"], batch_rows=2)
    assert df.columns == ["weight", "body_pre"] and sorted((r[0], int(r[1])) for r in df.collect()) == [(2, 100), (3, 100), (4, 200)]
    with pytest.raises(DataSchemaError):
        read_feather(spark, path, ["nope"])
    with pytest.raises(ValueError):
        read_feather(spark, path, batch_rows=0)
    with pytest.raises(DataSchemaError):
        columns(str(tmp_path / "none"))
    (tmp_path / "bad").write_bytes(b"not arrow")
    with pytest.raises(DataSchemaError):
        columns(str(tmp_path / "bad"))


def test_command_line(spark, tmp_path, capsys):
    write_sources(tmp_path)
    out = str(tmp_path / "g")
    args = ["convert", "--weights", f"{tmp_path}/w.feather", "--annotations", f"{tmp_path}/a.feather", "--labels", f"{tmp_path}/n.feather", "--output", out, "--annotation-id", "bodyId", "--annotation-type", "type", "--label-id", "body", "--label-name", "consensus_nt", "--sign-mapping", '{"acetylcholine": 1, "gaba": -1, "glutamate": 1}', "--block-size", "2"]
    assert cli.main(args) == 0 and "neurons=3 edges=3 excluded_edges=0" in capsys.readouterr().out
    assert cli.main(args) == 1 and "error" in capsys.readouterr().out
    assert cli.main(["inspect", "--file", f"{tmp_path}/w.feather"]) == 0 and "- body_pre" in capsys.readouterr().out
    assert cli.main(["run"]) == 0 and "spikes=3 digest=475b670d" in capsys.readouterr().out
    assert cli.main(["run", "--dataset", out, "--residency", "streamed", "--timesteps", "2", "--seed-node", "0", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["spikes"] == [1, 0]
    assert cli.main(["plan", "--dataset", out]) == 0 and "capacity=not tested" in capsys.readouterr().out
    assert cli.main(["benchmark", "--timesteps", "1"]) == 0 and "wall_seconds=" in capsys.readouterr().out
    assert cli.main(["run", "--device", "cuda"]) == 1 and "error" in capsys.readouterr().out
    assert cli.main(["run", "--preset", "full", "--scope", "compact"]) == 1
    assert cli.main(["run", "--dataset", str(tmp_path / "none")]) == 1
