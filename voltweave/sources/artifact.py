"""Graphs on disk: partitioned Parquet with a manifest, published by a rename, and the binary exchange layout.

The Parquet layout is the engine's own: neurons/, edges/ by block_id, and manifest.json, which carries the
digest of each block's rows. The binary layout (export_binary, open_binary) has neurons.bin, a file for
each block, and a manifest of their digests.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactExistsError, ChecksumMismatchError, GraphFormatError, GraphValidationError, PathContainmentError, translated
from ..operators.graph import Graph, block_descriptors, contiguity_violations, source_degrees, validate
from . import blocks as codec

FORMAT_ID, FORMAT_VERSION = "voltweave-graph", 1
# Fixed value: the binary layout's name of itself.
BINARY_ID = "scx"
SHA = re.compile(r"[0-9a-f]{64}")
#: Nodes that a task returns at a time.
NODES_A_BATCH = 1 << 16
DESCRIPTOR = ("filename", "source_start", "source_count", "edge_count", "byte_size", "sha256")


def safe_join(root: str, relative: str) -> str:
    """A path that stays in root once links are followed."""
    base = os.path.realpath(root)
    path = os.path.realpath(os.path.join(base, relative))
    if os.path.commonpath([base, path]) != base:
        raise PathContainmentError(f"{relative} lies outside the artifact")
    return path


def contained(root: str, relative: str) -> str:
    """A path in a folder of any store; in a local one links are followed as well."""
    if "://" not in root:
        return safe_join(root, relative)
    path = posixpath.normpath(relative)
    if path.startswith(("/", "..")):
        raise PathContainmentError(f"{relative} lies outside the artifact")
    return f"{root.rstrip('/')}/{path}"


class Files:
    """A folder through Hadoop's file systems, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._jpath(f"{self.path}/{name}" if name else self.path))

    def write_text(self, name: str, text: str) -> None:
        out = self.fs.create(self._jpath(f"{self.path}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read_text(self, name: str) -> str:
        rows = self.spark.read.format("binaryFile").load(f"{self.path}/{name}").select("content").collect()
        return bytes(rows[0]["content"]).decode() if rows else ""

    def rename_to(self, other: str) -> bool:
        return self.fs.rename(self._jpath(self.path), self._jpath(other))


def block_digests(edges: DataFrame) -> DataFrame:
    """block_id, n and an order-free digest of each block's rows: sums of row hashes, so partial aggregates do the work."""
    row = F.struct("source", "ord", "target", "weight", "delay")
    return edges.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), row)).alias("x")).select("block_id", "n", F.sha2(F.concat_ws(":", "n", "h", "x").cast("binary"), 256).alias("sha256"))


def write_artifact(graph: Graph, path: str, *, dataset_id: str, source_url: str | None = None, license: str | None = None, scope: str = "full", conversion: dict[str, Any] | None = None) -> dict[str, Any]:
    """The manifest of what was written. The graph is validated first; nothing is at path until all is complete."""
    final = Files(graph.spark, path)
    if final.exists():
        raise ArtifactExistsError(f"artifact already exists: {path}")
    validate(graph)
    degrees = source_degrees(graph.edges, graph.neurons, graph.block_size)
    if not contiguity_violations(block_descriptors(degrees)).isEmpty():
        raise GraphValidationError("a block does not start where the one before ends")
    staging = Files(graph.spark, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}")
    graph.neurons.write.parquet(f"{staging.path}/neurons")
    edges = graph.edges.select("block_id", "source", "ord", "target", "weight", "delay")
    edges.repartition("block_id").sortWithinPartitions("block_id", "source", "ord").write.partitionBy("block_id").parquet(f"{staging.path}/edges")
    digests = {r["block_id"]: r["sha256"] for r in block_digests(edges).collect()}  # a row per block
    rows = block_descriptors(degrees).orderBy("block_id").collect()
    manifest = {
        "format_id": FORMAT_ID, "format_version": FORMAT_VERSION, "dataset_id": dataset_id, "source_url": source_url, "license": license, "scope": scope, "n_neurons": graph.n,
        "n_edges": sum(r["edge_count"] for r in rows), "block_size": graph.block_size, "conversion": conversion or {},
        "blocks": [{"block_id": r["block_id"], "source_start": r["source_start"], "source_count": r["source_count"], "edge_count": r["edge_count"], "byte_size": r["byte_size"], "sha256": digests.get(r["block_id"])} for r in rows],
    }
    staging.write_text("manifest.json", json.dumps(manifest, indent=2, sort_keys=True) + "\n")
    if final.exists() or not staging.rename_to(path):
        raise ArtifactExistsError(f"artifact already exists: {path}")
    return manifest


@dataclass
class Artifact:
    path: str
    manifest: dict[str, Any]
    graph: Graph


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    files = Files(spark, path)
    if not files.exists("manifest.json"):
        raise GraphFormatError(f"no manifest: {path}")
    try:
        manifest = json.loads(files.read_text("manifest.json"))
    except ValueError as error:
        raise GraphFormatError(f"cannot parse manifest: {path}") from error
    if manifest.get("format_id") != FORMAT_ID or manifest.get("format_version") != FORMAT_VERSION:
        raise GraphFormatError("unsupported artifact format")
    return manifest


EDGES = "source long, ord long, target long, weight int, delay int, block_id int"


def open_artifact(spark: SparkSession, path: str, *, verify_checksums: bool = True) -> Artifact:
    """A graph that is scanned where it is used. Verification is one aggregate over the edges."""
    manifest = read_manifest(spark, path)
    neurons = spark.read.parquet(f"{path}/neurons")
    edges = spark.read.schema(EDGES).parquet(f"{path}/edges")
    graph = Graph(neurons, edges, manifest["n_neurons"], manifest["block_size"])
    if verify_checksums:
        found = {r["block_id"]: (r["n"], r["sha256"]) for r in block_digests(edges).collect()}
        for b in manifest["blocks"]:
            n, sha = found.pop(b["block_id"], (0, None))
            if sha != b["sha256"] or n != b["edge_count"]:
                raise ChecksumMismatchError(f"block {b['block_id']} differs from the manifest")
        if found:
            raise ChecksumMismatchError(f"blocks without a manifest entry: {sorted(found)}")
    return Artifact(path, manifest, graph)


def load_artifact(spark: SparkSession, path: str) -> Artifact:
    """A verified, validated graph kept in memory."""
    artifact = open_artifact(spark, path)
    artifact.graph = artifact.graph.resident()
    validate(artifact.graph)
    if artifact.graph.edge_count != artifact.manifest["n_edges"]:
        raise GraphValidationError("the manifest's edge count does not match its blocks")
    return artifact


def encode_blocks(graph: Graph) -> DataFrame:
    """block_id and the block's bytes. A block is one group; its size is the caller's block size."""
    degrees = source_degrees(graph.edges, graph.neurons, graph.block_size)
    rows = degrees.select("block_id", "source", "deg", F.lit(0).alias("target"), F.lit(0).alias("weight"), F.lit(0).alias("delay"), F.lit(-1).cast("long").alias("ord"))
    rows = rows.unionByName(graph.edges.select("block_id", "source", F.lit(0).cast("long").alias("deg"), F.col("target"), F.col("weight").cast("int").alias("weight"), "delay", "ord"))

    def encode(table: pa.Table) -> pa.Table:
        head = table.filter(pa.compute.equal(table["ord"], -1)).sort_by("source")
        body = table.filter(pa.compute.greater_equal(table["ord"], 0)).sort_by([("source", "ascending"), ("ord", "ascending")])
        data = codec.encode_block(head["source"][0].as_py(), head["deg"].to_numpy(), *(body[c].to_numpy() for c in ("target", "weight", "delay")))
        return pa.table({"block_id": table["block_id"].slice(0, 1), "data": pa.array([data], pa.binary())})

    import pyarrow.compute  # noqa: F401  encode() refers to pa.compute on the workers

    return rows.groupBy("block_id").applyInArrow(encode, "block_id int, data binary")


def export_binary(graph: Graph, path: str, *, dataset_id: str, source_url: str | None = None, license: str | None = None, scope: str = "full", conversion: dict[str, Any] | None = None) -> None:
    """The binary layout in a local folder; blocks come to the driver one at a time."""
    if os.path.exists(path):
        raise ArtifactExistsError(f"artifact already exists: {path}")
    validate(graph)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    os.makedirs(f"{staging}/blocks")
    digest, size = hashlib.sha256(), 0
    with open(f"{staging}/neurons.bin", "wb") as out:
        for r in graph.neurons.orderBy("id").toLocalIterator():
            row = np.array([(r["id"], int(r["external_id"]), r["type_code"], r["transmitter_code"], r["side_code"])], codec.NEURON).tobytes()
            out.write(row)
            digest.update(row)
            size += len(row)
    found = []
    for r in encode_blocks(graph).orderBy("block_id").toLocalIterator():
        data = bytes(r["data"])
        name = f"blocks/block_{r['block_id']:05d}.scb"
        with open(f"{staging}/{name}", "wb") as out:
            out.write(data)
        start, offsets, targets, *_ = codec.decode_block(data)
        found.append(dict(zip(DESCRIPTOR, (name, start, len(offsets) - 1, len(targets), len(data), hashlib.sha256(data).hexdigest()), strict=True)))
    manifest = {
        "format_id": BINARY_ID, "format_version": 1, "dataset_id": dataset_id, "source_url": source_url, "license": license, "n_neurons": graph.n, "n_edges": sum(b["edge_count"] for b in found), "voltage_scale_pow": 16,
        "index_dtype": "uint32", "weight_dtype": "int16", "delay_dtype": "uint16", "endianness": "little", "scope": scope, "neurons_byte_size": size, "neurons_sha256": digest.hexdigest(), "conversion": conversion or {}, "blocks": found,
    }
    with open(f"{staging}/manifest.json", "w") as out:
        out.write(json.dumps(manifest, indent=2, sort_keys=True) + "\n")
    os.rename(staging, path)


def open_binary(spark: SparkSession, path: str, *, verify_checksums: bool = True) -> Artifact:
    """A graph from the binary layout in any store that Spark reads; blocks and nodes are decoded and verified in tasks, where they are read. Each file is one value of at most 2 GB."""
    files = Files(spark, path)
    if not files.exists("manifest.json"):
        raise GraphFormatError(f"no manifest: {path}")
    try:
        manifest = json.loads(files.read_text("manifest.json"))
    except ValueError as error:
        raise GraphFormatError(f"cannot read manifest: {path}") from error
    if manifest.get("format_id") != BINARY_ID or manifest.get("format_version") != 1:
        raise GraphFormatError("unsupported artifact format")
    n, expected = manifest["n_neurons"], 0
    for b in manifest["blocks"]:
        contained(path, b["filename"])
        if set(b) != set(DESCRIPTOR) or not SHA.fullmatch(b["sha256"]):
            raise GraphFormatError("a block descriptor is malformed")
        if b["source_start"] != expected:
            raise GraphValidationError("a block does not start where the one before ends")
        expected += b["source_count"]
    if expected != n or sum(b["edge_count"] for b in manifest["blocks"]) != manifest["n_edges"]:
        raise GraphValidationError("blocks do not cover every source or every edge")
    size, sha = manifest["neurons_byte_size"], manifest["neurons_sha256"]

    def decode_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                if verify_checksums and (len(raw) != size or hashlib.sha256(raw).hexdigest() != sha):
                    raise ChecksumMismatchError("neurons.bin differs from the manifest")
                rows = codec.decode_neurons(raw, n)
                for k in range(0, max(n, 1), NODES_A_BATCH):
                    part = rows[k : k + NODES_A_BATCH]
                    yield pa.record_batch([pa.array(part["id"].astype(np.int64)), pa.array(part["external_id"].astype(np.uint64)).cast(pa.decimal128(20, 0)), *(pa.array(part[c].astype(t)) for c, t in (("type_code", np.int32), ("transmitter_code", np.int8), ("side_code", np.int8)))], names=list(codec.NEURON.names))

    neurons = spark.read.format("binaryFile").load(contained(path, "neurons.bin")).select("content").mapInArrow(decode_nodes, "id long, external_id decimal(20,0), type_code int, transmitter_code tinyint, side_code tinyint")
    try:
        if neurons.count() != n:
            raise GraphFormatError("the neuron table's size does not match the manifest")
    except PySparkException as error:
        raise translated(error) from error
    known = {os.path.basename(b["filename"]): (k, b) for k, b in enumerate(manifest["blocks"])}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                k, b = known[os.path.basename(name)]
                if verify_checksums and (len(data) != b["byte_size"] or hashlib.sha256(data).hexdigest() != b["sha256"]):
                    raise ChecksumMismatchError(f"{b['filename']} differs from the manifest")
                codec.check_block(data, n)
                start, offsets, targets, weights, delays = codec.decode_block(data)
                if (start, len(offsets) - 1, len(targets)) != (b["source_start"], b["source_count"], b["edge_count"]):
                    raise GraphFormatError(f"block descriptor does not match file: {b['filename']}")
                source = np.repeat(start + np.arange(len(offsets) - 1), np.diff(offsets))
                yield pa.record_batch([pa.array(source), pa.array((k << 32) + np.arange(len(source))), pa.array(targets.astype(np.int64)), pa.array(weights.astype(np.int32)), pa.array(delays.astype(np.int32)), pa.array(np.full(len(source), k, np.int32))], names=[x.split()[0] for x in EDGES.split(", ")])

    if known:
        edges = spark.read.format("binaryFile").option("pathGlobFilter", "*.scb").load(f"{path.rstrip('/')}/blocks").select("path", "content").mapInArrow(decode, EDGES)
    else:
        edges = spark.createDataFrame([], EDGES)
    size = max((b["source_count"] for b in manifest["blocks"]), default=1)
    return Artifact(path, manifest, Graph(neurons, edges, n, size))
