"""Command line: run, plan, benchmark, convert, inspect. Expected errors print a line and exit with 1."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from .config import DEFAULT_CONFIG, DEVICES, PRESETS, RESIDENCIES, SCOPES, resolve_axes
from .errors import ArtifactExistsError, EngineError
from .functions.quantize import WeightQuantizer
from .operators import etl
from .operators.graph import Graph, example
from .plans.backends import backend_of
from .plans.planner import plan
from .shipping import ship
from .sources.artifact import Files, load_artifact, open_artifact, open_binary, write_artifact
from .sources.feather import columns, local_file, read_feather
from .sources.tables import Columns

EXAMPLE_START = (32767, 0, 0, 0)


def session() -> SparkSession:
    spark = SparkSession.builder.appName("voltweave").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def load(spark: SparkSession, dataset: str, residency: str) -> Graph:
    if dataset == "example":
        return example(spark)
    if os.path.isfile(os.path.join(dataset, "neurons.bin")):
        return open_binary(spark, dataset).graph
    if not Files(spark, dataset).exists():
        raise ValueError(f"no artifact is known by this name or path: {dataset}")
    return (open_artifact if residency == "streamed" else load_artifact)(spark, dataset).graph


def _axes(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--dataset", default="example")
    parser.add_argument("--device", choices=DEVICES)
    parser.add_argument("--residency", choices=RESIDENCIES)
    parser.add_argument("--scope", choices=SCOPES)
    parser.add_argument("--preset", choices=sorted(PRESETS))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voltweave")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("run", "benchmark"):
        p = commands.add_parser(name)
        _axes(p)
        p.add_argument("--timesteps", type=int, default=4)
        p.add_argument("--seed-node", type=int, help="node that starts at --seed-potential")
        p.add_argument("--seed-potential", type=int, default=30000)
        p.add_argument("--json", action="store_true", help="one line of JSON with spikes per step")
    p = commands.add_parser("plan")
    _axes(p)
    p.add_argument("--capacity-bytes", type=int)
    p = commands.add_parser("convert")
    for name in ("weights", "annotations", "labels", "output", "annotation-id", "label-id", "label-name", "sign-mapping"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--annotation-type")
    p.add_argument("--annotation-side")
    p.add_argument("--weight-pre", default="body_pre")
    p.add_argument("--weight-post", default="body_post")
    p.add_argument("--weight-value", default="weight")
    p.add_argument("--exclude-label", action="append", default=[])
    p.add_argument("--block-size", type=int, default=100_000)
    p.add_argument("--batch-rows", type=int, default=65536)
    p.add_argument("--weight-scale-num", type=int, default=1)
    p.add_argument("--weight-scale-den", type=int, default=1)
    p.add_argument("--overflow", choices=("reject", "saturate"), default="reject")
    p.add_argument("--scope", choices=SCOPES, default="full")
    p.add_argument("--node-filter", choices=etl.NODE_FILTERS, default="raw_endpoints")
    p.add_argument("--delay-steps", type=int, default=1)
    p.add_argument("--dataset-id", default="local")
    p.add_argument("--source-url")
    p.add_argument("--license")
    p = commands.add_parser("inspect")
    p.add_argument("--file", required=True)
    return top


def run(args: argparse.Namespace) -> str:
    axes = resolve_axes(preset=args.preset, device=args.device, residency=args.residency, scope=args.scope)
    backend = backend_of(axes.device)
    spark = session()
    graph = load(spark, args.dataset, axes.residency)
    start = None
    if args.dataset == "example":
        start = spark.createDataFrame(list(enumerate(EXAMPLE_START)), "id long, v int")
    elif args.seed_node is not None:
        from pyspark.sql import functions as F

        start = graph.neurons.select("id", F.when(F.col("id") == args.seed_node, args.seed_potential).otherwise(0).alias("v"))
    began = time.perf_counter()
    result = backend.run(graph, DEFAULT_CONFIG, timesteps=args.timesteps, initial=start, residency=axes.residency)
    took = time.perf_counter() - began
    said = f"measured device={backend.device} requested_device={axes.device} residency={axes.residency} scope={axes.scope} timesteps={args.timesteps}"
    if args.json:
        steps = [r["spikes"] for r in result.step_summary.orderBy("t").collect()]
        return json.dumps({"device": backend.device, "residency": axes.residency, "scope": axes.scope, "timesteps": args.timesteps, "spikes": steps, "wall_seconds": round(took, 6), "evidence": "measured"}, sort_keys=True)
    if args.command == "benchmark":
        return f"{said} wall_seconds={took:.6f} spikes={result.spike_count}"
    return f"{said} spikes={result.spike_count} digest={result.spike_digest}"


def show_plan(args: argparse.Namespace) -> str:
    axes = resolve_axes(preset=args.preset, device=args.device, residency=args.residency, scope=args.scope)
    p = plan(load(session(), args.dataset, "streamed"), axes, capacity_bytes=args.capacity_bytes)
    return f"plan device={p.device} residency={p.residency} scope={p.scope} required_bytes={p.required_bytes} capacity={p.capacity_status} evidence={p.evidence}"


def convert(args: argparse.Namespace) -> str:
    signs = json.loads(args.sign_mapping)
    if not isinstance(signs, dict):
        raise ValueError("the file of signs must hold a JSON object")
    conversion = etl.Conversion(
        signs=signs, excluded=frozenset(args.exclude_label), quantizer=WeightQuantizer(args.weight_scale_num, args.weight_scale_den, args.overflow),
        node_filter=args.node_filter, scope=args.scope, delay=args.delay_steps, block_size=args.block_size,
    )
    names = Columns(args.annotation_id, args.label_id, args.label_name, args.annotation_type, args.annotation_side, args.weight_pre, args.weight_post, args.weight_value)
    for path, label in ((args.weights, "weights"), (args.annotations, "annotations"), (args.labels, "labels")):
        local_file(path, label)
    spark = session()
    if Files(spark, args.output).exists():
        raise ArtifactExistsError(f"artifact already exists: {args.output}")
    wanted = lambda *c: [x for x in c if x]
    made = etl.convert(
        read_feather(spark, args.weights, wanted(names.pre, names.post, names.weight), batch_rows=args.batch_rows),
        read_feather(spark, args.annotations, wanted(names.annotation_id, names.annotation_type, names.annotation_side), batch_rows=args.batch_rows),
        read_feather(spark, args.labels, wanted(names.label_id, names.label_name), batch_rows=args.batch_rows), names, conversion,
    )
    report = made.report.first()
    codes = lambda df: {r["label"]: r["code"] for r in df.collect()}
    notes = {
        "columns": names.__dict__, "sign_mapping": signs, "excluded": sorted(conversion.excluded), "node_filter": conversion.node_filter, "quantizer": conversion.quantizer.__dict__, "delay_steps": conversion.delay,
        "type_codes": codes(made.type_codes), "side_codes": codes(made.side_codes), "excluded_edges": report["excluded_edges"], "saturated_weights": report["saturated_weights"],
        "sources_sha256": {label: sha256_of(path) for path, label in ((args.weights, "weights"), (args.annotations, "annotations"), (args.labels, "labels"))},
    }
    write_artifact(Graph(made.neurons, made.edges, report["n_neurons"], conversion.block_size), args.output, dataset_id=args.dataset_id, source_url=args.source_url, license=args.license, scope=args.scope, conversion=notes)
    return f"measured converted={args.output} neurons={report['n_neurons']} edges={report['n_edges']} excluded_edges={report['excluded_edges']} saturated_weights={report['saturated_weights']}"


def sha256_of(path: str) -> str:
    import hashlib

    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def inspect(args: argparse.Namespace) -> str:
    names = columns(args.file)
    return "\n".join([f"local schema file={args.file} columns={len(names)}", *(f"- {n}" for n in names)])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print({"run": run, "benchmark": run, "plan": show_plan, "convert": convert, "inspect": inspect}[args.command](args))
    except (EngineError, ValueError, TypeError) as error:
        print(f"error {error}")
        return 1
    except Exception as error:
        from .errors import translated

        known = translated(error)
        if known is error:
            raise
        print(f"error {known}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
