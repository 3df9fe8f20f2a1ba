"""Memory that a run would need, from the sizes of a graph's blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RuntimeAxes, resolve_device
from ..operators.graph import NEURON_BYTES, STATE_BYTES, Graph, block_descriptors, source_degrees


@dataclass(frozen=True)
class ExecutionPlan:
    device: str
    residency: str
    scope: str
    required_bytes: int
    capacity_status: str
    evidence: str


def plan_bytes(descriptors: DataFrame, n: int) -> DataFrame:
    """resident_bytes: all blocks; streamed_bytes: the largest one; both with neurons and state."""
    own = (NEURON_BYTES + STATE_BYTES) * n
    total, largest = F.coalesce(F.sum("byte_size"), F.lit(0)), F.coalesce(F.max("byte_size"), F.lit(0))
    return descriptors.agg((total + own).cast("long").alias("resident_bytes"), (largest + own).cast("long").alias("streamed_bytes"))


def plan(graph: Graph, axes: RuntimeAxes, *, capacity_bytes: int | None = None) -> ExecutionPlan:
    row = plan_bytes(block_descriptors(source_degrees(graph.edges, graph.neurons, graph.block_size)), graph.n).first()
    need = row["streamed_bytes"] if axes.residency == "streamed" else row["resident_bytes"]
    if capacity_bytes is None:
        status, evidence = "not tested", "no capacity was given, so the need is an estimate from block sizes"
    else:
        status, evidence = "insufficient" if capacity_bytes < need else "feasible", "the need was compared with the capacity given"
    device = axes.device if axes.device in ("cuda", "webgpu") else resolve_device(axes.device)
    return ExecutionPlan(device, axes.residency, axes.scope, need, status, evidence)
