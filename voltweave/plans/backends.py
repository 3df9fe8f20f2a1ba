"""What runs a graph. A backend is named by its device; this engine has one, Spark's, and refuses the rest."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from ..config import SimulationConfig, resolve_device
from ..operators.graph import Graph
from .simulate import SimulationResult, Stepper, simulate


class Backend(Protocol):
    """device: its name. A run is all steps at once; a stepper takes them one by one."""

    device: str

    def run(self, graph: Graph, config: SimulationConfig, *, timesteps: int, initial: DataFrame | None = None, residency: str = "resident") -> SimulationResult: ...

    def stepper(self, graph: Graph, config: SimulationConfig, initial: DataFrame | None = None) -> Stepper: ...


class SparkBackend:
    """Steps as DataFrame jobs on the executors' general processors."""

    device = "cpu"

    def run(self, graph: Graph, config: SimulationConfig, *, timesteps: int, initial: DataFrame | None = None, residency: str = "resident") -> SimulationResult:
        return simulate(graph, config, timesteps=timesteps, initial=initial, residency=residency)

    def stepper(self, graph: Graph, config: SimulationConfig, initial: DataFrame | None = None) -> Stepper:
        return Stepper(graph, config, initial)


BACKENDS: dict[str, Backend] = {b.device: b for b in (SparkBackend(),)}


def backend_of(device: str) -> Backend:
    """The backend that drives a device; an error for a device that is unknown or not driven, never another device."""
    return BACKENDS[resolve_device(device)]
