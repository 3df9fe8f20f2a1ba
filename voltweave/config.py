"""Run settings: the axes of execution and the neuron model's integer parameters."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import BackendNotImplementedError, ConfigurationError

INT16 = (-(2**15), 2**15 - 1)
INT32 = (-(2**31), 2**31 - 1)
UINT16_MAX = 2**16 - 1
UINT32_MAX = 2**32 - 1
UINT64_MAX = 2**64 - 1

# The choices of each axis, and what a preset stands for.
DEVICES = ("auto", "cpu", "cuda", "webgpu", "spark")
RESIDENCIES = ("resident", "streamed")
SCOPES = ("full", "compact")
PRESETS = {
    "portable": ("cpu", "resident", "compact"),
    "compact": ("auto", "resident", "compact"),
    "accelerated": ("cuda", "resident", "full"),
    "streamed": ("auto", "streamed", "full"),
    "full": ("auto", "resident", "full"),
}


@dataclass(frozen=True)
class RuntimeAxes:
    device: str = "auto"
    residency: str = "resident"
    scope: str = "full"

    def __post_init__(self):
        for name, allowed in (("device", DEVICES), ("residency", RESIDENCIES), ("scope", SCOPES)):
            if getattr(self, name) not in allowed:
                raise ConfigurationError(f"unknown {name}: {getattr(self, name)}")


def resolve_axes(*, preset: str | None = None, device: str | None = None, residency: str | None = None, scope: str | None = None) -> RuntimeAxes:
    """A preset's axes, or the given ones. An explicit axis that contradicts the preset is an error, never an override."""
    given = {"device": device, "residency": residency, "scope": scope}
    if preset is None:
        return RuntimeAxes(**{k: v for k, v in given.items() if v is not None})
    if preset not in PRESETS:
        raise ConfigurationError(f"unknown preset: {preset}")
    chosen = RuntimeAxes(*PRESETS[preset])
    for name, value in given.items():
        if value is not None and value != getattr(chosen, name):
            raise ConfigurationError(f"preset {preset} conflicts with explicit {name}={value}")
    return chosen


def resolve_device(device: str) -> str:
    """The device that runs: the general processor, through Spark. Others are refused rather than replaced."""
    if device not in DEVICES:
        raise ConfigurationError(f"unknown device: {device}")
    if device in ("cuda", "webgpu"):
        raise BackendNotImplementedError(f"{device} is not driven by this engine")
    return "cpu"


@dataclass(frozen=True)
class SimulationConfig:
    """threshold, reset: 32-bit; decay_shifts: one or more of 0..31, applied in turn; refractory_steps: 16-bit, unsigned."""

    threshold: int
    reset: int
    decay_shifts: tuple[int, ...]
    refractory_steps: int

    def __post_init__(self):
        object.__setattr__(self, "decay_shifts", tuple(self.decay_shifts))
        for name, low, high in (("threshold", *INT32), ("reset", *INT32), ("refractory_steps", 0, UINT16_MAX)):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
                raise ConfigurationError(f"{name} must be between {low} and {high}")
        if not self.decay_shifts or any(not isinstance(k, int) or not 0 <= k <= 31 for k in self.decay_shifts):
            raise ConfigurationError("decay shifts must be one or more numbers between 0 and 31")


DEFAULT_CONFIG = SimulationConfig(threshold=20000, reset=0, decay_shifts=(2,), refractory_steps=2)
