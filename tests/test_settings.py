import pytest

from voltweave import config
from voltweave.errors import BackendNotImplementedError, ConfigurationError


def test_presets_give_their_axes():
    assert config.resolve_axes(preset="portable") == config.RuntimeAxes("cpu", "resident", "compact")
    assert config.resolve_axes(preset="streamed").residency == "streamed"
    assert config.resolve_axes() == config.RuntimeAxes()


def test_explicit_axis_must_not_contradict_the_preset():
    assert config.resolve_axes(preset="full", scope="full").scope == "full"
    with pytest.raises(ConfigurationError, match="conflicts"):
        config.resolve_axes(preset="full", scope="compact")
    with pytest.raises(ConfigurationError, match="unknown preset"):
        config.resolve_axes(preset="fast")
    with pytest.raises(ConfigurationError):
        config.resolve_axes(device="tpu")


@pytest.mark.parametrize("changes", [{"decay_shifts": (32,)}, {"decay_shifts": ()}, {"threshold": 2**31}, {"reset": -(2**31) - 1}, {"refractory_steps": -1}, {"refractory_steps": 2**16}])
def test_parameters_out_of_range(changes):
    with pytest.raises(ConfigurationError):
        config.SimulationConfig(**{"threshold": 1, "reset": 0, "decay_shifts": (2,), "refractory_steps": 0} | changes)


def test_devices_are_never_replaced():
    assert config.resolve_device("auto") == "cpu"
    with pytest.raises(BackendNotImplementedError):
        config.resolve_device("cuda")
