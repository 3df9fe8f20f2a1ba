"""Expected failures, by what the caller can do about them."""


class EngineError(Exception):
    """Any expected failure."""


class ConfigurationError(EngineError):
    """Settings contradict each other or are out of range."""


class GraphFormatError(EngineError):
    """Stored graph data cannot be read as a graph."""


class GraphValidationError(GraphFormatError):
    """A graph's values are out of range or inconsistent."""


class ChecksumMismatchError(GraphFormatError):
    """Stored bytes differ from their recorded digest or size."""


class DataSchemaError(EngineError):
    """A source table lacks columns or holds values of the wrong kind."""


class QuantizationError(EngineError):
    """A weight does not fit the quantizer's range."""


class ArtifactExistsError(EngineError):
    """The destination is already there."""


class PathContainmentError(EngineError):
    """A path leads out of its artifact."""


class FixedPointOverflowError(EngineError):
    """A signed 32-bit operation left its range."""


class BackendError(EngineError):
    """An execution device cannot be used."""


class BackendNotImplementedError(BackendError):
    """The device is known, but this engine does not drive it."""


class BackendUnavailableError(BackendError):
    """The device is not present."""


def translated(error: Exception) -> Exception:
    """Spark's error as one of these, where it stands for one."""
    text = str(error)
    for kind in (DataSchemaError, QuantizationError, GraphValidationError, FixedPointOverflowError):
        if f"[{kind.__name__}]" in text:
            return kind(text.split(f"[{kind.__name__}]", 1)[1].splitlines()[0].strip())
    for kind in (ChecksumMismatchError, GraphValidationError, GraphFormatError):  # raised by a task's own code
        if (mark := f"errors.{kind.__name__}: ") in text:
            return kind(text.split(mark, 1)[1].splitlines()[0].strip())
    if any(x in text for x in ("ARITHMETIC_OVERFLOW", "CAST_OVERFLOW")):
        return FixedPointOverflowError("signed 32-bit overflow")
    if "PATH_ALREADY_EXISTS" in text:
        return ArtifactExistsError(text.splitlines()[0])
    return error
