"""The binary block and neuron layouts, for exchange with other programs.

A block: magic, version, first source, source count, edge count (32-bit), row offsets (32-bit), targets
(32-bit), weights (signed 16-bit), delays (16-bit). A neuron: index (32-bit), external id (64-bit), type
code (16-bit), transmitter and side code (signed 8-bit). All little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

from ..config import INT16, UINT16_MAX, UINT32_MAX
from ..errors import GraphFormatError, GraphValidationError

# Fixed values of the format.
MAGIC, VERSION = b"SCB1", 1
HEADER = struct.Struct("<4sIIII")
NEURON = np.dtype([("id", "<u4"), ("external_id", "<u8"), ("type_code", "<u2"), ("transmitter_code", "i1"), ("side_code", "i1")])


def encode_block(source_start: int, degrees: np.ndarray, targets: np.ndarray, weights: np.ndarray, delays: np.ndarray) -> bytes:
    """degrees: edges of each source; the other arrays in source order."""
    if not 0 <= source_start <= UINT32_MAX or len(targets) > UINT32_MAX:
        raise GraphValidationError("block dimensions are outside the unsigned 32-bit range")
    for name, a, low, high in (("target", targets, 0, UINT32_MAX), ("weight", weights, *INT16), ("delay", delays, 1, UINT16_MAX)):
        if len(a) and not (low <= int(a.min()) and int(a.max()) <= high):
            raise GraphValidationError(f"an edge's {name} is out of range")
    offsets = np.concatenate([[0], np.cumsum(degrees)]).astype("<u4")
    return HEADER.pack(MAGIC, VERSION, source_start, len(degrees), len(targets)) + offsets.tobytes() + targets.astype("<u4").tobytes() + weights.astype("<i2").tobytes() + delays.astype("<u2").tobytes()


def decode_block(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """source_start, offsets, targets, weights, delays."""
    if len(data) < HEADER.size:
        raise GraphFormatError("a block is shorter than its header")
    magic, version, start, sources, edges = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise GraphFormatError("not a graph block")
    if version != VERSION:
        raise GraphFormatError(f"unsupported block version: {version}")
    if len(data) != HEADER.size + 4 * (sources + 1) + 8 * edges:
        raise GraphFormatError("a block's size does not match its header")
    at, out = HEADER.size, []
    for kind, n in (("<u4", sources + 1), ("<u4", edges), ("<i2", edges), ("<u2", edges)):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    offsets = out[0].astype(np.int64)
    if offsets[0] != 0 or offsets[-1] != edges or (np.diff(offsets) < 0).any():
        raise GraphFormatError("a block's row offsets are inconsistent")
    return start, offsets, *out[1:]


def check_block(data: bytes, n: int) -> int:
    """The edge count of a block whose values fit a graph of n nodes."""
    start, offsets, targets, _, delays = decode_block(data)
    if start + len(offsets) - 1 > n:
        raise GraphValidationError("a block has sources beyond the graph")
    if len(targets) and int(targets.max()) >= n:
        raise GraphValidationError("an edge's target is out of range")
    if len(delays) and int(delays.min()) < 1:
        raise GraphValidationError("an edge's delay is out of range")
    return len(targets)


def encode_neurons(rows: np.ndarray) -> bytes:
    return rows.astype(NEURON).tobytes()


def decode_neurons(data: bytes, expected: int) -> np.ndarray:
    if len(data) != NEURON.itemsize * expected:
        raise GraphFormatError("the neuron table's size does not match the manifest")
    rows = np.frombuffer(data, NEURON)
    if (rows["id"] != np.arange(expected)).any():
        raise GraphFormatError("neuron indices are not contiguous")
    return rows
