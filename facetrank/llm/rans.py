"""Range asymmetric numeral systems with a static table, in numpy.

A segment of ids has one frequency table for all of its blocks. A block holds LANES interleaved states (the id at
place i belongs to lane i mod LANES) and a stream of 32-bit words. Every STEPS rows of lanes a checkpoint keeps all
states and the place in the stream, so that decoding can start there; all checkpoints of a segment are decoded
side by side. Each block carries the CRC-32 of its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20  # frequencies sum up to 1 << BITS
LANES = 64
STEPS = 256
CHECKPOINTS = 4
BLOCK = LANES * STEPS * CHECKPOINTS

_LOW = np.uint64(1 << 31)  # states stay within [1 << 31, 1 << 63)
_WORD = np.uint64(32)
_SHIFT = np.uint64(BITS)
_SLOTS = np.uint64((1 << BITS) - 1)
_HEAD = struct.Struct("<4sQIII")  # magic, ids, blocks, bytes of the table, bytes of the directory
_MAGIC = b"SEG1"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled so that they sum up to 1 << BITS and that no id in use has less than 1."""
    used = np.flatnonzero(counts)
    if len(used) > 1 << (BITS - 1):
        raise ValueError(f"{len(used)} different ids; the table takes {1 << (BITS - 1)}")
    scaled = np.zeros(len(counts), np.uint64)
    share = counts[used].astype(np.float64) / counts[used].sum()
    scaled[used] = 1 + np.floor(share * ((1 << BITS) - len(used))).astype(np.uint64)
    scaled[np.argmax(scaled)] += np.uint64((1 << BITS) - int(scaled.sum()))
    return scaled


def _rows(ids: np.ndarray) -> tuple[int, int]:
    """Number of blocks, and of rows of lanes in the last one."""
    blocks = -(-len(ids) // BLOCK)
    return blocks, -(-(len(ids) - (blocks - 1) * BLOCK) // LANES)


def encode(ids: np.ndarray) -> bytes:
    """A segment from ids (unsigned, 32 bits; may be empty)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if not len(ids):
        return _HEAD.pack(_MAGIC, 0, 0, 0, 0)
    if int(ids.max()) >> BITS:
        raise ValueError("ids must be below 1 << 20")
    counts = np.bincount(ids)
    freq = frequencies(counts)
    first = np.cumsum(freq) - freq
    used = np.flatnonzero(counts)
    blocks, last_rows = _rows(ids)
    padded = np.full(blocks * BLOCK, np.argmax(counts), np.uint32)
    padded[: len(ids)] = ids
    grid = padded.reshape(blocks, STEPS * CHECKPOINTS, LANES)
    state = np.full((blocks, LANES), _LOW)
    kept = np.zeros((blocks, CHECKPOINTS, LANES), np.uint64)
    words = np.zeros(grid.shape, np.uint32)
    emitted = np.zeros(grid.shape, bool)
    room = np.uint64(63 - BITS)
    for row in range(STEPS * CHECKPOINTS - 1, -1, -1):
        n = blocks if row < last_rows else blocks - 1
        if not n:
            continue
        x, symbols = state[:n], grid[:n, row]
        f = freq[symbols]
        full = x >= (f << room)
        emitted[:n, row] = full
        words[:n, row] = x.astype(np.uint32)
        x = np.where(full, x >> _WORD, x)
        quotient = x // f
        state[:n] = (quotient << _SHIFT) + (x - quotient * f) + first[symbols]
        if row % STEPS == 0:
            kept[:n, row // STEPS] = state[:n]
    per_part = emitted.reshape(blocks, CHECKPOINTS, -1).sum(2)
    starts = np.cumsum(per_part, 1) - per_part
    stream = words[emitted]
    table = zlib.compress(np.concatenate([np.diff(used, prepend=0), freq[used]]).astype("<u4").tobytes(), 6)
    sizes = np.minimum(BLOCK, len(ids) - np.arange(blocks) * BLOCK)
    sums = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) for i in range(blocks)]
    directory = np.column_stack([sizes, per_part.sum(1), sums, starts]).astype("<u4").tobytes()
    return b"".join([
        _HEAD.pack(_MAGIC, len(ids), blocks, len(table), len(directory)),
        table, directory, kept.astype("<u8").tobytes(), stream.astype("<u4").tobytes(),
    ])


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment; a block whose checksum differs is an error."""
    magic, total, blocks, table_bytes, directory_bytes = _HEAD.unpack_from(segment)
    if magic != _MAGIC:
        raise ValueError("not a segment")
    if not total:
        return np.zeros(0, np.uint32)
    at = _HEAD.size
    table = np.frombuffer(zlib.decompress(segment[at : at + table_bytes]), "<u4")
    at += table_bytes
    directory = np.frombuffer(segment, "<u4", directory_bytes // 4, at).reshape(blocks, 3 + CHECKPOINTS)
    at += directory_bytes
    state = np.frombuffer(segment, "<u8", blocks * CHECKPOINTS * LANES, at).reshape(-1, LANES).astype(np.uint64)
    at += state.size * 8
    stream = np.frombuffer(segment, "<u4", -1, at).astype(np.uint64)
    symbols = np.cumsum(table[: len(table) // 2], dtype=np.uint64).astype(np.uint32)
    freq = table[len(table) // 2 :].astype(np.uint64)
    first = np.cumsum(freq) - freq
    of_slot = np.repeat(np.arange(len(symbols), dtype=np.int32), freq.astype(np.int64))
    block_start = np.cumsum(directory[:, 1], dtype=np.int64) - directory[:, 1]
    place = (block_start[:, None] + directory[:, 3:]).reshape(-1)
    rows = np.clip(
        -(-directory[:, :1].astype(np.int64) // LANES) - np.arange(CHECKPOINTS) * STEPS, 0, STEPS
    ).reshape(-1)
    out = np.zeros((len(rows), STEPS, LANES), np.uint32)
    for row in range(STEPS):
        n = int(np.count_nonzero(rows > row))  # only the last block is short, so these are the first n
        if not n:
            break
        x = state[:n]
        slot = x & _SLOTS
        index = of_slot[slot]
        x = freq[index] * (x >> _SHIFT) + slot - first[index]
        low = x < _LOW
        if low.any():
            order = np.cumsum(low, 1)
            x[low] = (x[low] << _WORD) | stream[(place[:n, None] + order - 1)[low]]
            place[:n] += order[:, -1]
        state[:n] = x
        out[:n, row] = symbols[index]
    ids = out.reshape(-1)[:total]
    for i in range(blocks):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) != directory[i, 2]:
            raise ValueError(f"checksum of block {i} differs")
    return ids
