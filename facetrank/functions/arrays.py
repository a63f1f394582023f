"""Arrow columns of vectors as numpy matrices, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(vectors: pa.Array) -> np.ndarray:
    """One row per vector, in double precision; null or unequal vectors are an error."""
    lengths = pc.unique(pc.list_value_length(vectors))
    if len(lengths) != 1 or not lengths[0].is_valid:
        raise ValueError("vectors of different length")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """L2 distance of every row to the query, added from the first dimension to the last; equal rows get equal results."""
    if x.shape[1] != len(query):
        raise ValueError(f"vectors of different length: {x.shape[1]} and {len(query)}")
    diff = x - query
    return np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])


def _numbered(keys: pa.Array) -> np.ndarray:
    """Equal keys as equal numbers; null is a key like any other."""
    if pa.types.is_nested(keys.type):
        known: dict[str, int] = {}
        return np.array([known.setdefault(repr(k), len(known)) for k in keys.to_pylist()], np.int64)
    return keys.dictionary_encode(null_encoding="encode").indices.to_numpy()


def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_key, _weight, _vec) to (_key, _sums, _total): weighted sums of vectors of one length, a row for each key of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        number = _numbered(batch["_key"])
        order = np.argsort(number, kind="stable")
        starts = np.flatnonzero(np.diff(number[order], prepend=-1))
        weight = batch["_weight"].to_numpy()[order]
        flat = batch["_vec"].flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order] if flat.null_count else None
        x = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).reshape(len(order), -1)[order] * weight[:, None]
        if known is not None:
            x = np.where(known, x, 0.0)
        sums = np.add.reduceat(x, starts, axis=0)
        # A place without any component stays null.
        missing = None if known is None else ~np.logical_or.reduceat(known, starts, axis=0).reshape(-1)
        places = pa.array(sums.reshape(-1), pa.float64(), mask=missing)
        offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * sums.shape[1])
        yield pa.record_batch(
            [batch["_key"].take(pa.array(order[starts])), pa.ListArray.from_arrays(offsets, places), pa.array(np.add.reduceat(weight, starts))],
            names=["_key", "_sums", "_total"])
