"""Token ids of documents in compressed binary files, in ascending order of the documents.

Documents are dealt by ranges of doc_id and sorted; each task writes one file of segments (see `rans`), each of
whole documents and at least SEGMENT ids, with the list of its documents. Only files of attempts that count are
listed in the manifest. Segments are read and decoded independently.

Null or empty texts have only the end id. Rows may repeat a doc_id: each has its own ids, ordered by text. A null
doc_id comes first. Other columns are not read. An empty table makes no file and reads back empty.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetrank.llm import rans, tokens
from facetrank.llm.files import Appender, read_range, task_file
from facetrank.shared import scratch_path, write_once

SEGMENT = 1 << 21

MANIFEST = "task int, segment int, path string, offset long, length long, n_tokens long"
ENCODED = "doc_id long, start long, ids binary"

_HEAD = struct.Struct("<II")  # documents, bytes of their list


def _pack_segment(doc_ids: list[int | None], encoded: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(encoded), tokens.ID)
    listed = zlib.compress(b"".join([
        np.array([i is not None for i in doc_ids], "u1").tobytes(),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        np.array([len(x) // 4 for x in encoded], "<u8").tobytes(),
    ]))
    return _HEAD.pack(len(doc_ids), len(listed)) + listed + rans.encode(ids)


def _unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    n, size = _HEAD.unpack_from(data)
    listed = zlib.decompress(data[_HEAD.size : _HEAD.size + size])
    known = np.frombuffer(listed, "u1", n)
    doc_ids = np.frombuffer(listed, "<i8", n, n).tolist()
    lengths = np.frombuffer(listed, "<u8", n, 9 * n).astype(np.int64)
    return [i if k else None for i, k in zip(doc_ids, known)], lengths, rans.decode(data[_HEAD.size + size :])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode whole texts, write the files, and return their manifest (one row for each segment)."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    end = np.array([end_id], tokens.ID).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = Appender(task_file(folder, "rans"))
        task, segment, doc_ids, encoded, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            data = _pack_segment(doc_ids, encoded)
            row = (task, segment, out.uri, out.write(data), len(data), held)
            names = ("task", "segment", "path", "offset", "length", "n_tokens")
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                encoded.append(tokens.encode(tokenizer_path, text) + end)
                held += len(encoded[-1]) // 4
                if held >= SEGMENT:
                    yield flush()
                    segment, doc_ids, encoded, held = segment + 1, [], [], 0
        if doc_ids:
            yield flush()
        out.close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    return write_once(ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), ids (little-endian unsigned 32-bit).

    Each block's checksum is checked. What lies before a segment comes from sums of the manifest: over one row for
    each file, and over the segments of a file.
    """
    files = manifest.groupBy("task").agg(F.sum("n_tokens").alias("_n"))
    before_file = F.sum("_n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("task", F.coalesce(before_file, F.lit(0)).alias("_before"))
    before = F.sum("n_tokens").over(
        Window.partitionBy("task").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = manifest.join(files, "task").withColumn("start", F.col("_before") + F.coalesce(before, F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, lengths, ids = _unpack_segment(read_range(row["path"], row["offset"], row["length"]))
                data = ids.astype(tokens.ID).tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts + row["start"], pa.int64()),
                        pa.array([data[4 * a : 4 * b] for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select("path", "offset", "length", "start").repartition(tasks, "path", "offset")
    return dealt.mapInArrow(run, ENCODED)
