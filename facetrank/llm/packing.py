"""Documents packed into sequences of a fixed number of tokens by the sum-of-squares rule.

Each task packs its own rows as they come. Whole sequences are cut off a long document; its rest goes to the fill
level that makes the sum of squared counts of partially filled sequences smallest (ties: the fullest). Counts are
kept in an array by level. A task that holds MAX_OPEN open sequences fills the fullest of them with the tail of the emptiest,
until one of both is gone, and goes on with the levels as they are; when it ends it does so with all that are open. So at
most one sequence a task is padded. Nothing is shuffled.

Null or empty texts have only the end id. Rows may repeat a doc_id: each is packed by itself. A null doc_id stays
null. Other columns are not read. An empty table has no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.llm import tokens

#: Open sequences that a task holds at most (4 KB each).
MAX_OPEN = 4096

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())


class SumOfSquares:
    """Windows of `size` tokens. A piece is [doc_id, start, ids, doc_tokens], ids as bytes, four for each token."""

    def __init__(self, size: int, first_id: int = 0):
        self.size, self.next_id = size, first_id
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(size)]
        self.closed: list[tuple] = []
        self.n_open = 0

    def level_for(self, length: int) -> int:
        """Fill level (0: a new window) to put a piece shorter than a window into."""
        n, size = self.counts, self.size
        fits = n[1 : size - length + 1]
        if not fits.any():
            return 0
        change = 2 * (n[1 + length : size + 1] - fits) + 2
        change[-1] -= 1  # a window that gets full is counted no more
        change[fits == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * n[length] + 1 else 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        size = self.size
        total = len(ids) // 4
        whole = total - total % size
        for start in range(0, whole, size):
            self._close(self._new_id(), [[doc_id, start, ids[4 * start : 4 * (start + size)], total]])
        if total > whole:
            self._place([doc_id, whole, ids[4 * whole :], total], total - whole)
            self.n_open = int(self.counts.sum())
            while self.n_open >= MAX_OPEN:
                self._fill_fullest()

    def _place(self, piece: list, length: int) -> None:
        level = self.level_for(length)
        if level:
            window, pieces = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window, pieces = self._new_id(), []
        pieces.append(piece)
        if level + length == self.size:
            self._close(window, pieces)
        else:
            self.open[level + length].append((window, pieces))
            self.counts[level + length] += 1

    def _fill_fullest(self) -> None:
        """Move a tail of the emptiest open window to the fullest: one of them is full or gone then."""
        held = np.flatnonzero(self.counts)
        low, high = int(held[0]), int(held[-1])
        window, pieces = self.open[high].pop()
        donor, given = self.open[low].pop()
        self.counts[high] -= 1
        self.counts[low] -= 1
        while given and high < self.size:
            doc_id, start, ids, total = given[-1]
            length = len(ids) // 4
            moved = min(length, self.size - high)
            cut = length - moved
            pieces.append([doc_id, start + cut, ids[4 * cut :], total])
            if cut:
                given[-1][2] = ids[: 4 * cut]
            else:
                given.pop()
            high += moved
            low -= moved
        self.n_open -= 2
        for level, number, left in ((high, window, pieces), (low, donor, given)):
            if level == self.size:
                self._close(number, left)
            elif left:
                self.open[level].append((number, left))
                self.counts[level] += 1
                self.n_open += 1

    def finish(self) -> None:
        """Close all windows: tails are cut off the emptiest to fill the fullest."""
        self.n_open = int(self.counts.sum())
        while self.n_open > 1:
            self._fill_fullest()
        for level in range(1, self.size):
            for window, pieces in self.open[level]:
                self._close(window, pieces)
        self.open = [[] for _ in range(self.size)]
        self.counts[:] = 0

    def _new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _close(self, window: int, pieces: list[list]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            self.closed.append((doc_id, start, length, ids, total, window, offset))
            offset += length

    def take(self) -> pa.RecordBatch:
        rows, self.closed = self.closed, []
        columns = zip(*rows) if rows else [[]] * len(_KINDS)
        names = [field.split()[0] for field in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 1024) -> DataFrame:
    """Pieces of all documents (see PIECES). Each sequence holds its pieces without gaps from offset 0."""
    end = np.array([end_id], tokens.ID).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = SumOfSquares(size, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc_id, tokens.encode(tokenizer_path, text) + end)
                if len(packer.closed) >= 4096:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)
