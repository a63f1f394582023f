"""What a task computes: a cell of requests against the blocks of products that come by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from facetrank.functions.arrays import distances, matrix

# Fixed value: requests per matrix product within a cell.
_STRIP = 128
# Fixed value: products that share one minimum when a bound is looked for.
_SHARED = 64
# Fixed value: squares up to which single precision neither overflows nor loses the order of sums.
_MOST_SINGLE = 1e37

RANKED = "query_id long, product_code long, article_id long, variantes long, distancia double"
_RANKED_ARROW = pa.schema(
    [("query_id", pa.int64()), ("product_code", pa.int64()), ("article_id", pa.int64()),
     ("variantes", pa.int64()), ("distancia", pa.float64())]
)
#: A block of products as one row, and part of a cell of requests as one row; Arrow streams.
BLOCK = "block int, products binary, entries binary"
REQUESTS = "requests binary"


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(stream: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(stream.as_buffer()).read_all()


def nearest(
    x: np.ndarray, codes: np.ndarray, q: np.ndarray, limits: np.ndarray, within: np.ndarray | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row of q: the nearest rows of x, at most its limit, and their distances; ties go to the lower code.

    Rows farther than `within` (a distance for each row of q, infinite if none is known) may be left out.

    The matrix product, in single precision, only preselects: whatever could be among the nearest within its rounding error is estimated
    again in double precision, and what could be within that error is measured one by one, so equal vectors get equal distances in every
    cell. The bound for k rows is the k-th smallest of minima over disjoint sets of rows, which no k-th smallest value exceeds.
    """
    norms = (x * x).sum(axis=1)
    # Numbers too large for single precision become infinite or NaN there; these rows all stay in.
    with np.errstate(over="ignore", invalid="ignore"):
        x32, norms32 = x.astype(np.float32), norms.astype(np.float32)
        most, room = np.nanmax(norms), np.empty((min(len(q), _STRIP), len(x)), np.float32)
        out = []
        for start in range(0, len(q), _STRIP):
            strip = q[start:start + _STRIP]
            estimates = np.matmul((-2.0 * strip).astype(np.float32), x32.T, out=room[:len(strip)])
            estimates += norms32
            squares = (strip * strip).sum(axis=1)
            scale = most + np.nanmax(squares)
            # Sums of d products err by less than (d + 4) units of rounding, as a share of their size.
            slack32 = 4.0 * (x.shape[1] + 4) * float(np.finfo(np.float32).eps) * scale if scale < _MOST_SINGLE else np.inf
            # An estimate lacks the square of the request.
            bounds = np.full(len(strip), np.inf) if within is None else within[start:start + _STRIP] ** 2 - squares
            if not np.isfinite(bounds).all():
                whole = len(x) // _SHARED * _SHARED
                # A minimum with NaN is NaN, which partition puts last.
                minima = np.minimum.reduce(estimates[:, :whole].reshape(len(strip), _SHARED, -1), axis=1) if whole else estimates
                for j, limit in enumerate(limits[start:start + _STRIP]):
                    k = min(int(limit), len(x))
                    least = minima[j] if k <= minima.shape[1] else estimates[j]
                    bounds[j] = np.fmin(np.partition(least, k - 1)[k - 1], bounds[j])
            # Negated, so that a vector with NaN stays in and sorts last, as in Spark's order.
            beyond = estimates > (bounds + slack32).astype(np.float32)[:, None]
            kept = np.flatnonzero(np.logical_not(beyond, out=beyond))
            ends = np.searchsorted(kept, len(x) * np.arange(len(strip) + 1))
            for j, query in enumerate(strip):
                near = kept[ends[j]:ends[j + 1]] - j * len(x)
                k = min(int(limits[start + j]), len(x))
                if len(near) > k:
                    estimate = norms[near] - 2.0 * (x[near] @ query)
                    near = near[~(estimate > np.partition(estimate, k - 1)[k - 1] + 1e-9 * scale)]
                if not len(near):
                    out.append((near, np.empty(0)))
                    continue
                exact = distances(x[near], query)
                best = np.lexsort((codes[near], exact))[:k]
                out.append((near[best], exact[best]))
    return out


class Cell:
    """The requests of a cell, and the nearest products that each has met so far: at most its limit.

    Blocks may come in any order and number: what a request keeps is the exact top of all that it has met.
    """

    def __init__(self, requests: pa.Table):
        self.ids = requests["query_id"].to_numpy()
        self.q = matrix(requests["query_vec"].combine_chunks())
        self.limits = requests["limite"].to_numpy().astype(np.int64)
        ends = np.cumsum(self.limits)
        self.starts, self.filled = ends - self.limits, np.zeros(len(self.ids), np.int64)
        self.within = np.full(len(self.ids), np.inf)
        self.distance = np.empty(ends[-1])
        self.code, self.article, self.variants = np.empty((3, ends[-1]), np.int64)
        together: dict[tuple[int, ...], list[int]] = {}
        for i, keys in enumerate(requests["keys"].to_pylist()):
            together.setdefault(tuple(sorted(keys)), []).append(i)
        self.together = {keys: np.array(asking) for keys, asking in together.items()}

    def meet(self, products: pa.Table, entries: pa.Table) -> None:
        """Products come once, `entries` in the order of their keys. Requests for the same keys are ranked together."""
        x = matrix(products["embedding"].combine_chunks())
        if x.shape[1] != self.q.shape[1]:
            raise ValueError(f"vectors of different length: {x.shape[1]} and {self.q.shape[1]}")
        codes = products["product_code"].to_numpy()
        key, row, article, variants = (entries[c].to_numpy() for c in ("key_id", "row", "article_id", "variantes"))
        for keys, asking in self.together.items():
            bounds = np.searchsorted(key, [(k, k + 1) for k in keys])
            found = np.concatenate([np.arange(a, b) for a, b in bounds])
            if not len(found):
                continue
            # A request for several colours meets a product once per colour.
            rows, place = np.unique(row[found], return_inverse=True)
            lowest = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(lowest, place, article[found])
            count = np.bincount(place, weights=variants[found]).astype(np.int64)
            some = codes[rows]
            for i, (best, measured) in zip(asking, nearest(x[rows], some, self.q[asking], self.limits[asking], self.within[asking])):
                if len(best):
                    self._keep(i, measured, some[best], lowest[best], count[best])

    def _keep(self, i: int, measured: np.ndarray, codes: np.ndarray, articles: np.ndarray, variants: np.ndarray) -> None:
        start, limit = self.starts[i], self.limits[i]
        had = slice(start, start + self.filled[i])
        measured, codes = np.concatenate([self.distance[had], measured]), np.concatenate([self.code[had], codes])
        best = np.lexsort((codes, measured))[:limit]
        now = slice(start, start + len(best))
        articles, variants = np.concatenate([self.article[had], articles])[best], np.concatenate([self.variants[had], variants])[best]
        self.distance[now], self.code[now], self.article[now], self.variants[now] = measured[best], codes[best], articles, variants
        self.filled[i] = len(best)
        if len(best) == limit:
            last = self.distance[start + limit - 1]
            # NaN sorts last: until a request has enough numbers, all that it meets is nearer.
            self.within[i] = np.inf if np.isnan(last) else last

    def best(self) -> pa.Table:
        """The rows of all requests, each request's from the nearest on."""
        request = np.repeat(np.arange(len(self.ids)), self.filled)
        place = np.arange(len(request)) - np.repeat(np.cumsum(self.filled) - self.filled, self.filled) + self.starts[request]
        columns = (self.ids[request], self.code[place], self.article[place], self.variants[place], self.distance[place])
        return pa.table([pa.array(c) for c in columns], schema=_RANKED_ARROW)


def _entries(products: pa.Table) -> pa.Table:
    """(key_id, row, article_id, variantes) of all products, in the order of keys and rows."""
    under = products["under"].combine_chunks()
    listed = under.flatten()
    row = np.repeat(np.arange(len(under), dtype=np.int32), under.value_lengths().to_numpy(zero_copy_only=False))
    key, article, variants = (listed.field(c).to_numpy(zero_copy_only=False) for c in ("key_id", "article_id", "variantes"))
    order = np.argsort(key, kind="stable")
    return pa.table({"key_id": key[order], "row": row[order], "article_id": article[order], "variantes": variants[order]})


def nearest_in_block(products: pa.Table, requests: pa.Table) -> pa.Table:
    """The nearest products of one block for each request of a cell, at most `limite` rows each.

    A product comes once, with the keys that it is under; a request comes with the keys that it asks for.
    """
    if products.num_rows == 0 or requests.num_rows == 0:
        return _RANKED_ARROW.empty_table()
    cell = Cell(requests)
    cell.meet(products, _entries(products))
    return cell.best()


def pack_block(products: pa.Table) -> pa.Table:
    """The products of a block as one row."""
    streams = [_stream(t) for t in (products.select(["product_code", "embedding"]), _entries(products))]
    return pa.table([products["block"][:1].combine_chunks(), *([s] for s in streams)], schema=pa.schema(
        [("block", pa.int32()), ("products", pa.binary()), ("entries", pa.binary())]))


def pack_requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The requests of a partition as a row for each batch, after a row without any."""
    begun = False
    for batch in batches:
        if batch.num_rows:
            for stream in ([] if begun else [None]) + [_stream(pa.Table.from_batches([batch]))]:
                yield pa.record_batch([pa.array([stream], pa.binary())], names=["requests"])
            begun = True


def nearest_in_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, products, entries, requests) to the nearest products of each request.

    The first block comes with each row of the cell's requests and once without; the other blocks come once, without requests.
    """
    cell, parts, waiting = None, [], []

    def meet() -> None:
        nonlocal cell
        cell = cell or Cell(pa.concat_tables(parts))
        while waiting:
            cell.meet(*map(_table, waiting.pop()))

    for batch in batches:
        for first, products, entries, requests in zip(*batch.columns):
            if requests.is_valid:
                parts.append(_table(requests))
            else:
                waiting.append((products, entries))
            if not first.as_py():
                meet()
    if waiting:
        meet()
    if cell:
        yield from cell.best().to_batches(max_chunksize=65_536)
