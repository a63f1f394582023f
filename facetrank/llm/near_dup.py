"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct shingles of consecutive words (A-Z in lower case); with fewer words than a shingle
has, the whole sequence is one shingle. Equal sets are joined by a 128-bit digest first and go on as one. A
signature has CHUNKS * WIDTH places, each the lowest 8 bits of a minimum under a hash function of its own; the
distance of two signatures is the number of places that differ. By the pigeonhole principle, signatures at a
distance of at most GUARANTEED agree in some chunk up to one place; so each chunk is entered into the index
once for each place left out. All pairs under that distance meet under some key, and so do nearly all beyond it that
matter: at a similarity of 0.8 a pair misses all keys with a chance of 2e-6.

Links are confirmed on full sets (64-bit hashes of whole shingles). In a first round each document is compared with the
partner, among the smallest documents under its keys, with which it shares most keys; that joins most copies without
forming all pairs of a group. Then the documents under each key are clustered by their signatures, so that any two
at a distance of at most THRESHOLD come into one cluster: documents up to SETTLED + THRESHOLD places from the key's smallest
document are in its star, those up to SETTLED places need no other one, and the rest meet each other in cells of at most
two blocks of HOLDERS, where the same is done again with the next smallest document until none is left. (If a document is
settled by a leader, all within THRESHOLD of it are in that leader's star, by the triangle inequality.) A cell returns no
more edges than join its documents. Clusters that the first round left in several components
are cut into blocks; each pair of blocks is a cell of at most BLOCK * BLOCK documents, which compares whole sets and
returns no more links than join its components. So a group of documents that are alike, but not enough, costs
arithmetic, not rows. No group is capped: two documents that share a key and lie within THRESHOLD are always compared, those
within GUARANTEED always share one. At a similarity of 0.8 the distance exceeds THRESHOLD with a chance of 1e-7.

Documents without words are linked with nothing. Rows that share a doc_id are one document. Rows with a null doc_id
take no part: component_id is null and they are kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.llm.common import held, join_hot, map_batches, words
from facetrank.llm.components import connected_components
from facetrank.shared import write_once

CHUNKS = 10
WIDTH = 5
PLACES = CHUNKS * WIDTH
GUARANTEED = 2 * CHUNKS - 1
#: Places that two signatures differ in at most, if sharing a key is to bring them together for certain.
THRESHOLD = 26
#: A document so close to a key's leader shares all its partners with it.
SETTLED = 10
#: Documents of a block of signatures, and of one of whole sets.
HOLDERS = 4096
BLOCK = 2048
#: Shingles that a cell handles at once.
_COLUMNS = 1024
_LONGS = -(-PLACES // 8)

#: Hashes of words that a worker remembers; hashing one again costs little.
REMEMBERED = 100_000

_ODD = np.random.default_rng(11).integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MORE = np.random.default_rng(12).integers(0, 1 << 63, PLACES, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (an invertible mixing step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = words(text.lower() if text and text.isascii() else _lower(text))
    if not found:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(held(("word hashes",), _WordHashes).__getitem__, found), np.uint64, len(found))
    size = min(size, len(word))
    # The number of words is part of the hash: a lone word equals no longer shingle.
    total = np.full(len(word) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + word[i : len(word) - size + 1 + i])
    return np.unique(total)


def _lower(text: str | None) -> str | None:
    """A-Z only."""
    return text and text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def signature(found: np.ndarray) -> np.ndarray:
    """One byte for each place."""
    lowest = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096, None]
        lowest = np.minimum(lowest, _turned(part).min(0))
    return _mixed(lowest).astype(np.uint8)


def _turned(x: np.ndarray) -> np.ndarray:
    x = (x ^ _MORE) * _ODD
    return x ^ (x >> np.uint64(32))


def keys(signatures: np.ndarray) -> np.ndarray:
    """Index keys, PLACES for each signature: chunk, place left out, the other places."""
    chunks = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    out = np.zeros((len(chunks), CHUNKS, WIDTH), np.uint64)
    for left_out in range(WIDTH):
        value = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(left_out)
        value = np.broadcast_to(value, chunks.shape[:2])
        for place in range(WIDTH):
            if place != left_out:
                value = value * np.uint64(256) + chunks[:, :, place]
        out[:, :, left_out] = value
    return out.reshape(len(chunks), PLACES).astype(np.int64)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (null: no words), signature as longs of eight places."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, rows = [], [], []
        for text in batch.column(1).to_pylist():
            found = shingles(text, size)
            counts.append(len(found))
            digests.append(xxhash.xxh3_128_digest(found.astype("<u8").tobytes()) if len(found) else None)
            longs = np.zeros(_LONGS * 8, np.uint8)
            if len(found):
                longs[:PLACES] = signature(found)
            rows.append(longs)
        longs = np.array(rows, np.uint8).reshape(-1, _LONGS * 8).view("<i8")
        signatures = pa.ListArray.from_arrays(
            pa.array(np.arange(0, longs.size + 1, _LONGS), pa.int32()), pa.array(longs.reshape(-1)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), signatures],
            ["doc_id", "n_shingles", "set_hash", "signature"],
        )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(read, run, "doc_id long, n_shingles long, set_hash binary, signature array<long>")


def _entries(leaders: DataFrame) -> DataFrame:
    """key, node: PLACES rows for each leader."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        longs = np.array(batch.column(1).flatten(), "<i8").reshape(-1, _LONGS)
        found = keys(np.ascontiguousarray(longs).view(np.uint8)[:, :PLACES])
        nodes = np.repeat(np.array(batch.column(0), np.int64), PLACES)
        return pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), pa.array(nodes)], ["key", "node"])

    return map_batches(leaders.select("node", "signature"), run, "key long, node long")


def distance(a: Column, b: Column) -> Column:
    """Places in which two signatures differ."""

    def differing(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        # Fold each byte into its lowest bit.
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(x)

    return reduce(add, [differing(i) for i in range(_LONGS)])


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, found: the sets of some documents, sorted 64-bit hashes. One plan for any number of them."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = texts.join(nodes.hint("merge"), "node", "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, size).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "found"])

    return write_once(map_batches(texts, run, "node long, found binary"), "shingle-sets")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (v, u) with 100 * intersection >= percent * union of their sets in `full`."""
    both = pairs.join(full.select(F.col("node").alias("u"), F.col("found").alias("_b")), "u")
    both = both.join(full.select(F.col("node").alias("v"), F.col("found").alias("_a")), "v").select("v", "u", "_a", "_b")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = []
        for a, b in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
            common = len(np.intersect1d(a, b, assume_unique=True))
            near.append(bool(len(a)) and 100 * common >= percent * (len(a) + len(b) - common))
        return batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return map_batches(both, compare, "v long, u long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists."""
    sizes = [len(x) for x in left + right]
    _, column, held = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    used = held > 1
    column, row = (np.cumsum(used) - 1)[column[used[column]]], row[used[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(used.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        part = np.zeros((len(sizes), min(_COLUMNS, int(used.sum()) - first)), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def joining_links(nodes: list[int], components: list[int], blocks: list[bool], sets: list[np.ndarray],
                  percent: int) -> list[tuple[int, int]]:
    """Links between the first and the second block (given by False and True; one block: all pairs in it), as many as
    join the components that they reach."""
    own = np.array(components)
    first, second = ([i for i, x in enumerate(blocks) if x == side] for side in (False, True))
    if not second:
        commonest = max(set(components), key=components.count)
        first, second = [i for i in first if own[i] != commonest], first
    if not first or not second:
        return []
    common = common_counts([sets[i] for i in first], [sets[i] for i in second])
    n = np.array([len(x) for x in sets])
    union = n[first][:, None] + n[second][None, :] - common
    near = (100 * common >= percent * union) & (own[first][:, None] != own[second][None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(near)):
        a, b = find(int(own[first[i]])), find(int(own[second[j]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((nodes[first[i]], nodes[second[j]]))
    return links


def _links_in_clusters(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """v, u of links that join components; members: node, component, cluster."""
    counts = members.groupBy("cluster").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"),
        F.min("component").alias("_a"), F.max("component").alias("_b"),
    ).filter("_a < _b").select("cluster", "blocks")
    members = join_hot(members, counts, ["cluster"], F.xxhash64("node"))
    block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = members.withColumn("block", block).withColumn("other", other).select(
        "node", "component", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).alias("second"),
    )
    rows = cells.join(full, "node").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cell: list[tuple]) -> pa.RecordBatch:
            nodes, components, second, sets = ([r[c] for r in cell] for c in (0, 1, 2, 3))
            found = joining_links(nodes, components, second, sets, percent)
            return pa.RecordBatch.from_arrays(
                [pa.array([v for v, _ in found], pa.int64()), pa.array([u for _, u in found], pa.int64())], ["v", "u"])

        cell, key = [], None
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for k in range(len(batch)):
                here = (columns["cluster"][k], columns["i"][k], columns["j"][k])
                if here != key and cell:
                    yield links(cell)
                    cell = []
                key = here
                cell.append((columns["node"][k], columns["component"][k], columns["second"][k],
                             np.frombuffer(columns["found"][k], "<u8")))
        if cell:
            yield links(cell)

    return rows.mapInArrow(run, "v long, u long")


def close_edges(nodes: np.ndarray, signatures: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join all pairs within THRESHOLD; nodes in ascending order, one row of bytes each. At most one fewer than nodes."""
    component = np.arange(len(nodes))
    pool = np.arange(len(nodes))
    edges = []
    while len(pool) > 1:
        leader, others = pool[0], pool[1:]
        apart = np.count_nonzero(signatures[others] != signatures[leader], axis=1)
        star = others[apart <= SETTLED + THRESHOLD]
        labels, first = np.unique(component[star], return_index=True)
        new = labels != component[leader]
        edges += [(int(nodes[i]), int(nodes[leader])) for i in star[first[new]]]
        if new.any():
            component[np.isin(component, labels)] = component[leader]
        pool = others[apart > SETTLED]
    return edges


def _edges_in_keys(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """v, u from (key, node): `close_edges` of the nodes under each key."""
    counts = rest.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = counts.select("key", F.ceil(F.col("_n") / HOLDERS).cast("int").alias("blocks"))
    members = join_hot(rest, blocks, ["key"], F.xxhash64("node"))
    block, other = F.pmod(F.xxhash64("node"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = members.withColumn("block", block).withColumn("other", other).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node")
    rows = cells.join(sets.select("node", "signature"), "node").select("key", "i", "j", "node", "signature")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            columns = list(zip(*edges)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["v", "u"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            keys_ = np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(3)])
            nodes = np.asarray(batch.column(3))
            longs = np.ascontiguousarray(np.asarray(batch.column(4).flatten(), "<i8").reshape(-1, _LONGS))
            found = [keys_, nodes, longs.view(np.uint8)[:, :PLACES]]
            if held is not None:
                found = [np.concatenate(x) for x in zip(held, found)]
            keys_, nodes, signatures = found
            starts = np.flatnonzero(np.any(keys_[1:] != keys_[:-1], axis=1)) + 1
            edges = []
            for a, b in zip([0, *starts], starts):
                if b - a > 1:
                    edges += close_edges(nodes[a:b], signatures[a:b])
            last = int(starts[-1]) if len(starts) else 0
            held = [x[last:] for x in found]
            yield out(edges)
        if held is not None:
            yield out(close_edges(held[1], held[2]))

    return rows.mapInArrow(run, "v long, u long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reached over links), kept: one row for each row."""
    rows = write_once(signed(docs, size), "signatures")
    sets = rows.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    sets = sets.groupBy("set_hash").agg(
        F.min("doc_id").alias("node"), F.max("doc_id").alias("_last"), F.first("signature").alias("signature"))
    sets = write_once(sets, "distinct-sets")
    # Only keys under which two documents meet are of use; few are.
    entries = write_once(_entries(sets), "index")
    met = entries.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("_most"))
    met = met.filter("least < _most").select("key", "least")
    shared = write_once(join_hot(entries, met, ["key"], F.xxhash64("node")).filter("node <> least"), "shared-keys")
    mine, other = sets.select(F.col("node").alias("v"), "signature"), sets.select(
        F.col("node").alias("u"), F.col("signature").alias("other"))
    stars = shared.groupBy(F.col("node").alias("v"), F.col("least").alias("u")).agg(F.count(F.lit(1)).alias("n_keys"))
    apart = distance(F.col("signature"), F.col("other")).alias("apart")
    stars = write_once(stars.join(mine, "v").join(other, "u").select("v", "u", "n_keys", apart), "stars")
    nodes = stars.select(F.col("v").alias("node")).unionByName(stars.select(F.col("u").alias("node"))).distinct()
    full = shingle_sets(docs, nodes, size)

    best = stars.groupBy("v").agg(F.max(F.struct("n_keys", (-F.col("u")).alias("u"))).alias("best"))
    first = write_once(best.select("v", (-F.col("best.u")).alias("u")), "first-pairs")
    links = write_once(confirmed(first, full, percent), "links")
    components = write_once(connected_components(links), "components")

    close = stars.filter(F.col("apart") <= SETTLED + THRESHOLD).select("v", "u")
    far = stars.filter(F.col("apart") > SETTLED).select(F.col("v").alias("node"), F.col("u").alias("least"))
    rest = write_once(shared.join(far, ["node", "least"], "left_semi").select("key", "node"), "unsettled")
    close = close.unionByName(_edges_in_keys(rest, sets))
    clusters = connected_components(close).withColumnRenamed("component", "cluster")
    members = clusters.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    links = links.unionByName(_links_in_clusters(write_once(members, "clusters"), full, percent))
    components = write_once(connected_components(links), "components")

    several = sets.filter(F.col("node") < F.col("_last")).select("set_hash", "node")
    out = join_hot(rows.drop("signature"), several, ["set_hash"], F.xxhash64("doc_id"), "left")
    out = out.withColumn("node", F.coalesce("node", "doc_id"))
    out = join_hot(out, components, ["node"], F.xxhash64("doc_id"), "left")
    component = F.coalesce("component", "node")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
