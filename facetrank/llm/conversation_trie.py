"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Peeling goes down from the greatest depth: the conversations that end at a
depth join the nodes that survive there, equal sequences are merged to one node, and each node loses its last turn
and meets its siblings at the next depth. Nodes are found and aggregated (members, children, leaves, saved tokens) in that one
pass, one shuffle a depth. A turn is a 128-bit digest of role and text; a sequence is the chain of digests over its
turns, so texts are read once and never shuffled. Equal conversations are merged before peeling starts.

A conversation that meets nobody below some depth is stripped of all those turns at once (`lone_tails`): the number of
rounds follows from the depth down to which conversations share their turns (and up to BAND more), not from the longest one.

Rows with a null conv_id take no part. Turns are ordered by `turn` (null first); turns of one number by the digest of
role and text. Null role or text is empty. Repeated rows are turns of their own. An empty table has no nodes, not even a
root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.llm.common import join_counted
from facetrank.shared import scratch_path, write_once

#: Turns between two depths at which long conversations are tested for company.
BAND = 16
#: Ids that are written as one text.
IDS = 50_000
_WIDTH = 16
_EMPTY = hashlib.sha256(b"").digest()

SEQUENCES = "conv_id long, depth int, key binary, chain binary, chars array<long>"
_ENDED = "key binary, depth int, chain binary, chars array<long>, conv_id long, n long, ends binary"
_TAILS = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (digest, chars), one row for each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"], t["chars"])).alias("turns"))


def with_shared_heads(turns: DataFrame, group: int, head: Column, longest: int) -> DataFrame:
    """Replace the first `head` turns of a conversation by those of conversation conv_id - conv_id % group.

    `head` is at most `longest`; an absent conversation has no turns to give. The remainder of a negative conv_id is
    negative, as in SQL.
    """
    base = turns.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base_id"), F.slice("turns", 1, longest).alias("base"))
    joined = turns.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % group).join(base, "base_id", "left")
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", head + 1, F.size("turns") + 1)
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("base", F.lit(1), head), none), own).alias("turns"))


def sequences(turns: DataFrame) -> DataFrame:
    """See SEQUENCES: `chain` holds the key of each prefix, `key` the last of them (empty without turns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depths, keys, chains = [], [], []
            for digests in batch.column(1).to_pylist():
                key, chain = b"", []
                for digest in digests:
                    key = hashlib.md5(key + digest).digest()
                    chain.append(key)
                depths.append(len(chain))
                keys.append(key)
                chains.append(b"".join(chain))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(depths, pa.int32()), pa.array(keys, pa.binary()), pa.array(chains, pa.binary()),
                 batch.column(2)], ["conv_id", "depth", "key", "chain", "chars"])

    return turns.select("conv_id", F.col("turns.digest").alias("d"), F.col("turns.chars").alias("c")).mapInArrow(run, SEQUENCES)


def _runs(rows: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[bytes, pa.RecordBatch]]:
    """Slices of equal `name`, in the order of rows that are sorted by it; one value may come in several slices."""
    for batch in rows:
        values = batch.column(batch.schema.get_field_index(name)).to_pylist()
        first = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[first]:
                yield values[first], batch.slice(first, i - first)
                first = i


def ended(found: DataFrame) -> DataFrame:
    """See _ENDED: equal conversations as one row, with the number, the least id and the digest of their ids in order.

    The members of one sequence are dealt by range of id, so a conversation that a large part of the table repeats is
    written as texts of ids by many tasks; the digest then reads these texts one after the other.
    """

    def as_texts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run in _runs(rows, "key"):
            for at in range(0, len(run), IDS):
                part = run.slice(at, IDS)
                ids = part.column(0).to_pylist()
                one = part.slice(0, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column(2), one.column(1), one.column(3), one.column(4), one.column(0),
                     pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids)).encode()], pa.binary())],
                    ["key", "depth", "chain", "chars", "conv_id", "n", "ends"])

    def digested(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[held.column(i) for i in range(5)], pa.array([n], pa.int64()), pa.array([sha.digest()], pa.binary())],
                held.schema.names)

        held, n, sha = None, 0, None
        for key, run in _runs(rows, "key"):
            if held is None or held.column(0)[0].as_py() != key:
                if held is not None:
                    yield out()
                held, n, sha = run.slice(0, 1), 0, hashlib.sha256()
            for count, ids in zip(run.column(5).to_pylist(), run.column(6).to_pylist()):
                sha.update(b"," + ids if n else ids)
                n += count
        if held is not None:
            yield out()

    texts = found.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(as_texts, _ENDED)
    return texts.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(digested, _ENDED)


def key_at(depth: Column) -> Column:
    """The key of a sequence's first `depth` turns (empty: of none)."""
    return F.when(depth > 0, F.expr("chain").substr((depth - 1) * _WIDTH + 1, F.lit(_WIDTH))).otherwise(F.lit(b""))


def lone_tails(rows: DataFrame) -> DataFrame:
    """rows of `ended`, with `last`: from depth last + 1 on the nodes of a row are its own alone (depth, if that is not known)."""
    depths = F.sequence(F.lit(BAND), F.col("depth"), F.lit(BAND))
    long = rows.filter(F.col("depth") >= BAND).select("key", "chain", F.explode(depths).alias("at"))
    entered = long.select("key", "at", key_at(F.col("at")).alias("prefix"))
    alone = entered.groupBy("prefix").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("at"), F.first("key").alias("key"))
    first = alone.filter("_n = 1").groupBy("key").agg(F.min("at").alias("last"))
    return rows.join(first, "key", "left").withColumn("last", F.coalesce("last", "depth"))


def _tail_nodes(rows: DataFrame) -> DataFrame:
    """See _TAILS: the nodes below `last` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, depth = row["last"] + 1, row["depth"]
                size = depth - first + 1
                chars = np.array(row["chars"][first - 1 :], np.int64) * (row["n"] - 1)
                children = np.ones(size, np.int64)
                children[-1] = 0
                columns = [np.full(size, row["conv_id"]), np.arange(first, depth + 1), np.full(size, row["n"]), children,
                           np.ones(size, np.int64), np.cumsum(chars[::-1])[::-1]]
                ends = [_EMPTY] * (size - 1) + [row["ends"]]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in columns], pa.array(ends, pa.binary())],
                    [f.split()[0] for f in _TAILS.split(", ")])

    return rows.filter("last < depth").mapInArrow(run, _TAILS)


def _peeled(rows: DataFrame, folder: str) -> DataFrame:
    """All nodes from the depths `last` up to the root; one written table a depth."""
    spark = rows.sparkSession
    below = F.col("last") < F.col("depth")
    taken = F.aggregate(F.slice("chars", F.col("last") + 1, F.size("chars") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    entering = rows.select(
        F.col("last").alias("depth"), key_at(F.col("last")).alias("key"),
        F.expr("chain").substr(F.lit(1), F.col("last") * _WIDTH).alias("chain"),
        F.slice("chars", F.lit(1), F.col("last")).alias("chars"), "conv_id", "n", below.cast("long").alias("children"),
        below.cast("long").alias("leaves"), F.when(below, taken * (F.col("n") - 1)).otherwise(0).alias("saved"),
        F.when(~below, F.col("ends")).alias("ends"),
    )
    start = write_once(entering, "conversation-ends")
    deepest = start.agg(F.max("depth")).first()[0]
    if deepest is None:
        deepest = -1
    survivors = None
    for depth in range(deepest, -1, -1):
        here = start.filter(F.col("depth") == depth).drop("depth")
        if survivors is not None:
            here = here.unionByName(survivors)
        merged = here.groupBy("key").agg(
            F.first("chain").alias("chain"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
            F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
        chars = F.element_at("chars", depth) if depth else F.lit(0)
        nodes = merged.withColumn("saved", F.col("saved") + (F.col("n") - 1) * chars).withColumn(
            "leaves", F.greatest("leaves", F.lit(1))).withColumn("depth", F.lit(depth))
        path = f"{folder}/{depth}"
        nodes.write.parquet(path)
        up = spark.read.schema(nodes.schema).parquet(path)
        survivors = up.select(
            key_at(F.lit(depth - 1)).alias("key"), F.expr("chain").substr(1, (depth - 1) * _WIDTH).alias("chain"),
            F.slice("chars", 1, max(depth - 1, 0)).alias("chars"), "conv_id", "n", F.lit(1).cast("long").alias("children"),
            "leaves", "saved", F.lit(None).cast("binary").alias("ends"))
    schema = ("key binary, chain binary, chars array<long>, conv_id long, n long, children long, leaves long, saved long, "
              "ends binary, depth int")
    if deepest < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def prefix_trie(found: DataFrame) -> DataFrame:
    """Nodes of the trie of `sequences`: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends."""
    spark = found.sparkSession
    rows = write_once(lone_tails(write_once(ended(write_once(found, "sequences")), "ended")), "tails")
    nodes = _peeled(rows, scratch_path(spark, "trie"))
    up = key_at(F.col("depth") - 1)
    children = nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 0, up).alias("key"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends"))
    parents = nodes.filter("children > 0").select("key", F.col("conv_id").alias("parent_conv_id"), F.col("children").alias("_rows"))
    joined = join_counted(children, parents, "key", "_rows", F.xxhash64("conv_id"))
    tails = _tail_nodes(rows).withColumn("parent_conv_id", F.col("conv_id"))
    return joined.select(tails.columns).unionByName(tails).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
