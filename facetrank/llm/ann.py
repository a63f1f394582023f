"""Approximate nearest neighbours by inner product: cross-polytope hashing with multiprobe tables.

A unit vector, padded to a power of two D, goes through three rounds of random signs and a fast Hadamard transform
(a pseudo-rotation); its bucket is the signed axis nearest to the result, one of 2 * D. Each of `tables` tables has a
rotation of its own. A query looks into the `probes` buckets of each table whose axes are nearest to it. Norms are
taken out before hashing: vectors are kept apart by norm (each band a factor of two wide) and every query looks into
all bands, so the order by inner product follows the direction within a band up to that factor. Candidates are
ranked by the exact inner product in double precision. A query that finds fewer than `k` looks into all buckets of one table,
which is exact.

Equal vectors are one candidate with its `k` + 1 smallest ids (more can't be among the nearest). Buckets are dealt
over cells of bounded size, by candidates and by queries; a cell returns the best of each of its queries.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part; vectors of
different lengths never meet. A repeated row counts once; an id with several vectors is a candidate with each, and
as a query it gets a list for each. Ties go to smaller ids. Other columns are not read. Empty tables
give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.llm.common import map_batches
from facetrank.shared import write_once

TABLES = 8
PROBES = 14
ALL_BUCKETS = 1 << 31
#: Vectors of a cell, and queries of a cell, at about 1 KB each.
CELL = 32_768
CELL_QUERIES = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, kept at its length."""
    rows, size = x.shape
    half = 1
    while half < size:
        x = x.reshape(rows, -1, 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2)
        half *= 2
    return x.reshape(rows, size) / np.sqrt(size)


def rotated(unit: np.ndarray, table: int, seed: int) -> np.ndarray:
    size = 1 << max(1, (unit.shape[1] - 1).bit_length())
    rng = np.random.default_rng((seed, table, size))
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size))
    return x


def nearest_axes(unit: np.ndarray, table: int, seed: int, n: int) -> np.ndarray:
    """The n signed axes nearest to each row: axis, or axis + D for its opposite."""
    x = rotated(unit, table, seed)
    both = np.concatenate([x, -x], 1)
    n = min(n, both.shape[1])
    best = np.argpartition(-both, n - 1, 1)[:, :n]
    order = np.argsort(-np.take_along_axis(both, best, 1), 1, kind="stable")
    return np.take_along_axis(best, order, 1)


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec (array of doubles), vkey, dim, band of the rows that take part."""
    vec = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    top = F.lit(float("inf"))
    whole = F.forall("vec", lambda x: F.coalesce((F.abs(x) < top) & ~F.isnan(x), F.lit(False)))
    scale = F.array_max(F.transform("vec", F.abs))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.filter(whole).withColumn("_scale", scale).filter("_scale > 0")
    norm = F.col("_scale") * F.sqrt(F.aggregate(
        F.transform("vec", lambda x: x / F.col("_scale")), F.lit(0.0), lambda a, x: a + x * x))
    return rows.select(
        "id", "vec", F.md5(F.concat_ws(",", F.col("vec").cast("array<string>"))).alias("vkey"),
        F.size("vec").alias("dim"), F.floor(F.log2(norm) + 0.5).cast("int").alias("band"),
    )


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _axes(df: DataFrame, tables: int, n: int, seed: int) -> DataFrame:
    """The columns of df (with vec) and `axes`: one array for each table."""
    names = df.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(names.index("vec"))
        out: list = [None] * len(column)
        dims = np.diff(np.asarray(column.offsets))
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            unit = _unit(np.asarray(column.take(pa.array(rows)).flatten()).reshape(len(rows), dim))
            found = np.stack([nearest_axes(unit, t, seed, n) for t in range(tables)], 1)
            for row, axes in zip(rows, found.tolist()):
                out[row] = axes
        axes = pa.array(out, pa.list_(pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays([*batch.columns, axes], [*names, "axes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return map_batches(df, run, f"{kinds}, axes array<array<int>>")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of all scores that may be among the k largest, given rounding errors of matrix products."""
    if len(scores) <= k:
        return np.flatnonzero(scores > -np.inf)
    bound = np.partition(scores, len(scores) - k)[len(scores) - k]
    return np.flatnonzero((scores >= bound - 1e-9 * abs(bound)) & (scores > -np.inf))


def _search_cell(k: int):
    def run(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qkey": [], "ckey": [], "score": []}).astype({"score": "float64"})
        if not len(found) or not len(asked):
            return empty
        found = found.sort_values(["axis", "rep", "ckey"], ignore_index=True)
        vectors, queries = np.stack(found["vec"]), np.stack(asked["vec"])
        axes, begins = np.unique(found["axis"].to_numpy(), return_index=True)
        ends = np.append(begins[1:], len(found))
        rep, keys = found["rep"].to_numpy(), found["ckey"].to_numpy()
        parts = []
        for at in range(0, len(asked), 128):
            probes = asked["probes"].iloc[at : at + 128]
            chunk = queries[at : at + 128]
            scores = np.full((len(chunk), len(found)), -np.inf)
            wanted = pd.Series(np.concatenate(list(probes)))
            by = np.repeat(np.arange(len(chunk)), [len(p) for p in probes])
            for axis, rows in wanted.groupby(wanted).indices.items():
                place = np.searchsorted(axes, axis)
                if place < len(axes) and axes[place] == axis:
                    a, b = begins[place], ends[place]
                    scores[by[rows], a:b] = chunk[by[rows]] @ vectors[a:b].T
            for i, qkey in enumerate(asked["qkey"].iloc[at : at + 128]):
                best = _best(scores[i], k)
                exact = (vectors[best] * chunk[i]).sum(1)
                order = np.lexsort((rep[best], -exact))[:k]
                parts.append(pd.DataFrame({"qkey": qkey, "ckey": keys[best[order]], "score": exact[order]}))
        return pd.concat(parts, ignore_index=True) if parts else empty

    return run


def _lists(members: DataFrame, sizes: DataFrame, queries: DataFrame, tables: int, k: int) -> DataFrame:
    """qkey, best: up to k + 1 nearest ids found in the first `tables` tables, the query's own among them."""
    # Rows of at most (lengths) x (bands) x (tables) x (axes); cells hold whole buckets as long as these are small.
    numbers = F.sequence(F.lit(0), F.lit(tables - 1))
    buckets = members.join(sizes, ["dim", "band"]).withColumn("table", F.explode(numbers))
    axis = F.col("axes")[F.col("table")][0]
    buckets = buckets.withColumn("axis", axis).withColumn("cell", F.pmod("axis", "groups"))
    place = ["dim", "band", "table", "cell"]
    grid = buckets.groupBy(place).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    looks = queries.join(sizes, "dim").withColumn("table", F.explode(numbers))
    looks = looks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    mine = F.filter(F.col("axes")[F.col("table")], lambda a: F.pmod(a, F.col("groups")) == F.col("cell"))
    looks = looks.withColumn("probes", mine).filter(F.size("probes") > 0)
    turns = looks.groupBy(place).agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("turns"))
    grid = write_once(grid.join(turns, place), "cells")

    part = F.pmod(F.xxhash64("vkey"), "parts").cast("int")
    turn = F.pmod(F.xxhash64("vkey"), "turns").cast("int")
    found = buckets.join(grid, place).select(
        *place, part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"),
        F.col("vkey").alias("ckey"), "rep", "axis", "vec",
    )
    asked = looks.join(grid, place).select(
        *place, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), turn.alias("turn"),
        F.col("vkey").alias("qkey"), "probes", "vec",
    )
    group = [*place, "part", "turn"]
    best = found.groupBy(group).cogroup(asked.groupBy(group)).applyInPandas(
        _search_cell(k + 1), "qkey string, ckey string, score double")
    # The same pair may come from several tables; its score is the same each time.
    best = best.groupBy("qkey", "ckey").agg(F.max("score").alias("score"))
    ids = members.select(F.col("vkey").alias("ckey"), "rep", "ids")
    best = best.join(ids, "ckey")
    by_rep = Window.partitionBy("qkey").orderBy(F.desc("score"), "rep", "ckey")
    best = best.withColumn("_r", F.row_number().over(by_rep)).filter(F.col("_r") <= k + 1)
    best = best.select("qkey", "score", F.explode("ids").alias("id"))
    by_id = Window.partitionBy("qkey").orderBy(F.desc("score"), "id")
    best = best.withColumn("_r", F.row_number().over(by_id)).filter(F.col("_r") <= k + 1)
    return best.groupBy("qkey").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), "id", "score"))).alias("best"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES,
            seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best found for each row where `is_query` holds.

    `is_query` is an expression of the column `id`. A query's own id is no candidate.
    """
    rows = _vectors(vectors, id_col, vector_col)
    order = F.dense_rank().over(Window.partitionBy("vkey").orderBy("id"))
    members = rows.withColumn("_r", order).filter(F.col("_r") <= k + 1).groupBy("vkey").agg(
        F.first("vec").alias("vec"), F.first("dim").alias("dim"), F.first("band").alias("band"),
        F.sort_array(F.collect_set("id")).alias("ids"),
    ).withColumn("rep", F.col("ids")[0])
    members = write_once(_axes(members, tables, 1, seed), "hashed-vectors")
    asking = rows.filter(is_query)
    queries = asking.groupBy("vkey").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    queries = write_once(_axes(queries, tables, probes, seed), "hashed-queries")

    sizes = members.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("groups"))
    sizes = write_once(sizes, "bands")
    lists = write_once(_lists(members, sizes, queries, tables, k), "nearest")
    # Queries that found too few look into all buckets.
    enough = lists.filter(F.size("best") > k).select(F.col("qkey").alias("vkey"))
    short = queries.drop("axes").join(enough, "vkey", "left_anti")
    short = write_once(_axes(short, 1, ALL_BUCKETS, seed), "short-queries")
    if not short.isEmpty():
        whole = _lists(members, sizes, short, 1, k)
        lists = lists.filter(F.size("best") > k).unionByName(whole)
    answers = asking.select("id", F.col("vkey").alias("qkey")).distinct().join(lists, "qkey")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)
    return answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("_p", "_x")).select(
        "query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.id").alias("vec_id"),
        F.col("_x.score").alias("score"),
    )
