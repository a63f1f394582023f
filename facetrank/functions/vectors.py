"""Vector expressions on array columns, computed in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrank.functions.arrays import partial_sums

# Floors that keep empty masks and zero vectors from dividing by zero.
MIN_MASK_SUM = 1e-9
MIN_NORM = 1e-12

#: Dimensions up to which a distance is written out term by term; longer expressions outgrow a compiled method.
UNROLLED = 128


def _sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vec: Column) -> Column:
    return F.sqrt(_sum(F.transform(vec, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(vec: Column) -> Column:
    """v / max(|v|, 1e-12): a zero vector stays zero."""
    norm = F.greatest(l2_norm(vec), F.lit(MIN_NORM))
    return F.transform(vec, lambda x: x.cast("double") / norm)


def l2_distance(a: Column, b: Column) -> Column:
    """Distance of two vector columns; different lengths are an error."""
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(squares))).otherwise(
        F.raise_error(F.lit("vectors of different length"))
    )


def l2_distance_to(vec: str, query: Sequence[float]) -> Column:
    """Distance of a vector column to a fixed vector; another length is an error.

    Squares are added from left to right, as in the batch ranking, so one request and the same request in a table
    give equal bits and one order. Up to UNROLLED dimensions the sum is one generated expression.
    """
    values = [float(x) for x in query]
    if not values or not all(map(math.isfinite, values)):
        raise ValueError("a query vector needs finite numbers")
    numbers = [f"({x!r}D)" for x in values]
    if len(values) <= UNROLLED:
        terms = [f"(double(`{vec}`[{i}]) - {x})" for i, x in enumerate(numbers)]
        total = " + ".join(f"{t} * {t}" for t in terms)
    else:
        total = (f"aggregate(zip_with(`{vec}`, array({', '.join(numbers)}), (x, q) -> (double(x) - q) * (double(x) - q)), "
                 "0D, (total, x) -> total + x)")
    return F.expr(f"CASE WHEN size(`{vec}`) = {len(values)} THEN sqrt({total}) "
                  "ELSE raise_error('vectors of different length') END")


def checked_vector(vec: Column, dim: int) -> Column:
    """The vector itself; any other length than `dim` (or null) fails the job."""
    return F.when(F.size(vec) == dim, vec).otherwise(
        F.raise_error(F.concat(F.lit(f"expected a vector of length {dim}, got "),
                               F.coalesce(F.size(vec).cast("string"), F.lit("null"))))
    )


def masked_mean_pool(
    tokens: DataFrame, key: str, dim: int, vec: str = "vec", mask: str = "mask"
) -> DataFrame:
    """One vector per text: sum(vec * mask) / max(sum(mask), 1e-9).

    Tokens are summed by text where they are, batch by batch, so a run of a text's tokens becomes one row before anything is shuffled;
    the rows of a text then meet in one task as a few sums a place. Memory is that of a batch, whatever the number of texts. A null mask
    counts as zero, as does a null component beside others; texts whose mask is all zero give a zero vector.
    """
    weight = F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    checked = tokens.select(F.col(key).alias("_key"), weight.alias("_weight"), checked_vector(F.col(vec), dim).alias("_vec"))
    partial = T.StructType([checked.schema["_key"], T.StructField("_sums", T.ArrayType(T.DoubleType())), T.StructField("_total", T.DoubleType())])
    summed = checked.mapInArrow(partial_sums, partial).repartition("_key")
    places = summed.select("_key", "_total", F.posexplode("_sums").alias("_place", "_x"))
    sums = places.groupBy("_key", "_place").agg(F.sum("_x").alias("_sum"), F.sum("_total").alias("_total"))
    mean = F.struct("_place", (F.col("_sum") / F.greatest("_total", F.lit(MIN_MASK_SUM))).alias("_mean"))
    pooled = sums.groupBy("_key").agg(F.array_sort(F.collect_list(mean)).alias("_means"))
    return pooled.select(F.col("_key").alias(key), F.col("_means._mean").alias(vec))
