"""Nearest products through buckets of vectors: fewer vectors are read, exactly or nearly. Off unless it is called."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.functions.vectors import l2_distance, l2_distance_to
from facetrank.plans.search import nearest_products
from facetrank.schema import DEFAULT_LIMIT, check_limit
from facetrank.shared import write_once

#: Rows that the centers are fitted on, about; and most centers. These rows reach the driver when an index is opened.
SAMPLE_ROWS = 200_000
MOST_BUCKETS = 4096
#: Part of all vectors that a near search reads, at least.
SHARE = 0.1


@dataclass(frozen=True)
class Buckets:
    """`vectors` (bucket, product_code, embedding), and for each bucket its center, radius and number of vectors."""

    vectors: DataFrame
    numbers: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def _distances(self, query_vec: Sequence[float]) -> np.ndarray:
        return np.linalg.norm(self.centers - np.asarray(query_vec, float), axis=1)

    def nearest(self, query_vec: Sequence[float], share: float, limit: int) -> list[int]:
        """The buckets of the nearest centers that together hold the share of all vectors, and `limit` vectors."""
        order = np.lexsort((self.numbers, self._distances(query_vec)))
        held = np.cumsum(self.sizes[order])
        wanted = min(max(math.ceil(share * held[-1]), limit), held[-1])
        return self.numbers[order[: int(np.searchsorted(held, wanted)) + 1]].tolist()

    def within(self, query_vec: Sequence[float], distance: float) -> list[int]:
        """All buckets that can hold a vector at this distance or nearer, by the triangle inequality."""
        far = self._distances(query_vec)
        margin = 1e-9 * (far + self.radii + distance + 1.0)
        return self.numbers[far - self.radii <= distance + margin].tolist()

    def share_of(self, numbers: Sequence[int]) -> float:
        """Part of all vectors that these buckets hold."""
        return float(self.sizes[np.isin(self.numbers, numbers)].sum() / self.sizes.sum())

    def read(self, numbers: Sequence[int]) -> DataFrame:
        """The vectors of some buckets. They lie together in the files, so the others' row groups are skipped."""
        return self.vectors.filter(F.col("bucket").isin(list(numbers))).select("product_code", "embedding")


def build_buckets(vectors: DataFrame, path: str, buckets: int = 0, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> Buckets:
    """Deal all vectors to the nearest of `buckets` centers and store them by bucket under a new path.

    Centers are fitted on a sample of about `sample_rows` products, chosen by a hash; all vectors are dealt. Without a number there are as many
    buckets as the root of the number of vectors, `MOST_BUCKETS` at most. A bucket that holds much of the index is split
    over tasks and files. Vectors must be finite and of one length; an empty table is refused.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    if n == 0:
        raise ValueError("there are no vectors to deal to buckets")
    k = min(buckets or max(2, math.isqrt(n)), MOST_BUCKETS)
    as_points = vectors.select("product_code", "embedding", array_to_vector("embedding").alias("point"))
    chosen = as_points.filter(F.pmod(F.xxhash64(F.lit(seed), "product_code"), F.lit(n)) < sample_rows)
    learned = KMeans(k=k, featuresCol="point", predictionCol="bucket", seed=seed, maxIter=10).fit(
        as_points if chosen.isEmpty() else chosen)
    dealt = learned.transform(as_points).select("bucket", "product_code", "embedding")
    stored = dealt.repartitionByRange("bucket", "product_code").sortWithinPartitions("bucket", "product_code")
    stored.write.parquet(f"{path}/vectors")
    rows = [(i, [float(x) for x in center]) for i, center in enumerate(learned.clusterCenters())]
    centers = write_once(spark.createDataFrame(rows, "bucket int, center array<double>"), "centers")
    # One row a bucket, `MOST_BUCKETS` at most.
    placed = spark.read.parquet(f"{path}/vectors").join(F.broadcast(centers), "bucket")
    figures = placed.groupBy("bucket").agg(
        F.max(l2_distance(F.col("embedding"), F.col("center"))).alias("radius"), F.count(F.lit(1)).alias("n"))
    figures.join(centers, "bucket").write.parquet(f"{path}/centers")
    return open_buckets(spark, path)


def open_buckets(spark: SparkSession, path: str) -> Buckets:
    rows = spark.read.parquet(f"{path}/centers").orderBy("bucket").collect()
    columns = [np.array([r[name] for r in rows]) for name in ("bucket", "center", "radius", "n")]
    return Buckets(spark.read.parquet(f"{path}/vectors"), *columns)


def nearest_by_buckets(
    catalog: DataFrame, buckets: Buckets, query_vec: Sequence[float], limit: int = DEFAULT_LIMIT,
    share: float = SHARE, exact: bool = True,
) -> DataFrame:
    """`nearest_products` from some buckets. Distances and their order are always exact.

    The buckets nearest to the request are read first. If the answer has to be exact, the farthest distance found there tells
    which other buckets can hold a nearer product, and those are read too; else a product of another bucket can be missed.
    """
    limit = check_limit(limit)
    numbers = buckets.nearest(query_vec, share, limit)
    if exact:
        found = buckets.read(numbers).select(l2_distance_to("embedding", query_vec).alias("d")).orderBy("d").limit(limit).collect()
        numbers = sorted({*numbers, *buckets.within(query_vec, found[-1]["d"])})
    return nearest_products(catalog, buckets.read(numbers), query_vec, limit)
