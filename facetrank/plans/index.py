"""Building and extending the vector index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from facetrank.functions.text import product_text
from facetrank.operators.products import one_per_product
from facetrank.shared import path_exists, released_shuffles, write_once
from facetrank.sources.tables import check_vectors, read_vectors

#: Places of the hash that deals products to commits.
_PLACES = 1 << 32


def pending_products(catalog: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """(product_code, article_id): representative of each product that has no vector yet."""
    products = one_per_product(catalog).select("product_code", "article_id")
    if vectors is None:
        return products
    return products.join(vectors.select("product_code"), "product_code", "left_anti")


def product_texts(catalog: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(product_code, texto) of the pending products, from their lowest article.

    For a whole build, texts are reduced to one per product on the map side, in a single scan. For an
    extension, only ids are shuffled to find what is pending; its texts are then read in a join on the
    article key, a broadcast of ids when few products are pending.
    """
    texts = catalog.select("article_id", "product_code", product_text().alias("texto"))
    if vectors is None:
        return texts.groupBy("product_code").agg(F.min_by("texto", "article_id").alias("texto"))
    pending = pending_products(catalog, vectors).select("article_id")
    return texts.join(pending, "article_id").select("product_code", "texto")


def embed_products(catalog: DataFrame, vectors: DataFrame | None, encoder) -> DataFrame:
    """(product_code, embedding) of the pending products."""
    encoded = encoder(product_texts(catalog, vectors), "texto")
    return check_vectors(encoded.select("product_code", "embedding"), encoder.dim)


def embed_requests(requests: DataFrame, encoder) -> DataFrame:
    """Add `query_vec`, the vector of `consulta_semantica`."""
    return encoder(requests, "consulta_semantica", "query_vec")


@dataclass(frozen=True)
class IndexReport:
    indexados: int
    total: int


def build_index(catalog: DataFrame, path: str, encoder) -> IndexReport:
    """Compute every product's vector and write them to a new path.

    A path that exists is refused, so the index in use stays whole if the build fails.
    """
    return _write(embed_products(catalog, None, encoder), path, encoder.model_id, "errorifexists")


def extend_index(catalog: DataFrame, path: str, encoder) -> IndexReport:
    """Add the vectors of products that have none. Running it again adds nothing.

    An interrupted run can simply be repeated: products that got their vector are skipped.
    """
    stored = read_vectors(catalog.sparkSession, path, encoder.model_id)
    return _write(embed_products(catalog, stored, encoder), path, encoder.model_id, "append")


def build_index_in_commits(catalog: DataFrame, path: str, encoder, products_per_commit: int = 1_000_000) -> IndexReport:
    """Add the vectors of all products that have none, with a commit for each `products_per_commit` of them, about.

    `path` may be new, or hold the commits of a run that was lost: these vectors are kept and not computed again, so at most one
    commit's work is lost. The pending texts are stored once, ranged by a hash of the product; a commit reads its range of it.
    """
    spark = catalog.sparkSession
    started = path_exists(spark, path)
    stored = read_vectors(spark, path, encoder.model_id) if started else None
    place = F.pmod(F.xxhash64(F.lit("commit"), "product_code"), F.lit(_PLACES)).alias("place")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = Observation()
    texts = product_texts(catalog, stored).select("*", place)
    # Places are spread evenly, so equal ranges need no sample.
    texts = texts.repartitionById(tasks, F.floor(F.col("place") * tasks / _PLACES).cast("int")).sortWithinPartitions("place")
    texts = write_once(texts.observe(counted, F.count(F.lit(1)).alias("n")), "pending-texts")
    pending = counted.get["n"]
    commits = max(1, -(-pending // products_per_commit))
    bounds = [k * _PLACES // commits for k in range(commits + 1)]
    for low, high in zip(bounds, bounds[1:]):
        part = texts.filter((F.col("place") >= low) & (F.col("place") < high))
        encoded = encoder(part.select("product_code", "texto").repartition("product_code"), "texto")
        _append(check_vectors(encoded.select("product_code", "embedding"), encoder.dim), path, encoder.model_id, "append")
    return IndexReport(pending, read_vectors(spark, path, encoder.model_id).count())


def _write(new: DataFrame, path: str, model_id: str, mode: str) -> IndexReport:
    written = Observation()
    _append(new.observe(written, F.count(F.lit(1)).alias("n")), path, model_id, mode)
    total = read_vectors(new.sparkSession, path, model_id).count()
    return IndexReport(written.get["n"], total)


def _append(new: DataFrame, path: str, model_id: str, mode: str) -> None:
    with released_shuffles(new.sparkSession):
        new.withColumn("model_id", F.lit(model_id)).write.mode(mode).partitionBy("model_id").parquet(path)
