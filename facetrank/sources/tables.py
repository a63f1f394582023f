"""Parquet tables of the search: catalog, vectors, and what must hold for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrank.functions.vectors import checked_vector
from facetrank.schema import CATALOG_COLUMNS, CATALOG_SCHEMA, VECTOR_SCHEMA

REQUIRED = ("article_id", "product_code", "prod_name")


class DuplicateKey(ValueError):
    """A key that must be unique occurs more than once."""


def check_catalog(df: DataFrame) -> DataFrame:
    """The catalog columns with their types; a null in a required column fails the job."""
    def checked(name: str):
        col = F.col(name).cast(CATALOG_SCHEMA[name].dataType)
        if name not in REQUIRED:
            return col.alias(name)
        return F.coalesce(col, F.raise_error(F.lit(f"{name} must not be null"))).alias(name)

    return df.select(*[checked(c) for c in CATALOG_COLUMNS])


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once. Reads the key column only."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def refuse_repeated(df: DataFrame, key: str) -> None:
    example = repeated_keys(df, key).head(1)
    if example:
        raise DuplicateKey(f"{key} {example[0][key]} occurs {example[0]['n']} times")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).parquet(path)


def _with_key_blooms(writer, *keys: str):
    """Bloom filters per row group, so a scan for given keys skips the row groups without them."""
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    return writer


def write_catalog(df: DataFrame, path: str) -> None:
    """Write a new version of the catalog; an existing path is refused, so a failed write costs nothing.

    So is an article_id that occurs twice.

    Rows are ranged by the two coarsest facets: their filters then skip whole files by statistics.
    The unique id as last sort key lets Spark split a facet value that holds much of the catalog.
    """
    refuse_repeated(df, "article_id")
    ranged = (
        check_catalog(df)
        .repartitionByRange("index_group_name", "product_group_name", "article_id")
        .sortWithinPartitions("index_group_name", "product_group_name", "article_id")
    )
    _with_key_blooms(ranged.write, "article_id", "product_code").mode("errorifexists").parquet(path)


def save_catalog_table(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Save a new version of the catalog as a table bucketed by article.

    For upserts and for batches whose results outgrow a broadcast: both join on the article key, and
    the wide rows of a bucketed table stay where they are. Within a bucket, rows are sorted by facet.
    """
    refuse_repeated(df, "article_id")
    writer = check_catalog(df).repartition(buckets, "article_id").write
    writer = writer.bucketBy(buckets, "article_id").sortBy("index_group_name", "product_group_name")
    writer = _with_key_blooms(writer, "article_id", "product_code").mode("errorifexists")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def check_vectors(df: DataFrame, dim: int) -> DataFrame:
    """(product_code, embedding) as stored; a vector of another length fails the job."""
    return df.select(
        F.col("product_code").cast("long").alias("product_code"),
        checked_vector(F.col("embedding").cast("array<float>"), dim).alias("embedding"),
    )


def write_vectors(df: DataFrame, path: str, dim: int, model_id: str) -> None:
    """Write a new index under `path`, tagged with the model that made the vectors."""
    refuse_repeated(df, "product_code")
    _tagged(df, dim, model_id).write.mode("errorifexists").partitionBy("model_id").parquet(path)


def append_vectors(df: DataFrame, path: str, dim: int, model_id: str) -> None:
    """Add vectors of new products; a product that has a vector already is refused."""
    refuse_repeated(df, "product_code")
    stored = read_vectors(df.sparkSession, path, model_id)
    clash = df.join(stored, "product_code", "left_semi").select("product_code").head(1)
    if clash:
        raise DuplicateKey(f"product_code {clash[0][0]} has a vector already")
    _tagged(df, dim, model_id).write.mode("append").partitionBy("model_id").parquet(path)


def _tagged(df: DataFrame, dim: int, model_id: str) -> DataFrame:
    return check_vectors(df, dim).withColumn("model_id", F.lit(model_id))


def read_vectors(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    """The vectors of an index, which must all come from `model_id`: two models share no space."""
    tagged = T.StructType([*VECTOR_SCHEMA, T.StructField("model_id", T.StringType())])
    stored = spark.read.schema(tagged).parquet(path)
    others = stored.filter(F.col("model_id") != model_id).select("model_id").head(1)
    if others:
        raise ValueError(f"the index holds vectors of {others[0][0]}, not of {model_id}")
    return stored.drop("model_id")


def ready(catalog: DataFrame, vectors: DataFrame) -> bool:
    """Whether both tables have rows."""
    return not catalog.isEmpty() and not vectors.isEmpty()
