"""From articles (colour variants) to products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.schema import RESULT_COLUMNS


def one_per_product(articles: DataFrame) -> DataFrame:
    """(product_code, article_id, variantes): the lowest article stands for its product.

    `articles` are the survivors of the filters, so `variantes` counts survivors. Only two long
    columns are shuffled, after a map-side combine, whatever the number of variants.
    """
    return articles.groupBy("product_code").agg(
        F.min("article_id").alias("article_id"), F.count("*").alias("variantes")
    )


def count_products(articles: DataFrame) -> DataFrame:
    return articles.agg(F.countDistinct("product_code").alias("productos"))


def with_article_columns(picked: DataFrame, articles: DataFrame, small: bool) -> DataFrame:
    """Add the descriptive columns of each picked article.

    Wide columns are read only here, for the rows that made it into the answer. `small` promises
    that `picked` is a single top-k (at most `MAX_LIMIT` rows); otherwise Spark picks the join by size.
    """
    wide = articles.select("article_id", *RESULT_COLUMNS)
    narrow = picked.drop(*RESULT_COLUMNS)
    return wide.join(F.broadcast(narrow) if small else narrow, "article_id")
