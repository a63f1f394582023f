"""One request at a time: its filters are literals, so they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.functions.facets import facet_predicate
from facetrank.functions.vectors import l2_distance_to
from facetrank.operators.products import count_products, one_per_product, with_article_columns
from facetrank.schema import DEFAULT_LIMIT, RESULT_COLUMNS, Filters, check_limit

FACET_RESULT = ("article_id", *RESULT_COLUMNS, "variantes")
RANKED_RESULT = (*FACET_RESULT, "distancia")


def _described(top: DataFrame, articles: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of one top-k with their descriptive columns, in order.

    The top-k (rows of numbers, as many as the checked limit) is computed here and now, so that the scan of the
    wide columns gets the article ids as literals and skips the row groups that hold none of them.
    """
    winners = top.collect()
    small = top.sparkSession.createDataFrame(winners, top.schema)
    wanted = articles.filter(F.col("article_id").isin([w["article_id"] for w in winners]))
    rows = with_article_columns(small, wanted, small=True).select(*columns)
    return rows.orderBy(*order)


def facet_search(catalog: DataFrame, filters: Filters, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Products that pass the filters, by product code. The semantic text plays no part."""
    survivors = catalog.filter(facet_predicate(filters))
    top = one_per_product(survivors).orderBy("product_code").limit(check_limit(limit))
    return _described(top, survivors, FACET_RESULT, ["product_code"])


def facet_count(catalog: DataFrame, filters: Filters) -> DataFrame:
    """Number of distinct products that pass the filters."""
    return count_products(catalog.filter(facet_predicate(filters)))


def hybrid_search(
    catalog: DataFrame,
    vectors: DataFrame,
    filters: Filters,
    query_vec: Sequence[float],
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Filter, collapse to products, then rank only the survivors by distance.

    Products without a vector drop out. Ties go to the lower product code.
    """
    survivors = catalog.filter(facet_predicate(filters))
    ranked = one_per_product(survivors).join(vectors, "product_code").select(
        "product_code", "article_id", "variantes", l2_distance_to("embedding", query_vec).alias("distancia")
    )
    top = ranked.orderBy("distancia", "product_code").limit(check_limit(limit))
    return _described(top, survivors, RANKED_RESULT, ["distancia", "product_code"])


def nearest_products(
    catalog: DataFrame, vectors: DataFrame, query_vec: Sequence[float], limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """The nearest products of the whole index, without filters; `variantes` counts all variants.

    The neighbours are picked from the vectors alone. One that has no article is not replaced.
    """
    neighbours = (
        vectors.select("product_code", l2_distance_to("embedding", query_vec).alias("distancia"))
        .orderBy("distancia", "product_code")
        .limit(check_limit(limit))
    )
    found = neighbours.collect()
    nearest = catalog.sparkSession.createDataFrame(found, neighbours.schema)
    articles = catalog.filter(F.col("product_code").isin([n["product_code"] for n in found]))
    picked = one_per_product(articles).join(F.broadcast(nearest), "product_code")
    return _described(picked, articles, RANKED_RESULT, ["distancia", "product_code"])
