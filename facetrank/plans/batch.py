"""Whole tables of requests at once.

A request is a row of (query_id, frase, publico, categoria, colores, colores_excluidos, tono,
estampado, consulta_semantica, query_vec, limite); facet-only requests need no frase and no query_vec.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions.facets import bad_facet_values
from facetrank.operators.facet_keys import (
    KEY, candidates, matching_keys, number_keys, request_levels, variant_groups,
)
from facetrank.operators.products import with_article_columns
from facetrank.operators.ranking import keep_top, rank_candidates
from facetrank.operators.relax import apply_relaxation, relaxed_keys
from facetrank.operators.versions import checked_groups
from facetrank.plans.search import FACET_RESULT, RANKED_RESULT
from facetrank.schema import DEFAULT_LIMIT, MAX_LIMIT, Vocabulary
from facetrank.shared import write_once
from facetrank.sources.tables import refuse_repeated


def rejected_requests(requests: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(query_id, campo, valor) for every value outside the vocabulary and every limit out of bounds."""
    limit = F.struct(F.lit("limite").alias("campo"), F.col("limite").cast("string").alias("valor"))
    bad_limit = F.when(_limit_in_bounds(), F.array().cast("array<struct<campo:string,valor:string>>"))
    reasons = F.concat(bad_facet_values(vocab), bad_limit.otherwise(F.array(limit)))
    return requests.select("query_id", F.inline(reasons))


def accepted_requests(requests: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The requests that `rejected_requests` does not list. Decided row by row, without a join."""
    return requests.filter(_limit_in_bounds() & (F.size(bad_facet_values(vocab)) == 0))


def _limit_in_bounds():
    return F.coalesce(F.col("limite"), F.lit(DEFAULT_LIMIT)).between(1, MAX_LIMIT)


def _with_limit(requests: DataFrame) -> DataFrame:
    limit = F.coalesce(F.col("limite"), F.lit(DEFAULT_LIMIT)) if "limite" in requests.columns else (
        F.lit(DEFAULT_LIMIT)
    )
    refused = F.raise_error(F.lit(f"limite must be between 1 and {MAX_LIMIT}"))
    return requests.withColumn("limite", F.when(limit.between(1, MAX_LIMIT), limit).otherwise(refused))


def _checked(requests: DataFrame, with_vectors: bool) -> DataFrame:
    """The requests, computed and written once; limits, repeated ids and bad vectors are refused here and now."""
    requests = write_once(_with_limit(requests), "requests")
    refuse_repeated(requests, "query_id")
    if with_vectors:
        infinite = F.exists("query_vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        bad = requests.filter(F.col("query_vec").isNull() | (F.size("query_vec") == 0) | infinite).head(1)
        if bad:
            raise ValueError(f"request {bad[0]['query_id']} has no query_vec of finite numbers")
    return requests


@dataclass(frozen=True)
class Answers:
    """`requests` with what was relaxed and applied, and `results` with the ranked rows."""

    requests: DataFrame
    results: DataFrame


def search_batch(
    catalog: DataFrame, vectors: DataFrame, requests: DataFrame, groups: DataFrame | None = None
) -> Answers:
    """Relax, filter, collapse and rank every request of the table.

    `groups` is `tagged_groups(catalog)` if it is stored already; groups of another version are refused (`StaleGroups`). The catalog's facet columns are
    read once, its wide columns only for the winners. A repeated query_id, a limit out of bounds and a query_vec that is
    null, empty or not finite are errors.
    """
    requests = _checked(requests, with_vectors=True)
    groups = write_once(variant_groups(catalog), "groups") if groups is None else checked_groups(groups, catalog)
    matches = write_once(relaxed_keys(requests, groups), "matches")
    keys = number_keys(matches)
    asking = matches.join(keys.select("key_id", *KEY), KEY).select("query_id", "key_id")
    ranked = rank_candidates(candidates(groups, keys), vectors, asking, requests)
    return Answers(
        apply_relaxation(requests, matches),
        with_article_columns(ranked, catalog, small=False).select("query_id", "rank", *RANKED_RESULT),
    )


def facet_search_batch(
    catalog: DataFrame, requests: DataFrame, groups: DataFrame | None = None
) -> DataFrame:
    """`facet_search` for a table of requests: (query_id, rank, ...) by product code.

    Requests with the same facet key share its first products, so each key is cut to `MAX_LIMIT` rows
    before it meets its requests. Nothing is relaxed. A repeated query_id, a limit out of bounds and
    `groups` of another version of the catalog are errors.
    """
    requests = _checked(requests, with_vectors=False)
    groups = write_once(variant_groups(catalog), "groups") if groups is None else checked_groups(groups, catalog)
    matches = write_once(matching_keys(request_levels(requests, relax=False), groups), "matches")
    keys = number_keys(matches)
    by_key = Window.partitionBy("key_id").orderBy("product_code")
    first = (
        candidates(groups, keys)
        .withColumn("_position", F.row_number().over(by_key))
        .filter(F.col("_position") <= MAX_LIMIT)
    )
    merged = (
        matches.join(keys.select("key_id", *KEY), KEY)
        .select("query_id", "key_id")
        .join(first, "key_id")
        .groupBy("query_id", "product_code")
        .agg(F.min("article_id").alias("article_id"), F.sum("variantes").alias("variantes"))
    )
    ranked = keep_top(merged, requests.select("query_id", "limite"), ["product_code"])
    return with_article_columns(ranked, catalog, small=False).select("query_id", "rank", *FACET_RESULT)
