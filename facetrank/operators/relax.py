"""Relaxation of requests whose filters match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.functions.facets import is_set
from facetrank.operators.facet_keys import lowest_level, matching_keys, request_levels, variant_groups
from facetrank.schema import FILTER_SCHEMA, FILTER_FIELDS, RELAX_ORDER
from facetrank.shared import by_shuffle


def relaxed_keys(requests: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, level, key, n): facet keys that each request ends up with after relaxation."""
    return lowest_level(matching_keys(request_levels(requests), groups))


def apply_relaxation(requests: DataFrame, matches: DataFrame) -> DataFrame:
    """Add `filtros_relajados` and one `aplicado_<field>` column per filter field.

    A request that matches nothing at any level loses every facet that can be relaxed. Excluded
    colours stay in force.
    """
    levels = matches.select("query_id", "level").distinct()
    level = F.coalesce(F.col("level"), F.lit(len(RELAX_ORDER)))
    dropped = {f: is_set(f) & (level > i) for i, f in enumerate(RELAX_ORDER)}
    names = F.array_compact(F.array(*[F.when(dropped[f], F.lit(f)) for f in RELAX_ORDER]))

    def applied(name: str) -> Column:
        empty = F.array() if name == "colores" else F.lit(None)
        col = F.col(name)
        if name in dropped:
            col = F.when(dropped[name], empty.cast(FILTER_SCHEMA[name].dataType)).otherwise(col)
        return col.alias(f"aplicado_{name}")

    return requests.join(by_shuffle(levels), "query_id", "left").select(
        *requests.columns, names.alias("filtros_relajados"), *[applied(f) for f in FILTER_FIELDS]
    )


def relax(requests: DataFrame, articles: DataFrame) -> DataFrame:
    """Drop filters, in the fixed order, from each request until it matches an article.

    Whether a product has a vector plays no part. All levels of all requests are looked up in one
    join, instead of counting again after every dropped filter.
    """
    return apply_relaxation(requests, relaxed_keys(requests, variant_groups(articles)))
