"""Matching many requests with a catalog by equality on facet keys.

A request asks for some facets and leaves the others open. A *facet key* is one such choice: which
facets are asked for (`mask`) and their values, with an empty string for the open ones. An article
carries one key per mask, 32 in all, so "request matches article" becomes an equi-join on the
key and no request is compared with articles that it does not match.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions.facets import is_set, list_or_empty
from facetrank.schema import FACET_COLUMN, RELAX_ORDER
from facetrank.shared import by_shuffle, write_once

FACETS = [FACET_COLUMN[f] for f in RELAX_ORDER]

_BIT = {f: 1 << i for i, f in enumerate(RELAX_ORDER)}
_MASKS = 1 << len(RELAX_ORDER)
_SCALARS = [f for f in RELAX_ORDER if f != "colores"]
_SCALAR_KEY = ["mask", *[f"key_{f}" for f in _SCALARS]]
KEY = [*_SCALAR_KEY, "key_colores"]


def _has(name: str) -> Column:
    return F.col("mask").bitwiseAND(F.lit(_BIT[name])) != 0


def _key_part(name: str, value: Column) -> Column:
    return F.when(_has(name), value).otherwise(F.lit("")).alias(f"key_{name}")


def variant_groups(articles: DataFrame) -> DataFrame:
    """Articles of a product that agree in every facet: lowest article and their number.

    Everything later works on this narrow table. Map-side combine shrinks a product that holds
    a large share of the catalog to its distinct facet combinations.
    """
    return articles.groupBy("product_code", *FACETS).agg(
        F.min("article_id").alias("article_id"), F.count("*").alias("variantes")
    )


def refresh_groups(groups: DataFrame, before: DataFrame, after: DataFrame, batch: DataFrame) -> DataFrame:
    """`variant_groups(after)` from those of `before`, where `after` is `before` with the rows of `batch` put over it.

    Only products that the batch touches are grouped again: those of its rows, and those that its articles belonged to
    before (a lowest article can't be taken out of a minimum). The other groups are kept as they are.
    """
    moved = before.join(batch.select("article_id"), "article_id", "left_semi").select("product_code")
    touched = batch.select("product_code").unionByName(moved).distinct()
    kept = groups.join(touched, "product_code", "left_anti")
    anew = variant_groups(after.join(touched, "product_code", "left_semi"))
    return kept.unionByName(anew.select(*kept.columns))


def _keys_of_tuples(tuples: DataFrame, masks: DataFrame) -> DataFrame:
    """Each facet combination under every mask in use, leaving out masks over a null facet."""
    null_bits = reduce(
        add, [F.when(F.col(FACET_COLUMN[f]).isNull(), _BIT[f]).otherwise(0) for f in RELAX_ORDER]
    )
    return (
        tuples.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(_MASKS - 1))))
        .filter(F.col("mask").bitwiseAND(null_bits) == 0)
        # There are 32 masks at most.
        .join(F.broadcast(masks), "mask", "left_semi")
        .select("*", *[_key_part(f, F.col(FACET_COLUMN[f])) for f in RELAX_ORDER])
    )


def request_levels(requests: DataFrame, relax: bool = True) -> DataFrame:
    """What each request asks for at each relaxation level.

    At level n the first n facets of the relaxation order are dropped. Without `relax` only level
    0 is produced. Excluded colours are asked for at every level.
    """
    last = len(RELAX_ORDER) if relax else 0

    def asked(name: str) -> Column:
        return is_set(name) & (F.col("level") <= RELAX_ORDER.index(name))

    bits = [F.when(asked(f), _BIT[f]).otherwise(0) for f in _SCALARS]
    bits.append(F.when(asked("colores") | is_set("colores_excluidos"), _BIT["colores"]).otherwise(0))
    return (
        requests.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(last))))
        .withColumn("mask", reduce(add, bits))
        .select(
            "query_id",
            "level",
            "mask",
            *[_key_part(f, F.col(f)) for f in _SCALARS],
            F.when(asked("colores"), F.col("colores")).alias("wanted"),
            list_or_empty("colores_excluidos").alias("unwanted"),
        )
    )


def matching_keys(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, level, key, n): the existing keys that satisfy a request's level.

    `n` is the number of variant groups under the key. A request that asks for or excludes colours gets
    one key per colour that fits.
    """
    tuples = groups.groupBy(*FACETS).agg(F.count("*").alias("n"))
    masks = levels.select("mask").distinct()
    existing = _keys_of_tuples(tuples, masks).groupBy(*KEY).agg(F.sum("n").alias("n"))
    colour = F.col("key_colores")
    # As in SQL, a null in a list is no match for IN, and NOT IN a list with a null is never true.
    asked = F.col("wanted").isNull() | F.coalesce(F.array_contains("wanted", colour), F.lit(False))
    colour_fits = ~_has("colores") | (asked & F.coalesce(~F.array_contains("unwanted", colour), F.lit(False)))
    return levels.join(by_shuffle(existing), _SCALAR_KEY).filter(colour_fits).select("query_id", "level", *KEY, "n")


def lowest_level(matches: DataFrame) -> DataFrame:
    """Keep, per request, the matches of the first level that finds anything."""
    per_request = Window.partitionBy("query_id")
    return (
        matches.withColumn("_lowest", F.min("level").over(per_request))
        .filter("level = _lowest")
        .drop("_lowest")
    )


def number_keys(matches: DataFrame) -> DataFrame:
    """(key_id, key, n, asking): the distinct keys of all requests, numbered.

    Numbers are given while the table is written, so they are the same for all its readers, and later
    shuffles carry a number instead of the facet values.
    """
    distinct = matches.groupBy(*KEY).agg(F.max("n").alias("n"), F.count("*").alias("asking"))
    return write_once(distinct.withColumn("key_id", F.monotonically_increasing_id()), "keys")


def candidates(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """(key_id, product_code, article_id, variantes): one row per product under each numbered key.

    A variant group is repeated once per mask in use at most, never once per request.
    """
    tuples, masks = groups.select(*FACETS).distinct(), asked.select("mask").distinct()
    keyed = _keys_of_tuples(tuples, masks).join(asked.select("key_id", *KEY), KEY)
    keyed = keyed.select("key_id", *[F.col(c).alias(f"_{c}") for c in FACETS])
    same_facets = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FACETS])
    return (
        groups.join(by_shuffle(keyed), same_facets)
        .groupBy("key_id", "product_code")
        .agg(F.min("article_id").alias("article_id"), F.sum("variantes").alias("variantes"))
    )
