"""Which version of a catalog a derived table belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.operators.facet_keys import FACETS, refresh_groups, variant_groups

VERSION = "version"


class StaleGroups(ValueError):
    """Variant groups that belong to another version of the catalog."""


def catalog_tag(articles: DataFrame) -> str:
    """Tag of what variant groups are made of: ids, products and facets of all articles, in any order.

    One scan of these narrow columns; a task sends three numbers. The tags of two catalogs are equal by chance once in 2^64 or less.
    """
    null = F.lit("\0")
    cells = [F.coalesce(F.col(c).cast("string"), null) for c in ("article_id", "product_code", *FACETS)]
    one, other = F.xxhash64(*cells), F.xxhash64(F.lit("other"), *cells)
    row = articles.agg(
        F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("sum"), F.bit_xor(other).alias("xor")
    ).first()
    return f"{row['n']}-{row['sum'] or 0}-{(row['xor'] or 0) % (1 << 64):016x}"


def tagged_groups(articles: DataFrame) -> DataFrame:
    """`variant_groups` with the tag of their catalog in every row, to be stored and passed as `groups=`."""
    return variant_groups(articles).withColumn(VERSION, F.lit(catalog_tag(articles)))


def is_current(groups: DataFrame, articles: DataFrame) -> bool:
    """Whether all rows of tagged groups are those of this catalog; groups without a tag are nobody's."""
    if VERSION not in groups.columns:
        return False
    tags = groups.agg(F.min(VERSION).alias("least"), F.max(VERSION).alias("most"), F.count(F.lit(1)).alias("n")).first()
    if tags["n"] == 0:
        return articles.isEmpty()
    return tags["least"] == tags["most"] == catalog_tag(articles)


def checked_groups(groups: DataFrame, articles: DataFrame) -> DataFrame:
    """The groups without their tag; those of another catalog are refused."""
    if not is_current(groups, articles):
        raise StaleGroups("the variant groups are not those of this catalog: make them anew or refresh them")
    return groups.drop(VERSION)


def refreshed_groups(groups: DataFrame, before: DataFrame, after: DataFrame, batch: DataFrame) -> DataFrame:
    """`tagged_groups(after)` from those of `before`; see `refresh_groups`."""
    fresh = refresh_groups(checked_groups(groups, before), before, after, batch)
    return fresh.withColumn(VERSION, F.lit(catalog_tag(after)))
