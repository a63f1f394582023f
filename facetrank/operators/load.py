"""Cleaning, upsert and load figures of a catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.schema import CATALOG_COLUMNS, FACET_COLUMN


def _in_whitelist(categories: Sequence[str]) -> Column:
    group = F.col(FACET_COLUMN["categoria"])
    return F.coalesce(group.isin(list(categories)), F.lit(False))


def clean(rows: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Keep rows of a known category that have a description."""
    return rows.filter(_in_whitelist(categories)).dropna(subset=["detail_desc"])


def figures(categories: Sequence[str]) -> list[Column]:
    """Rows read, rows discarded by reason, rows that go on to the upsert; as aggregates."""
    known = _in_whitelist(categories)
    described = F.col("detail_desc").isNotNull()
    return [
        F.count("*").alias("leidas"),
        F.count_if(~known).alias("fuera_de_lista"),
        F.count_if(known & ~described).alias("sin_descripcion"),
        F.count_if(~(known & described)).alias("descartadas"),
        F.count_if(known & described).alias("insertadas"),
    ]


def load_report(rows: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row of `figures`."""
    return rows.agg(*figures(categories))


def upsert(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """The catalog after `incoming` replaced rows by `article_id`; the last one by `seq` wins.

    Only the batch is ranked. The stored table meets the batch in an anti-join on the key alone,
    which Spark turns into a broadcast when the batch is small: no shuffle of the stored rows.
    """
    latest_first = Window.partitionBy("article_id").orderBy(F.col(seq).desc())
    latest = (
        incoming.withColumn("_rank", F.row_number().over(latest_first))
        .filter("_rank = 1")
        .select(*CATALOG_COLUMNS)
    )
    untouched = existing.select(*CATALOG_COLUMNS).join(
        incoming.select("article_id"), "article_id", "left_anti"
    )
    return untouched.unionByName(latest)


def catalog_totals(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.count("*").alias("filas"), F.countDistinct("product_code").alias("productos")
    ).withColumn("variantes_extra", F.col("filas") - F.col("productos"))


def facet_distribution(articles: DataFrame, fields: Sequence[str] = ("publico", "categoria")) -> DataFrame:
    """(campo, valor, n): rows per value of each facet, one scan for all facets."""
    pairs = [
        F.struct(F.lit(f).alias("campo"), F.col(FACET_COLUMN[f]).alias("valor")) for f in fields
    ]
    return (
        articles.select(F.explode(F.array(*pairs)).alias("p"))
        .groupBy("p.campo", "p.valor")
        .agg(F.count("*").alias("n"))
        .orderBy("campo", F.desc("n"), "valor")
    )
