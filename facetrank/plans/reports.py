"""Answers as they are handed out: one envelope per request, and what became of its filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.functions.text import display_list
from facetrank.plans.batch import Answers
from facetrank.plans.search import FACET_RESULT, RANKED_RESULT
from facetrank.schema import FILTER_FIELDS, HARD_FIELDS, LIST_FIELDS
from facetrank.shared import by_shuffle


def _results_per_request(requests: DataFrame, results: DataFrame, columns) -> DataFrame:
    """Add `total`, `resultados` and `productos`; requests without results keep 0 and empty arrays.

    A request has at most `MAX_LIMIT` rows, so the collected arrays are bounded. `productos` has the product codes of `resultados` as a list of
    its own: Spark drops a whole list that nobody reads, but no field of one, so whoever wants the codes alone would shuffle
    the texts of every row.
    """
    lists = results.groupBy("query_id").agg(
        F.count("*").alias("total"),
        F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("resultados"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "product_code"))), lambda r: r["product_code"]).alias("productos"),
    )

    def or_empty(name: str) -> Column:
        return F.coalesce(name, F.array().cast(lists.schema[name].dataType))

    return (
        requests.join(by_shuffle(lists), "query_id", "left")
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("resultados", or_empty("resultados"))
        .withColumn("productos", or_empty("productos"))
    )


def _filters(prefix: str, fields) -> Column:
    return F.struct(*[F.col(prefix + f).alias(f) for f in fields])


def envelopes(answers: Answers, with_codes: bool = False) -> DataFrame:
    """(query_id, frase, total, filtros_pedidos, filtros_aplicados, filtros_relajados, resultados), and `productos` if wanted."""
    joined = _results_per_request(answers.requests, answers.results, RANKED_RESULT)
    return joined.select(
        "query_id",
        "frase",
        "total",
        _filters("", FILTER_FIELDS).alias("filtros_pedidos"),
        _filters("aplicado_", FILTER_FIELDS).alias("filtros_aplicados"),
        "filtros_relajados",
        "resultados",
        *(["productos"] if with_codes else []),
    )


def facet_envelopes(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, total, filtros_aplicados, resultados) of facet-only requests."""
    joined = _results_per_request(requests, results, FACET_RESULT)
    return joined.select(
        "query_id", "total", _filters("", HARD_FIELDS).alias("filtros_aplicados"), "resultados"
    )


def filter_report(relaxed: DataFrame) -> DataFrame:
    """(query_id, pos, campo, valor, relajado): each filter asked for, in display order."""
    def shown(pos: int, name: str) -> Column:
        col = F.col(name)
        value = F.when(F.size(col) > 0, display_list(col)) if name in LIST_FIELDS else F.nullif(col, F.lit(""))
        return F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("campo"), value.alias("valor"))

    rows = F.array(*[shown(i, f) for i, f in enumerate(HARD_FIELDS, 1)])
    return (
        relaxed.select("query_id", "filtros_relajados", F.inline(F.filter(rows, lambda r: r["valor"].isNotNull())))
        .withColumn("relajado", F.array_contains("filtros_relajados", F.col("campo")))
        .drop("filtros_relajados")
    )
