"""Facet predicates as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetrank.schema import FACET_COLUMN, HARD_FIELDS, LIST_FIELDS, Filters, Vocabulary, vocabulary_of


def facet_predicate(filters: Filters) -> Column:
    """Conjunction of the filled filters; true if none is filled.

    Literals in plain comparisons, so every part can be pushed to the Parquet scan. Excluding
    colours also drops rows without a colour (SQL's NOT IN); an empty list adds no condition.
    """
    colour = F.col(FACET_COLUMN["colores"])
    parts = [
        F.col(FACET_COLUMN[name]) == F.lit(getattr(filters, name))
        for name in HARD_FIELDS
        if name not in LIST_FIELDS and getattr(filters, name)
    ]
    if filters.colores:
        parts.append(colour.isin(list(filters.colores)))
    if filters.colores_excluidos:
        parts.append(~colour.isin(list(filters.colores_excluidos)))
    return reduce(and_, parts, F.lit(True))


def literal_strings(values=()) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def list_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), literal_strings())


def is_set(name: str) -> Column:
    """Whether a request fills this filter."""
    if name in LIST_FIELDS:
        return F.size(list_or_empty(name)) > 0
    return F.coalesce(F.col(name), F.lit("")) != ""


def _unknown(asked: Column, name: str, vocab: Vocabulary) -> Column:
    known = literal_strings(vocabulary_of(vocab, name))
    unknown = F.filter(asked, lambda v: ~F.coalesce(F.array_contains(known, v), F.lit(False)))
    return F.transform(unknown, lambda v: F.struct(F.lit(name).alias("campo"), v.alias("valor")))


def bad_facet_values(vocab: Vocabulary) -> Column:
    """array<struct<campo,valor>> of the requested values that the vocabulary does not know."""
    per_field = []
    for name in HARD_FIELDS:
        if name in LIST_FIELDS:
            asked = list_or_empty(name)
        else:
            asked = F.array_compact(F.array(F.col(name)))
        per_field.append(_unknown(asked, name, vocab))
    return F.concat(*per_field)
