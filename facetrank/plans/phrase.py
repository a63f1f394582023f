"""Phrases with a model's answers to envelopes, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.operators.answers import validate_answers
from facetrank.plans.batch import search_batch
from facetrank.plans.index import embed_requests
from facetrank.plans.reports import envelopes
from facetrank.schema import DEFAULT_LIMIT, Vocabulary, check_limit
from facetrank.sources.tables import read_vectors


def search_phrases(
    catalog: DataFrame, index_path: str, answers: DataFrame, vocab: Vocabulary, encoder,
    limit: int = DEFAULT_LIMIT, groups: DataFrame | None = None,
) -> DataFrame:
    """The envelopes of all phrases in `answers` (query_id, frase, response_1, response_2), with `productos`.

    Answers are validated, their semantic texts encoded, and the index of the same encoder is searched. `groups` as in
    `search_batch`.
    """
    asked = embed_requests(validate_answers(answers, vocab), encoder).withColumn("limite", F.lit(check_limit(limit)))
    vectors = read_vectors(catalog.sparkSession, index_path, encoder.model_id)
    return envelopes(search_batch(catalog, vectors, asked, groups), with_codes=True)
