"""Model answers (JSON text) to typed filters, field by field.

Input: (query_id, frase, response_1, response_2); a null response is a failed call. Nothing an
answer holds can fail the job: an invalid field is dropped, an unusable answer gives way to the second,
and without a usable one the phrase alone is searched.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrank.functions.facets import literal_strings
from facetrank.functions.text import compact_filters_json, is_blank
from facetrank.schema import FILTER_FIELDS, FILTER_SCHEMA, LIST_FIELDS, Vocabulary, vocabulary_of


def _strict_object(text: Column) -> Column:
    """The text as a VARIANT object, or null if it is not exactly one JSON object.

    The parser ignores what follows the first value, so the text is parsed inside an array and
    inside an object: nothing that follows a value is well-formed in both.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = in_object.isNotNull() & F.try_variant_get(in_array, "$[1]", "variant").isNull()
    value = F.try_variant_get(in_array, "$[0]", "variant")
    return F.when(alone & F.schema_of_variant(value).startswith("OBJECT"), value)


@F.pandas_udf(T.StringType())
def _lenient_object(texts: pd.Series) -> pd.Series:
    """Rewrite what the strict parser refuses but counts as an answer: repeated keys (the last one wins),
    NaN and infinities (never valid filters), and lists of pairs."""
    def rewrite(text):
        try:
            return json.dumps(dict(json.loads(text, parse_constant=lambda _: 1)))
        except (ValueError, TypeError, RecursionError):
            return None

    return texts.map(rewrite, na_action="ignore")


def _get(answer: Column, name: str) -> Column:
    return F.try_variant_get(answer, f"$.{name}", "variant")


def _is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _text(value: Column) -> Column:
    return F.when(_is_string(value), F.try_variant_get(value, "$", "string"))


def _known(value: Column, vocabulary: Column) -> Column:
    return F.coalesce(F.array_contains(vocabulary, _text(value)), F.lit(False))


def _falsy(value: Column) -> Column:
    """Null, false, zero, or empty: a semantic text of this kind is refilled without a complaint."""
    kind = F.schema_of_variant(value)
    numeric = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    return F.coalesce(
        (kind == "VOID")
        | ((kind == "BOOLEAN") & ~F.try_variant_get(value, "$", "boolean"))
        | (numeric & (F.try_variant_get(value, "$", "double") == 0))
        | F.to_json(value).isin("[]", "{}"),
        F.lit(False),
    )


def _field(answer: Column, name: str, phrase: Column, vocab: Vocabulary) -> tuple[Column, Column]:
    """(value, dropped) of one filter field."""
    value = _get(answer, name)
    if name == "consulta_semantica":
        text = _text(value)
        kept = F.when(is_blank(text), phrase).otherwise(text)
        return kept, value.isNotNull() & ~_is_string(value) & ~_falsy(value)
    vocabulary = literal_strings(vocabulary_of(vocab, name))
    if name in LIST_FIELDS:
        items = F.try_variant_get(value, "$", "array<variant>")
        is_list = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))
        valid = is_list & F.coalesce(F.forall(items, lambda v: _known(v, vocabulary)), F.lit(False))
        kept = F.when(valid, F.transform(items, _text)).otherwise(literal_strings())
        return kept, value.isNotNull() & ~valid
    valid = _known(value, vocabulary)
    return F.when(valid, _text(value)), value.isNotNull() & ~valid & ~F.is_variant_null(value)


def validate_answers(answers: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(query_id, frase, <filter fields>, intento, intentos_fallidos, campos_descartados, filtros_json).

    `intento` is 1 or 2, or 0 if neither answer was usable.
    """
    parsed = answers
    for n in (1, 2):
        parsed = parsed.withColumn(f"_strict_{n}", _strict_object(F.col(f"response_{n}")))
        refused = F.when(F.col(f"_strict_{n}").isNull(), F.col(f"response_{n}"))
        # Answers that parsed reach the Python worker as nulls.
        parsed = parsed.withColumn(f"_rewritten_{n}", _lenient_object(refused))
        parsed = parsed.withColumn(
            f"_answer_{n}", F.coalesce(f"_strict_{n}", F.try_parse_json(f"_rewritten_{n}"))
        )
    used = F.when(F.col("_answer_1").isNotNull(), 1).when(F.col("_answer_2").isNotNull(), 2).otherwise(0)
    chosen = parsed.select(
        "query_id", "frase", used.alias("intento"), F.coalesce("_answer_1", "_answer_2").alias("_answer")
    )
    fields = {
        name: _field(F.col("_answer"), name, F.col("frase"), vocab) for name in FILTER_FIELDS
    }
    dropped = F.array(*[F.when(was, F.lit(name)) for name, (_, was) in sorted(fields.items())])
    failed = F.when(F.col("intento") == 0, 2).otherwise(F.col("intento") - 1)
    typed = chosen.select(
        "query_id",
        "frase",
        *[kept.cast(FILTER_SCHEMA[name].dataType).alias(name) for name, (kept, _) in fields.items()],
        "intento",
        failed.alias("intentos_fallidos"),
        F.array_compact(dropped).alias("campos_descartados"),
    )
    return typed.withColumn("filtros_json", compact_filters_json())
