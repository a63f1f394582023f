"""Text expressions: texts to embed, blank tests, display lists, filters as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetrank.schema import FILTER_FIELDS, LIST_FIELDS

# Columns that make up the text of a product, and what joins them.
EMBEDDED_COLUMNS = ("prod_name", "product_type_name", "detail_desc")
SENTENCE_SEPARATOR = ". "
LIST_SEPARATOR = ", "

# Java's Unicode whitespace lacks the four separators U+001C to U+001F.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def product_text() -> Column:
    """Name, type and description joined; null and empty parts are left out."""
    return F.concat_ws(SENTENCE_SEPARATOR, *[F.nullif(F.col(c), F.lit("")) for c in EMBEDDED_COLUMNS])


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends (`trim` only knows the space character)."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def display_list(col: Column) -> Column:
    return F.array_join(col, LIST_SEPARATOR)


def filters_json(prefix: str = "", fields=FILTER_FIELDS) -> Column:
    """All filter fields as JSON, unset ones as null."""
    return F.to_json(
        F.struct(*[F.col(prefix + f).alias(f) for f in fields]), {"ignoreNullFields": "false"}
    )


def compact_filters_json(prefix: str = "") -> Column:
    """Only the filter fields that differ from their default."""
    def value(name: str) -> Column:
        col = F.col(prefix + name)
        return F.when(F.size(col) > 0, col) if name in LIST_FIELDS else col

    return F.to_json(F.struct(*[value(f).alias(f) for f in FILTER_FIELDS]))
