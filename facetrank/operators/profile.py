"""Which columns of a table can serve as facets, and which are text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Most distinct values a facet may have, and rows shown of the text column.
MAX_FACET_VALUES = 60
SAMPLE_ROWS = 3
#: Size of a sketch of distinct values: 16 KB, a relative error of 0.8 % (one standard deviation).
SKETCH_LG_K = 14


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _as_text(df: DataFrame, column: str) -> Column:
    """A value of any type as text; equal values give equal texts."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0)  # both zeros are equal
    return F.to_json(value) if isinstance(kind, T.StructType) else value.cast("string")


def _long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("columna"), _as_text(df, c).alias("valor")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.columna", "p.valor")


def column_profile(df: DataFrame, every_type: bool = False) -> DataFrame:
    """(columna, filas, nulos, distintos) of every string column, or of every column; nulls are not distinct values.

    Values are grouped first and counted second: both shuffles are pre-combined on the map side,
    and a value that fills a third of the table arrives as one row per map task.
    """
    key = F.sha2("valor", 256)  # values are compared by digest, so that long texts are not shuffled
    per_value = (
        _long_form(df, df.columns if every_type else string_columns(df))
        .select("columna", key.alias("valor"))
        .groupBy("columna", "valor")
        .agg(F.count("*").alias("n"))
    )
    return per_value.groupBy("columna").agg(
        F.sum("n").alias("filas"),
        F.coalesce(F.sum(F.when(F.col("valor").isNull(), F.col("n"))), F.lit(0)).alias("nulos"),
        F.count("valor").alias("distintos"),
    )


def column_sketches(df: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """(columna, filas, nulos, sketch) of every column in one scan, to be stored with a version of the table.

    A sketch takes 2^`lg_k` bytes whatever the number of values; a task sends one a column. Its relative error is 1.04 / 2^(`lg_k` / 2).
    """
    figures = [
        F.struct(
            F.lit(c).alias("columna"), F.count(F.lit(1)).alias("filas"), F.count_if(F.col(c).isNull()).alias("nulos"),
            F.hll_sketch_agg(_as_text(df, c), F.lit(lg_k)).alias("sketch"),
        )
        for c in df.columns
    ]
    return df.agg(F.array(*figures).alias("all")).select(F.inline("all"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """(columna, filas, nulos, distintos): figures over all tables whose sketches are given; distinct values are estimated.

    A value that several tables hold is counted once.
    """
    return sketches.groupBy("columna").agg(
        F.sum("filas").alias("filas"), F.sum("nulos").alias("nulos"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distintos"),
    )


def facet_candidates(df: DataFrame, max_values: int = MAX_FACET_VALUES) -> DataFrame:
    """(columna, distintos, es_faceta): columns above `max_values` are meant for semantic search."""
    return column_profile(df).select(
        "columna", "distintos", (F.col("distintos") <= max_values).alias("es_faceta")
    )


def value_counts(df: DataFrame, max_values: int = MAX_FACET_VALUES) -> DataFrame:
    """(columna, valor, n) of the facet candidates, most frequent first; nulls are left out.

    The column names found first (one per column of the table) choose what the second scan reads,
    so long text columns stay unread.
    """
    names = [r["columna"] for r in facet_candidates(df, max_values).filter("es_faceta").collect()]
    if not names:
        return df.sparkSession.createDataFrame([], "columna string, valor string, n long")
    return (
        _long_form(df, [c for c in string_columns(df) if c in names])
        .filter(F.col("valor").isNotNull())
        .groupBy("columna", "valor")
        .agg(F.count("*").alias("n"))
        .orderBy("columna", F.desc("n"), "valor")
    )


def text_nulls(df: DataFrame, column: str = "detail_desc") -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("nulos"))


def text_sample(df: DataFrame, order_by: str, column: str = "detail_desc", n: int = SAMPLE_ROWS) -> DataFrame:
    """The first `n` texts that are not null."""
    return df.filter(F.col(column).isNotNull()).select(order_by, column).orderBy(order_by).limit(n)
