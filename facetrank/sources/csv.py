"""CSV catalogs: column-pruned scan, missing-value tokens, casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetrank.schema import CATALOG_SCHEMA
from facetrank.sources.csv_rows import csv_rows

# Cell texts that count as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def missing_as_null(col: Column) -> Column:
    return F.when(~col.isin(list(NA_TOKENS)), col)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_catalog_csv(spark: SparkSession, path, limit: int = 0, multiline: bool = True, split: bool = True) -> DataFrame:
    """The ten catalog columns, by header name, plus `seq`, the position of the row in the input.

    `limit` > 0 keeps the first rows in file order (files in path order, see `first_rows`). Files are read in blocks by many tasks,
    also where quoted cells hold line breaks: see `csv_rows`, which reads the input here and now to find the row ends. Set
    `multiline` to False if no cell holds a line break; that saves this step. Files with bare quotes inside cells that are not
    quoted are refused; `split=False` takes them, each file in one task.
    """
    options = {"escape": '"', "encoding": "UTF-8"}
    raw = spark.read.csv(path, header=True, multiLine=multiline, inferSchema=False, **options)
    if multiline and split:
        cells = ", ".join(f"{_quoted(name)} string" for name in raw.columns)
        rows = csv_rows(spark, path).withColumn("cells", F.from_csv("record", cells, {**options, "multiLine": "true"}))
        source, seq = "cells.", F.struct("file", "block", "row")
    else:
        # Rows of one file block are read in order by one task, so the running id orders them within it.
        rows, source = raw, ""
        seq = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
    columns = [missing_as_null(F.col(source + f.name)).cast(f.dataType).alias(f.name) for f in CATALOG_SCHEMA]
    rows = rows.select(*columns, seq.alias("seq"))
    return first_rows(rows, limit) if limit > 0 else rows


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows by `seq`.

    Rows are counted by file block here and now (one narrow row a block); the blocks before the cut then stay whole and where
    they are, and only rows of the block that is cut are numbered.
    """
    in_order = Window.orderBy("file", "block")
    blocks = rows.groupBy("seq.file", "seq.block").agg(F.count(F.lit(1)).alias("n"))
    cut = blocks.withColumn("until", F.sum("n").over(in_order)).filter(F.col("until") >= limit).orderBy("until").head()
    if cut is None:
        return rows
    here = F.struct(F.lit(cut["file"]).alias("file"), F.lit(cut["block"]).alias("block"))
    place = F.struct(F.col("seq.file").alias("file"), F.col("seq.block").alias("block"))
    numbered = Window.partitionBy("seq.file", "seq.block").orderBy("seq.row")
    part = rows.filter(place == here).withColumn("_n", F.row_number().over(numbered))
    part = part.filter(F.col("_n") <= limit - (cut["until"] - cut["n"])).drop("_n")
    return rows.filter(place < here).unionByName(part)


def write_catalog_csv(df: DataFrame, path: str) -> None:
    """CSV that `read_catalog_csv` reads back unchanged, quotes and line breaks included."""
    df.write.csv(
        path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, encoding="UTF-8",
    )
