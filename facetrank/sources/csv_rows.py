"""Rows of CSV files whose quoted cells hold line breaks, found in blocks of the files by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetrank.shared import write_once

_QUOTE, _COMMA = b'",'


class BareQuote(ValueError):
    """A quote that neither opens nor closes a cell."""


def csv_rows(spark: SparkSession, path) -> DataFrame:
    """(file, block, row, record): the text of each row but the headers; the first three give its place in the input.

    A line starts a row if an even number of quotes stands before it in its file. Lines are counted by block first, here and now: one
    narrow row a block says whether the block starts and ends inside a cell. The row that a block's end cuts is put together from
    the lines on both sides (one small group a cut, the only lines that are shuffled); all other rows are made where their lines are.
    A row belongs to the block in which it starts. Blank lines between rows are no rows. Rows end with a line feed, which a carriage return
    may precede; line breaks inside cells stay as they are.

    Quotes must stand around whole cells and be doubled inside. A file that ends inside a cell is refused here, a quote elsewhere when
    the rows are read (`BareQuote`), and so are blocks that changed between the two readings (as the input or
    `spark.sql.files.maxPartitionBytes` did). The text of the blocks' table is a path for each block that is cut.
    """
    text = spark.read.text(path, lineSep="\n")
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value",
    )
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2
    blocks = write_once(_parities(lines.select("file", "block", "row", odd.alias("odd"))), "csv-blocks")
    open_end = blocks.filter("ends_inside AND is_last").select("file").head(1)
    if open_end:
        raise BareQuote(f"{open_end[0]['file']} ends inside a quoted cell")
    cut = blocks.filter("starts_inside OR ends_inside").drop("is_last")
    if cut.isEmpty():
        return _whole_rows(lines)
    # One row a cut block, so at most one for each `maxPartitionBytes` of the input.
    placed = lines.join(F.broadcast(cut), ["file", "block"], "left")
    before = F.coalesce(F.col("starts_inside") & ~(F.col("row") > F.col("first_odd")), F.col("starts_inside"), F.lit(False))
    after = F.coalesce(F.col("opens") & (F.col("row") >= F.col("last_odd")), F.lit(False))
    whole = placed.filter(~(before | after)).select(*lines.columns)
    return _whole_rows(whole).unionByName(_cut_rows(placed.filter(before | after), before))


def _parities(lines: DataFrame) -> DataFrame:
    """A row a block: whether it starts and ends inside a cell, where its first cell closes and its last one opens.

    `opens` tells that a row starts in the block and goes on after it, `owner` the last block before this one that does.
    """
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.col("odd") == 1
    counted = lines.groupBy("file", "block").agg(
        F.sum("odd").alias("n"), F.min("row").alias("first_row"),
        F.min(F.when(flips, F.col("row"))).alias("first_odd"), F.max(F.when(flips, F.col("row"))).alias("last_odd"),
    )
    start = F.coalesce(F.sum("n").over(earlier), F.lit(0)) % 2
    sided = counted.withColumn("starts_inside", start == 1).withColumn("ends_inside", (start + F.col("n")) % 2 == 1)
    sided = sided.withColumn("opens", F.col("ends_inside") & F.col("first_odd").isNotNull())
    return sided.select(
        "file", "block", "first_row", "first_odd", "last_odd", "starts_inside", "ends_inside", "opens",
        F.last(F.when(F.col("opens"), F.col("block")), ignorenulls=True).over(earlier).alias("owner"),
        F.lead("block").over(in_file).isNull().alias("is_last"),
    )


def _cut_rows(lines: DataFrame, before) -> DataFrame:
    """Rows that lie in several blocks, from their lines. The row of a header is left out."""
    owner = F.when(before, F.col("owner")).otherwise(F.col("block"))
    line = F.struct("block", "row", "value", "first_row")
    rows = lines.groupBy("file", owner.alias("start")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    first = F.element_at("lines", 1)
    joined = F.concat_ws("\n", F.transform("lines", lambda x: x["value"]))
    return rows.filter((F.col("start") > 0) | (first["row"] > first["first_row"])).select(
        "file", F.col("start").alias("block"), first["row"].alias("row"),
        F.regexp_replace(joined, "\r\\z", "").alias("record"),
    )


def _whole_rows(lines: DataFrame) -> DataFrame:
    """Rows from lines that start and end outside of cells in every block."""
    binary = lines.withColumn("value", F.col("value").cast("binary"))
    found = binary.mapInArrow(_join_lines, "file string, block long, row long, record binary")
    return found.withColumn("record", F.col("record").cast("string"))


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's lines to rows; the row that is open at its end is carried to the next batch."""
    carried: pa.Table | None = None
    header_due, last_place = False, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carried is not None:
            table = pa.concat_tables([carried, table])
        if not table.num_rows:
            continue
        lines = table["value"].combine_chunks().cast(pa.binary())
        inside = _starts_inside(lines)
        starts = np.flatnonzero(~inside)
        carried = table.slice(starts[-1]) if inside[-1] else None
        if len(starts) < 2:
            continue
        # The last start is the end of the rows that are complete.
        place = table.select(["file", "block", "row"]).take(pa.array(starts[:-1])).combine_chunks()
        records = _joined(lines, starts)
        filled = pc.greater(pc.binary_length(records), 0).to_numpy(zero_copy_only=False)
        keep = filled.copy()
        runs = _runs(place)
        for begin, end in zip(runs, [*runs[1:], place.num_rows], strict=True):
            here = (place["file"][begin].as_py(), place["block"][begin].as_py())
            if here != last_place:
                header_due, last_place = here[1] == 0, here
            found = np.flatnonzero(filled[begin:end])
            if header_due and len(found):
                keep[begin + found[0]], header_due = False, False
        yield from place.append_column("record", records).filter(pa.array(keep)).combine_chunks().to_batches()
    if carried is not None:
        raise BareQuote("a block ends inside a cell: quotes are not in pairs, or the blocks changed while they were read")


def _runs(place: pa.Table) -> list[int]:
    """Where the rows of a file's block begin, the first one included."""
    files, blocks = place["file"].combine_chunks(), place["block"].to_numpy()
    other = pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False) | (blocks[1:] != blocks[:-1])
    return [0, *(np.flatnonzero(other) + 1).tolist()]


def _starts_inside(lines: pa.Array) -> np.ndarray:
    """For each line, and the end, whether it starts inside a cell; the first line doesn't."""
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2], np.uint8) if lines.buffers()[2] else np.zeros(0, np.uint8)
    quotes = np.flatnonzero(data[offsets[0] : offsets[-1]] == _QUOTE) + offsets[0]
    opening = quotes[::2]
    at_start = np.isin(opening, offsets)
    previous = data[np.maximum(opening - 1, 0)]
    bare = opening[~at_start & (previous != _COMMA) & (previous != _QUOTE)]
    if len(bare):
        line = lines[int(np.searchsorted(offsets, bare[0], "right")) - 1].as_py()
        raise BareQuote(f"a quote inside a cell that is not quoted, or blocks that changed: {line[:200]!r}")
    return np.searchsorted(quotes, offsets) % 2 == 1


def _joined(lines: pa.Array, starts: np.ndarray) -> pa.Array:
    """Lines between starts with the line feeds between them, without the carriage return at the end of a row."""
    rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), lines), b"\n")
    ended = pc.ends_with(rows, b"\r")
    return pc.if_else(ended, pc.binary_slice(rows, 0, -1), rows)
