"""Line dedup by pairwise alignment.

Overlapping documents are found through windows: from each line on, and up to each line, the shortest run of lines that
holds `min_words` words, whatever the length of the lines. Each holder of a window is paired with the window's first
holder. Any block of that many words that a document shares with an earlier one is covered by such windows, and the first
holder of each has the whole window; so pairs grow with the lines, and a window's frequency changes nothing.
Each pair is aligned by patience diff over hashes of whole lines. Runs of aligned lines that are neighbours
in both documents and hold at least `min_words` words are deleted from the later document. A diff can't align blocks that
either document holds twice or in another order; these are found by their windows and go as well, with every copy in the later
document. Runs from several partners add up. So just those lines go that lie in a block of `min_words` words which an
earlier document holds. Documents are ordered by doc_id, then by a hash of their text.

Of each passage the first holder keeps its lines, also where it repeats them. Null texts stay null and have no lines; rows that repeat doc_id and
text are one document, which is not deleted from itself; rows that repeat only doc_id are different documents. A
null doc_id comes first. Columns are kept whatever their names, except that `text` is cut and `n_lines`,
`n_dropped` and `dropped` (line numbers from 0) are replaced and that names may not begin with two underscores. An empty table stays empty.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.llm.common import join_hot, map_batches
from facetrank.shared import write_once

MIN_WORDS = 20

#: Odd, so that it has an inverse among 64-bit integers.
_BASE = 0x9E3779B97F4A7C15

_KEY = "struct<doc_id:bigint,ver:bigint>"


def _doc() -> Column:
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ver"))


def document_lines(docs: DataFrame) -> DataFrame:
    """doc, hashes, n_words of all lines: one row for each different document that has a text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts = [], []
        for text in batch.column(1).to_pylist():
            lines = text.encode("utf-8", "surrogatepass").split(b"\n")
            hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)).view(np.int64))
            counts.append([len(line.split()) for line in lines])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
            ["doc", "hashes", "n_words"],
        )

    read = docs.filter(F.col("text").isNotNull()).select(_doc().alias("doc"), "text")
    return map_batches(read, run, f"doc {_KEY}, hashes array<long>, n_words array<int>")


def windows(hashes: list[int], n_words: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest runs that hold min_words words, from each line on and up to each line: first line, line after, hash."""
    n, least = len(hashes), max(min_words, 1)
    total = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])
    until = np.searchsorted(total, total[:-1] + least)
    at = np.searchsorted(total, total[1:] - least, "right") - 1
    onward, upward = np.flatnonzero(until <= n), np.flatnonzero(at >= 0)
    at, until = np.concatenate([onward, at[upward]]), np.concatenate([until[onward], upward + 1])
    powers, inverses = (np.cumprod(np.full(n + 1, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 2**64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(hashes, np.int64).view(np.uint64) * powers[:n])])
    keys = (sums[until] - sums[at]) * inverses[at] + (until - at).astype(np.uint64) * powers[0]
    return at, until, keys.view(np.int64)


def overlapping(lines: DataFrame, min_words: int) -> DataFrame:
    """(later, earlier): each document that holds a window, with the first document that holds it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(windows(h, n, min_words)[2]) for h, n in zip(*(batch.column(c).to_pylist() for c in (1, 2)))]
        docs = np.repeat(np.arange(len(found), dtype=np.int32), [len(keys) for keys in found])
        keys = np.concatenate([np.empty(0, np.int64), *found])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), pa.array(keys)], ["doc", "window"])

    held = map_batches(lines.select("doc", "hashes", "n_words"), run, f"doc {_KEY}, window long")
    holders = held.groupBy("window").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = join_hot(held, holders.filter("n > 1"), ["window"], F.xxhash64("doc"))
    return shared.filter(F.col("doc") != F.col("first")).select(
        F.col("doc").alias("later"), F.col("first").alias("earlier")).distinct()


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, given by rising first number, in which the second rises too (patience sorting)."""
    tops: list[int] = []
    top_pairs: list[int] = []
    below = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        below[i] = top_pairs[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(b)
            top_pairs.append(i)
        else:
            tops[pile], top_pairs[pile] = b, i
    found = []
    i = top_pairs[-1] if top_pairs else -1
    while i >= 0:
        found.append(pairs[i])
        i = below[i]
    return found[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two lists of line hashes, rising in both.

    Equal heads and tails of a stretch are aligned; between them, lines that occur once on either side are anchors,
    and the stretches between anchors are aligned in the same way. A stretch without anchors ends it; common_blocks()
    finds the blocks in it.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {line: y for y, line in enumerate(b[k:m], k) if in_b[line] == 1}
        anchors = [(x, place[line]) for x, line in enumerate(a[i:j], i) if in_a[line] == 1 and line in place]
        anchors = increasing(anchors)
        for (x, y), (x_next, y_next) in zip(anchors, [*anchors[1:], (j, m)]):
            found.append((x, y))
            todo.append((x + 1, x_next, y + 1, y_next))
        if anchors:
            todo.append((i, anchors[0][0], k, anchors[0][1]))
    return sorted(found)


def common_blocks(later: list[int], n_words: list[int], earlier: list[int], n_earlier: list[int], min_words: int) -> list[int]:
    """Line numbers of the later document in runs that are to be deleted."""
    dropped: set[int] = set()
    run: list[int] = []
    before = (-2, -2)
    for x, y in [*patience(later, earlier), (-2, -2)]:
        if (x, y) != (before[0] + 1, before[1] + 1):
            if sum(n_words[i] for i in run) >= min_words:
                dropped.update(run)
            run = []
        run.append(x)
        before = (x, y)
    if len(dropped) < len(later):
        at, until, keys = windows(later, n_words, min_words)
        shared = np.isin(keys, windows(earlier, n_earlier, min_words)[2])
        edges = np.bincount(at[shared], minlength=len(later) + 1) - np.bincount(until[shared], minlength=len(later) + 1)
        dropped.update(np.flatnonzero(np.cumsum(edges)).tolist())
    return sorted(dropped)


def dropped_lines(lines: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """doc, dropped (sorted line numbers), kept_runs: of documents that lose lines."""

    def align(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, numbers = [], []
        for i, pair in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)))):
            found = common_blocks(*pair, min_words)
            docs += [i] * len(found)
            numbers += found
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(docs, pa.int32())), pa.array(numbers, pa.int32())], ["doc", "line"])

    own = lines.select(F.col("doc").alias("later"), "hashes", "n_words")
    other = lines.select(F.col("doc").alias("earlier"), F.col("hashes").alias("other"), F.col("n_words").alias("n_other"))
    both = pairs.join(own, "later").join(other, "earlier").select("later", "hashes", "n_words", "other", "n_other")
    found = map_batches(both, align, f"doc {_KEY}, line int").groupBy("doc").agg(F.collect_set("line").alias("dropped"))

    sizes = lines.select("doc", F.size("hashes").alias("_n"))
    found = found.join(sizes, "doc").withColumn("dropped", F.sort_array("dropped"))
    after = F.concat(F.array(F.lit(-1)), "dropped")
    until = F.concat("dropped", F.array("_n"))
    gaps = F.zip_with(after, until, lambda a, b: F.struct((a + 1).alias("at"), (b - a - 1).alias("n")))
    return found.select("doc", "dropped", F.filter(gaps, lambda g: g["n"] > 0).alias("kept_runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, `text` without the deleted lines, with n_lines (before), n_dropped and dropped."""
    lines = write_once(document_lines(docs).dropDuplicates(["doc"]), "document-lines")
    pairs = write_once(overlapping(lines, min_words), "overlapping-documents")
    found = write_once(dropped_lines(lines, pairs, min_words), "dropped-lines")
    rows = docs.drop("n_lines", "n_dropped", "dropped").withColumn("__doc", _doc())
    found = found.select(F.col("doc").alias("__doc"), F.col("dropped").alias("__dropped"), F.col("kept_runs").alias("__runs"))
    joined = rows.join(found.hint("merge"), "__doc", "left")  # one plan for any size
    split = F.split("text", "\n", -1)
    rest = F.flatten(F.transform("__runs", lambda r: F.slice(split, r["at"] + 1, r["n"])))
    cut = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return joined.select(
        *[(cut if c == "text" else F.col(c)).alias(c) for c in rows.columns if c != "__doc"],
        F.coalesce(F.size(split), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).alias("n_dropped"),
        F.coalesce("__dropped", F.array().cast("array<int>")).alias("dropped"),
    )
