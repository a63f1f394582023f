"""Words grouped by spelling: pairs one inserted, deleted or replaced code point apart, by FM-index search schemes.

Of two words with one error between them, either the first halves agree and the error lies behind them, or the second
halves agree. So there are two searches: one matches the first half exactly and goes on to the right with one error
allowed, the other matches the second half exactly and goes on to the left. A delimiter opens and closes each word, hence a
search starts at an end of the word and never turns: that to the right extends intervals of suffix ranks in the index
of the reversed vocabulary, that to the left in the index of the vocabulary itself.

The vocabulary is dealt twice: by the first three code points for searches to the right, by the last three for those
to the left (halves have three at least, as words have LEAST). A cell holds the words of many such keys, about CELL of them; a key
with more words is cut into blocks, and all its words search each block. So a task indexes about CELL words whatever
the vocabulary, and no pair is lost. A cell returns one row for each word with neighbours, not the pairs.

`word_counts` reads whole texts: null texts have no words, rows may repeat a doc_id (each counts), and a null doc_id
is written as an empty text. Ties between forms go to the smallest word in code-point order. Words without a near one have
null form and are their own root. Empty tables make empty results; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.shared import write_once

#: Code points of a word and of a key. Half a word holds a key.
LEAST = 6
KEY = LEAST // 2
#: Words that an index holds, about.
CELL = 16_384
#: Words that search at once.
_ASKING = 4096
#: Different words that a task counts before it passes them on.
_COUNTED = 200_000
#: A form has at least this multiple of the word's occurrences; so a chain of forms has at most log(2 ** 63) / log(5) < 28 steps.
TIMES = 5
_DOUBLINGS = 5

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)


def dropped_letter(doc_id: int | None, run: str) -> str:
    """One run in 199 loses a code point: by the crc32 of `<doc_id>:<run>`."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 199:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


def word_counts(docs: DataFrame, edit: Callable[[int | None, str], str] | None = None, at_least: int = 5) -> DataFrame:
    """word, n: maximal runs of letters, A-Z in lower case, of LEAST code points and `at_least` occurrences and more.

    `edit` makes a word of each run (of LEAST code points and more, so it may shorten runs but not lengthen them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for word, n in Counter(_RUN.findall(lower)).items():
                    if edit:
                        word = edit(doc_id, word)
                        if len(word) < LEAST:
                            continue
                    counts[word] += n
                if len(counts) >= _COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)


class SuffixRanks:
    """FM-index of distinct words over symbols from 1 on, each between delimiters (0), read from the end of each word.

    The text is a cycle: 0, the first word backwards, 0, the second, ... Its rotations are all different.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths + 1)
        self.starts = ends - lengths - 1
        n = int(ends[-1])
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[self.starts] = False
        # Position j of a word goes to place length - j after its delimiter.
        word = np.repeat(np.arange(len(lengths)), lengths)
        within = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text[self.starts[word] + lengths[word] - within] = symbols
        self.n = n
        self.order = _sorted_rotations(text)
        self.before = text[self.order - 1]
        # The symbols before the rotations in order, sorted stably: ranks in it are the steps of a search.
        self.ranked = np.sort(self.before * n + np.arange(n))
        self.n_symbols = int(text.max(initial=0)) + 1

    def step(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where an interval's bound goes when `symbol` is put before what is matched."""
        return np.searchsorted(self.ranked, symbol * self.n + rank)

    def word_at(self, rank: np.ndarray) -> np.ndarray:
        """The word whose delimiter a rotation starts with (the delimiter that precedes it in the text)."""
        return np.searchsorted(self.starts, self.order[rank], side="right") - 1


def _sorted_rotations(text: np.ndarray) -> np.ndarray:
    """Starts of a cycle's rotations in order, by doubling the compared length."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    compared = 1
    while True:
        key = rank.astype(np.int64) * (n + 1) + np.roll(rank, -compared)
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        if new[order[-1]] == n - 1 or compared >= n:
            return order
        rank, compared = new, 2 * compared


def one_error(index: SuffixRanks, symbols: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking word, indexed word) of all pairs that agree in the first `exact` symbols and have one error behind them.

    Symbols are in the order of the search. Each pair comes once: a repeated letter is deleted at the end of its
    run, and inserted there too.
    """
    first = np.cumsum(lengths) - lengths

    def symbol(word: np.ndarray, place: np.ndarray) -> np.ndarray:
        inside = place < lengths[word]
        return np.where(inside, symbols[np.where(inside, first[word] + place, 0)], 0) if len(symbols) else np.zeros(len(word), np.int64)

    def extended(word, place, low, high):
        s = symbol(word, place)
        low, high = index.step(s, low), index.step(s, high)
        there = low < high
        return word[there], place[there] + 1, low[there], high[there]

    def branches(low, high, wanted):
        """(state, low, high) for each symbol but the delimiter and the wanted one that can be put before."""
        size = high - low
        few = np.flatnonzero(size <= index.n_symbols)
        many = np.flatnonzero(size > index.n_symbols)
        counts = size[few]
        rows = np.repeat(low[few] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        pairs = np.unique(np.repeat(few, counts) * index.n_symbols + index.before[rows])
        state = np.concatenate([pairs // index.n_symbols, np.repeat(many, index.n_symbols)])
        s = np.concatenate([pairs % index.n_symbols, np.tile(np.arange(index.n_symbols), len(many))])
        used = (s > 0) & (s != wanted[state])
        state, s = state[used], s[used]
        new_low, new_high = index.step(s, low[state]), index.step(s, high[state])
        there = new_low < new_high
        return state[there], new_low[there], new_high[there]

    n = len(lengths)
    zeros = np.zeros(n, np.int64)
    good = np.arange(n), zeros, index.step(zeros, zeros), index.step(zeros, zeros + index.n)
    bad = tuple(np.zeros(0, np.int64) for _ in range(4))
    asking, found = [], []
    while len(good[0]) or len(bad[0]):
        # Words with an error go on without another one; past the closing delimiter a word is found.
        word, place, low, high = extended(*bad)
        closed = place > lengths[word]
        if closed.any():
            asking.append(word[closed])
            found.append(index.word_at(low[closed]))
        bad = tuple(x[~closed] for x in (word, place, low, high))

        word, place, low, high = good
        open_ = np.flatnonzero(place >= exact[word])
        if len(open_):
            w, p, lo, hi = (x[open_] for x in good)
            wanted = symbol(w, p)
            inside = p < lengths[w]
            last_of_run = inside & (wanted != symbol(w, p + 1))
            state, new_low, new_high = branches(lo, hi, wanted)
            replaced = inside[state]
            bad = tuple(np.concatenate(x) for x in zip(
                bad,
                (w[last_of_run], p[last_of_run] + 1, lo[last_of_run], hi[last_of_run]),
                (w[state], p[state], new_low, new_high),
                (w[state[replaced]], p[state[replaced]] + 1, new_low[replaced], new_high[replaced]),
            ))
        good = extended(word, place, low, high)
        inside = good[1] <= lengths[good[0]]
        good = tuple(x[inside] for x in good)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *asking]), np.concatenate([none, *found])


def neighbours(words: list[str], n: list[int], indexed: list[bool], backwards: bool) -> list[tuple[str, int, int, str]]:
    """(word, near words, n of the best one, best one) among the indexed words, for those with any.

    Forwards: pairs whose error lies behind the first half of the asking word. Backwards: those whose error lies
    before its second half, but for pairs that the other search finds.
    """
    ordered = [w[::-1] for w in words] if backwards else words
    points = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4") for w in ordered]
    lengths = np.array([len(p) for p in points], np.int64)
    held = [i for i, there in enumerate(indexed) if there]
    if not held:
        return []
    _, symbols = np.unique(np.concatenate(points), return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    ends = np.cumsum(lengths)
    kept = np.repeat(np.array(indexed, bool), lengths)
    index = SuffixRanks(symbols[kept], lengths[held])
    half = lengths // 2
    exact = lengths - half if backwards else half
    out: dict[int, tuple[int, int, str]] = {}
    for at in range(0, len(words), _ASKING):
        part = slice(at, at + _ASKING)
        begin = int(ends[at] - lengths[at])
        asking, found = one_error(index, symbols[begin : int(ends[min(at + _ASKING, len(words)) - 1])], lengths[part], exact[part])
        for i, j in zip((asking + at).tolist(), found.tolist()):
            other = held[j]
            if backwards and words[other].startswith(words[i][: len(words[i]) // 2]):
                continue
            count, best_n, best = out.get(i, (0, -1, ""))
            if n[other] > best_n or (n[other] == best_n and words[other] < best):
                best_n, best = n[other], words[other]
            out[i] = count + 1, best_n, best
    return [(words[i], *x) for i, x in out.items()]


def _cells(vocabulary: DataFrame, n_words: int) -> DataFrame:
    """cell, block, side, word, n, indexed: words with those that they may be near to."""
    n_cells = max(1, -(-n_words // CELL))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, KEY).alias("key")),
                    F.struct(F.lit(1).alias("side"), F.right(F.col("word"), F.lit(KEY)).alias("key")))
    dealt = vocabulary.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.side", "s.key")
    large = dealt.groupBy("side", "key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks")).filter("blocks > 1")
    # At most two rows for each CELL words.
    dealt = dealt.join(write_once(large, "large-keys"), ["side", "key"], "left")
    alone = F.col("blocks").isNotNull()
    cell = F.when(alone, F.concat(F.lit("key "), "key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(n_cells)).cast("string"))
    blocks = F.coalesce("blocks", F.lit(1))
    block = F.explode(F.sequence(F.lit(0), blocks - 1))
    return dealt.withColumn("cell", cell).withColumn("_blocks", blocks).withColumn("block", block).select(
        "cell", "block", "side", "word", "n",
        (F.col("block") == F.pmod(F.xxhash64("word"), F.col("_blocks"))).alias("indexed"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: for the words of (word, n) that have a near one. Words are distinct, LEAST long and more."""
    cells = _cells(vocabulary, vocabulary.count())
    rows = cells.repartition("side", "cell", "block").sortWithinPartitions("side", "cell", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            found = neighbours(words, n, indexed, bool(key[0]))
            columns = list(zip(*found)) or [[]] * 4
            kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n_near", "best_n", "best"])

        key, words, n, indexed = None, [], [], []
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for i, here in enumerate(zip(columns["side"], columns["cell"], columns["block"])):
                if here != key:
                    if words:
                        yield out()
                    key, words, n, indexed = here, [], [], []
                words.append(columns["word"][i])
                n.append(columns["n"][i])
                indexed.append(columns["indexed"][i])
        if words:
            yield out()

    found = rows.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): the end of each chain, by doubling its steps."""
    pointers = write_once(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(_DOUBLINGS):
        next_ = pointers.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = pointers.join(next_, "root", "left")
        moved = write_once(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        pointers = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return pointers


def variants(vocabulary: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of (word, n)."""
    vocabulary = write_once(vocabulary.select("word", "n"), "vocabulary")
    near = vocabulary.join(near_words(vocabulary), "word", "left")
    is_form = F.col("best_n") >= TIMES * F.col("n")
    near = write_once(near.select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "near-words")
    ends = roots(near.filter(F.col("form").isNotNull()).select("word", "form"))
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
