"""Quality rules as a short-circuit cascade.

A rule rejects a text. Its cost (seconds a text beyond the measures that every row has in the result) and selectivity
(share of texts it rejects) are estimated on a sample of SAMPLE rows with the smallest hash of doc_id; then the rule with the most rejections per cost comes first,
the next is chosen on what it leaves of the sample, and so on. Each text meets the rules in this order until one
rejects it. The order changes the time, never which texts are kept.

A null text has no words. Rows are judged one by one, so that repeated rows get equal results; a null doc_id stays
null. Other columns are not read. An empty table gives an empty result (rules in the given order).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.llm.common import map_batches, words

SAMPLE = 400

_BLANKS = " \t\n\x0b\x0c\r"
_NO_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_WINDOW = 5


class Text:
    """Measures of a whole text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return words(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(_NO_SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(_BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside five-word windows that the text holds more than once."""
        n = self.n_words
        if n <= _WINDOW:
            return 0
        numbers: dict[bytes, int] = {}
        word = np.array([numbers.setdefault(w, len(numbers)) for w in self.words], np.int64)
        # Equal windows get equal numbers, exactly: pairs, then pairs of pairs, then five words.
        _, two = np.unique(word[:-1] * len(numbers) + word[1:], return_inverse=True)
        _, four = np.unique(two[:-2] * n + two[2:], return_inverse=True)
        _, five, counts = np.unique(four[:-1] * n + word[4:], return_inverse=True, return_counts=True)
        repeated = np.flatnonzero(counts[five] > 1)
        if not len(repeated):
            return 0
        edges = np.zeros(n + 1, np.int64)
        edges[repeated] += 1
        edges[repeated + _WINDOW] -= 1
        return int(np.count_nonzero(np.cumsum(edges)))

    @cached_property
    def capitals(self) -> float:
        """Share of capitals among the letters that have a case."""
        upper = sum(map(str.isupper, self.text))
        return upper / max(1, upper + sum(map(str.islower, self.text)))

    @cached_property
    def marks(self) -> int:
        return self.text.count("!") + self.text.count("?")

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def n_broken_off(self) -> int:
        """Lines that end in an ellipsis."""
        return sum(line.rstrip(_BLANKS).endswith(("...", "\u2026")) for line in self.lines)

    def measures(self) -> tuple[int, ...]:
        """What the result holds of every text."""
        return self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


RULES = (
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("symbols", lambda t: 5 * t.n_symbols > t.n_words),
    Rule("capitals", lambda t: t.capitals > 0.6),
    Rule("marks", lambda t: 4 * t.marks > t.n_words),
    Rule("repeated_lines", lambda t: 3 * t.n_dup_lines > len(t.lines)),
    Rule("letters", lambda t: 4 * t.n_letters < t.word_chars),
    Rule("broken_off", lambda t: 10 * t.n_broken_off > 3 * len(t.lines)),
)


def base_failed(text: Text) -> bool:
    return text.n_words < 10 or 100 * text.n_repeat_words > 20 * text.n_words


def measure(rules: Sequence[Rule], texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Mean seconds that each rule adds to the measures which a text has anyway, and which texts it rejects."""
    cost = np.zeros(len(rules))
    rejected = np.zeros((len(rules), len(texts)), bool)
    for i, rule in enumerate(rules):
        fresh = [Text(t) for t in texts]
        for text in fresh:
            text.measures()
        begin = time.perf_counter()
        rejected[i] = [rule.rejects(t) for t in fresh]
        cost[i] = (time.perf_counter() - begin) / max(1, len(texts))
    return cost, rejected


def best_order(cost: np.ndarray, rejected: np.ndarray) -> list[int]:
    """Greedy: most rejections per cost among the texts that the earlier rules leave; ties: the given order."""
    left = np.ones(rejected.shape[1], bool)
    rest, order = list(range(len(cost))), []
    while rest:
        gain = [(rejected[i] & left).sum() / max(cost[i], 1e-9) for i in rest]
        best = rest[int(np.argmax(gain))] if max(gain) > 0 else min(rest, key=lambda i: cost[i])
        rest.remove(best)
        order.append(best)
        left &= ~rejected[best]
    return order


def sample_texts(docs: DataFrame) -> list[str | None]:
    """At most SAMPLE texts that pass the base rules."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # Only ids compete for the sample; the texts of those chosen alone reach the driver.
    ordered = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").limit(SAMPLE)
    return [t for _, t in ordered.collect() if not base_failed(Text(t))]


def ordered_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> list[Rule]:
    return [rules[i] for i in best_order(*measure(rules, sample_texts(docs)))]


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, rejected_by string, n_rules_met int"
)


def judge(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Measures and verdict of each row (see RESULT); `rules` in the order in which they are to be met."""
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string(), pa.int32()]
    names = [field.split()[0] for field in RESULT.split(", ")]

    def one(doc_id: int | None, raw: str | None) -> tuple:
        text = Text(raw)
        failed, by, met = base_failed(text), None, 0
        if not failed:
            for rule in rules:
                met += 1
                if rule.rejects(text):
                    by = rule.name
                    break
        return doc_id, *text.measures(), failed, not failed and by is None, "base" if failed else by, met

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(map(one, batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, RESULT)
