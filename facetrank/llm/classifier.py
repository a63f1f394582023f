"""Quality classifier by supervised subword embeddings.

A word stands for its own hashed vector and those of its character n-grams, and each pair of equal neighbours for
one more vector, counted TWICE_PARTS times. A document is the mean of all these, and a softmax layer turns it into
the chances of both labels. Vectors and layer are learned by stochastic gradient descent in numpy, in one task, on at most
LABELLED rows: those with the smallest hash of doc_id among the labelled ones that may be learned from. That task gets
counts of at most BUCKETS parts a row, not texts; the driver gets the weights alone. Scores
need no label; whole texts are read, in training as well.

As the score's argument is linear in the mean, a word counts by two numbers: what its parts add to it and how many
parts it has. Empty and null texts get the layer's constant alone. Labels other than 0 and 1, and null ones, are
not learned from; a doc_id that is labelled twice is learned from with each distinct label. Without two
different labels all scores are the share of label 1 (0.5 without labels). Repeated rows get equal scores, and a
null doc_id is scored as any other. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.llm.common import held, map_batches, words

#: Labelled rows that the classifier is fitted on, at most.
LABELLED = 1500
BUCKETS = 1 << 17
DIM = 12
GRAMS = (3, 4, 5)
EPOCHS = 5
RATE = 0.4
#: Words that a worker remembers (about 150 bytes each); further ones are computed each time they come.
REMEMBERED = 800_000
#: Words whose parts a task remembers in training.
KNOWN = 50_000


def parts(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks for both ends."""
    text = f"<{word.decode('utf-8', 'replace')}>"
    found = [text] + [text[i : i + n] for n in GRAMS for i in range(len(text) - n + 1) if len(text) > n]
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in found]


#: The vector of two equal neighbouring words, and how often it counts for such a pair.
TWICE = xxhash.xxh32_intdigest("<> <>") % BUCKETS
TWICE_PARTS = 20


def pairs(found: list[bytes]) -> int:
    """Words that equal the one before."""
    return sum(map(eq, found, found[1:]))


class _Words(dict):
    """Word -> (what it adds to the score's argument) + i (number of its parts)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> complex:
        found = parts(word)
        value = complex(float(self.model.weight[found].sum()), len(found))
        if len(self) < REMEMBERED:
            self[word] = value
        return value


_COUNTED = "doc_id long, _label int, _digest string, buckets binary, shares binary"
_COUNTED_NAMES = [f.split()[0] for f in _COUNTED.split(", ")]


@dataclass
class Model:
    """`weight`: the layer's difference of both labels applied to each bucket's vector; `constant`: the same for none."""

    weight: np.ndarray
    constant: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, text: str | None) -> float:
        known = held(("words of a model", self.name), lambda: _Words(self))
        found = words(text)
        twice = TWICE_PARTS * pairs(found)
        total = sum(map(known.__getitem__, found), complex(twice * float(self.weight[TWICE]), twice))
        argument = self.constant + (total.real / total.imag if total.imag else 0.0)
        return 1 / (1 + math.exp(-argument)) if argument > -700 else 0.0


class _Parts(dict):
    def __missing__(self, word: bytes) -> np.ndarray:
        value = np.array(parts(word), np.int32)
        if len(self) < KNOWN:
            self[word] = value
        return value


def part_counts(text: str | None, known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text in ascending order, and the share of each."""
    found = words(text)
    counts = np.zeros(BUCKETS, np.float32)
    counts[TWICE] += TWICE_PARTS * pairs(found)
    for word, n in Counter(found).items():
        np.add.at(counts, known[word], n)
    buckets = np.flatnonzero(counts).astype(np.int32)
    return buckets, counts[buckets] / max(1, counts.sum())


def train(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    """Label 1 against label 0."""
    known = _Parts()
    return learn([part_counts(t, known) for t in texts], labels, seed)


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 0) -> Model:
    """From the `part_counts` of texts."""
    labels = np.asarray(labels, int)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 30.0 * (2 * share - 1))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    steps, total = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - steps / total)
            steps += 1
            buckets, part = rows[i]
            mean = part @ vectors[buckets] if len(buckets) else np.zeros(DIM, np.float32)
            scores = layer @ mean + bias
            chance = np.exp(scores - scores.max())
            chance /= chance.sum()
            chance[labels[i]] -= 1
            step = rate * chance
            # The mean has small parts: each is moved by its share, scaled so that rare ones learn too.
            vectors[buckets] -= np.outer(part * math.sqrt(len(buckets) + 1), step @ layer)
            layer -= np.outer(step, mean)
            bias -= step
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """At most LABELLED rows of text and label."""
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    chosen = chosen.filter(F.col("_label").isin(0, 1)).distinct()
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(LABELLED)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 0) -> Model:
    """Learn from the labels given; filter them first to hold rows out."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Parts()
        for batch in batches:
            found = [part_counts(t, known) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([b.tobytes() for b, _ in found], pa.binary()),
                 pa.array([n.tobytes() for _, n in found], pa.binary())], _COUNTED_NAMES)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known_labels = [], []
        for batch in batches:
            known_labels += batch.column(1).to_pylist()
            rows += [(np.frombuffer(b, np.int32), np.frombuffer(n, np.float32))
                     for b, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        model = learn(rows, known_labels, seed)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weight.astype(np.float32).tobytes()], pa.binary()), pa.array([model.constant], pa.float64())],
            ["weight", "constant"])

    rows = labelled_rows(docs, labels, label).select("doc_id", "_label", F.md5("text").alias("_digest"), "text")
    # Rows may repeat a doc_id: LABELLED of them at most are learned from.
    rows = rows.mapInArrow(counted, _COUNTED).orderBy("doc_id", "_label", "_digest").limit(LABELLED)
    found = rows.repartition(1).sortWithinPartitions("doc_id", "_label", "_digest").mapInArrow(
        learned, "weight binary, constant double").first()
    if found is None:
        return learn([], [], seed)
    return Model(np.frombuffer(bytes(found["weight"]), np.float32), found["constant"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of docs, with `score` (which replaces a column of that name)."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [sent.value.score(t) for t in batch.column(names.index("text")).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, f"{kinds}, score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")
