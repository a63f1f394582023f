"""Texts to unit vectors."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrank.functions.vectors import MIN_NORM, checked_vector, l2_normalize
from facetrank.shared import released_shuffles

# Fixed value: texts per call of a model.
BATCH_SIZE = 64


#: Words that a worker remembers.
_REMEMBERED = 200_000
_WORD = re.compile(r"[^\W_]+")


class _Places(dict):
    """Word -> (bucket, sign) by its md5: the first 32 bits give the bucket, the next four the sign."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> tuple[int, int]:
        digest = hashlib.md5(word.encode()).digest()
        place = int.from_bytes(digest[:4], "big") % self.dim, -1 if digest[4] >> 4 & 1 else 1
        if len(self) < _REMEMBERED:
            self[word] = place
        return place


_places: dict[int, _Places] = {}


def _hashed(text: str | None, dim: int) -> list[tuple[int, int]]:
    known = _places.setdefault(dim, _Places(dim))
    return [known[word] for word in _WORD.findall((text or "").lower())]


class HashedEncoder:
    """Lexical encoder: words hashed to signed buckets, weighted by rarity, unit length.

    A bucket weighs ln((n + 1) / (m + 1)) if m of the n texts that the encoder is fitted on have a word in it. Index and requests
    must go through the same fitted encoder; `model_id` is made from its name, dimension and weights.
    """

    def __init__(self, weights: Sequence[float], name: str):
        self.weights = np.asarray(weights, "<f8")
        self.name = name
        self.dim = len(self.weights)
        # Fits on other texts weigh words otherwise: their vectors must not meet.
        self.model_id = f"{name}-{self.dim}-{hashlib.sha256(self.weights.tobytes()).hexdigest()[:16]}"

    @classmethod
    def fit(cls, texts: DataFrame, column: str, dim: int, model_id: str = "hashed") -> HashedEncoder:
        @F.arrow_udf("array<int>")
        def buckets(column: pa.Array) -> pa.Array:
            # Bucket dim stands for the text itself.
            return pa.array([[*{b for b, _ in _hashed(t, dim)}, dim] for t in column.to_pylist()], pa.list_(pa.int32()))

        # A row a bucket reaches the driver.
        with released_shuffles(texts.sparkSession):
            counts = texts.select(F.explode(buckets(column)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
            n = {row["bucket"]: row["n"] for row in counts.collect()}
        return cls([math.log((n.get(dim, 0) + 1) / (n.get(b, 0) + 1)) for b in range(dim)], model_id)

    def save(self, path: str) -> None:
        rows = [(self.name, b, float(w)) for b, w in enumerate(self.weights)]
        SparkSession.active().createDataFrame(rows, "name string, bucket int, weight double").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, path: str) -> HashedEncoder:
        rows = SparkSession.active().read.parquet(path).orderBy("bucket").collect()
        return cls([r["weight"] for r in rows], rows[0]["name"])

    def __call__(self, texts: DataFrame, column: str, output: str = "embedding") -> DataFrame:
        weights, dim = self.weights, self.dim

        @F.arrow_udf("array<float>")
        def encode(column: pa.Array) -> pa.Array:
            vectors = np.zeros((len(column), dim), np.float32)
            for i, text in enumerate(column.to_pylist()):
                found = _hashed(text, dim)
                if found:
                    places, signs = zip(*found)
                    vector = np.bincount(places, weights=signs, minlength=dim) * weights
                    vectors[i] = vector / max(math.sqrt(float(np.cumsum(vector * vector)[-1])), MIN_NORM)
            offsets = np.arange(0, vectors.size + 1, dim, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.reshape(-1)))

        return texts.select("*", encode(column).alias(output))


class ModelEncoder:
    """Any model: `make_predict` returns a function from an array of texts to a matrix of vectors.

    It is called once per Python worker, so a model is loaded once and fed batches of texts.
    """

    def __init__(
        self,
        make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
        model_id: str,
        dim: int,
        batch_size: int = BATCH_SIZE,
    ):
        self.model_id = model_id
        self.dim = dim
        self._predict = predict_batch_udf(
            make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
        )

    def __call__(self, texts: DataFrame, column: str, output: str = "embedding") -> DataFrame:
        raw = texts.withColumn("_raw", self._predict(F.coalesce(F.col(column), F.lit(""))))
        unit = l2_normalize(checked_vector(F.col("_raw"), self.dim)).cast("array<float>")
        return raw.withColumn(output, unit).drop("_raw")
