"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of each row of the narrow side in a join whose other side may hold a hot key.
SALTS = 8


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8: bytes.split() splits at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_held: dict[tuple, dict] = {}


def held(key: tuple, make: Callable[[], dict]) -> dict:
    """What this worker remembers under `key`; `make` starts it empty.

    A worker holds one such table at a time: workers serve job after job, and the tables of earlier operators would
    add up in memory.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function from batch to batch inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return df.mapInArrow(run, schema)


def join_hot(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner") -> DataFrame:
    """Equi-join where a key may hold a large part of `big` and one row at most of `small`.

    Rows of `big` are dealt over SALTS parts of their key by the number `spread`; `small` is repeated
    for each part. The result is that of the plain join.
    """
    dealt = big.withColumn("__salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")


#: Rows that one part of a key has, about, in join_counted.
PART = 100_000


def join_counted(big: DataFrame, small: DataFrame, key: str, rows: str, spread: Column) -> DataFrame:
    """Left equi-join with `small`, which has each key once and in `rows` the number of `big`'s rows that hold it.

    A key is dealt over as many parts as its rows need. The table of keys in several parts has at most one row for each
    PART rows of `big`.
    """
    parts = F.ceil(F.col(rows) / PART).cast("int")
    several = small.select(key, parts.alias("__parts")).filter("__parts > 1")
    salt = F.pmod(spread, F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = big.join(several, key, "left").withColumn("__salt", salt).drop("__parts")
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(rows)
    return dealt.join(repeated, [key, "__salt"], "left").drop("__salt")
