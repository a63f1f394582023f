"""Mix sources to target weights by Poisson replication.

A source gets the weight of its amount to the power of `temperature`; its target amount is that share of
`epochs` times the whole. The mean repetition rate of a source is target over amount. Each document draws its
number of copies by inverting the Poisson distribution of that mean at a number in [0, 1) made from a hash of seed,
doc_id and text; the copies are then shuffled globally by a hash. Only DataFrame functions are used.
The distribution is written down as shares of its own sum, from 12 standard deviations below the mean to 12 above, so
that one draw inverts any rate; what lies outside has a chance below the steps of the hash.

Null sources are a source of their own. The amount of a document is the length of its text and 1 at least (null:
1). Rows that repeat doc_id and text draw the same number each; a null doc_id is hashed as an empty string. Columns
are kept whatever their names, except that `copy` and `shuffle_key` are replaced by the new ones and that
names may not begin with two underscores. An empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.llm.common import SALTS
from facetrank.shared import write_once

#: Sources up to which their table of rates is sent to all tasks (about 1 KB each). More are joined with salted keys.
SENT_SOURCES = 2000

#: Hexadecimal digits of a hash that make a number in [0, 1).
_DIGITS = 12


def source_rates(docs: DataFrame, source: str, temperature: float, epochs: float) -> DataFrame:
    """__source, rate: one row for each source, null as well."""
    size = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    amounts = docs.groupBy(F.col(source).alias("__source")).agg(F.sum(size).cast("double").alias("_amount"))
    amounts = write_once(amounts, "source-amounts")
    wanted = F.pow("_amount", F.lit(float(temperature)))
    all_wanted, everything = amounts.agg(F.sum(wanted), F.sum("_amount")).first()
    target = wanted / F.lit(all_wanted) * F.lit(everything) * F.lit(float(epochs))
    return amounts.select("__source", (target / F.col("_amount")).alias("rate"))


def lowest(rate: Column) -> Column:
    """A number of copies below which the chance is less than the hash's steps."""
    return F.greatest(F.floor(rate - 12 * F.sqrt(rate) - 12), F.lit(0)).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """P(at most lowest(rate) copies), P(at most one more), ... as an array whose last entry is 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 12).cast("int")

    def step(so_far: Column, k: Column) -> Column:
        term = so_far["term"] * rate / k
        total = so_far["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(so_far["sums"], F.array(total)).alias("sums"))

    # Terms as multiples of the first one, which are in range at any rate: e**240 at most.
    one = F.lit(1.0)
    start = F.struct(one.alias("term"), one.alias("total"), F.array(one).alias("sums"))
    return F.aggregate(F.sequence(lowest(rate) + 1, last), start, step,
                       lambda x: F.transform(x["sums"], lambda total: total / x["total"]))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, _DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def mix(docs: DataFrame, source: str = "source", temperature: float = 0.7, epochs: float = 1.0,
        seed: str = "mix") -> DataFrame:
    """All columns of each copy, with `copy` (from 0) and `shuffle_key`; rows come in the order of the shuffle."""
    rates = source_rates(docs, source, temperature, epochs)
    rate = F.col("rate")
    tables = rates.select("__source", lowest(rate).alias("__lowest"), poisson_cdf(rate).alias("__cdf"))
    tables = write_once(tables, "source-rates")
    doc_id, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    drawn = uniform(F.lit(seed), doc_id, F.md5(text))
    if tables.count() <= SENT_SOURCES:
        big, small, salted = docs, F.broadcast(tables), F.lit(True)
    else:
        big = docs.withColumn("__part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        small = tables.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = F.col("__part") == F.col("__salt")
    joined = big.join(small, F.col(source).eqNullSafe(F.col("__source")) & salted)
    copies = F.col("__lowest") + F.size(F.filter("__cdf", lambda below: below <= drawn))
    out = joined.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), doc_id, F.md5(text), F.col("copy").cast("string")))
    out = out.drop("__source", "__cdf", "__lowest", "__part", "__salt").withColumn("shuffle_key", key)
    # Digests are spread evenly: equal ranges of their first digits need no sample of the rows.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring(F.col("shuffle_key"), 1, 7), 16, 10).cast("long") * n / F.lit(16**7)).cast("int")
    return out.repartitionById(n, part).sortWithinPartitions("shuffle_key")


def mix_sql(documents: str, source: str = "source", temperature: float = 0.7, epochs: float = 1.0,
            seed: str = "mix") -> str:
    """DuckDB SQL of the same rows, for a table or a bracketed query."""
    return f"""
    WITH RECURSIVE docs AS (SELECT * FROM {documents}),
    amounts AS (SELECT {source} AS s, sum(greatest(coalesce(length(text), 0), 1))::DOUBLE AS amount FROM docs GROUP BY 1),
    rates AS (SELECT s, pow(amount, {temperature}) / sum(pow(amount, {temperature})) OVER ()
                     * sum(amount) OVER () * {epochs} / amount AS rate FROM amounts),
    steps AS (SELECT s, rate, greatest(floor(rate - 12 * sqrt(rate) - 12), 0)::INTEGER AS k, 1.0::DOUBLE AS term, 1.0::DOUBLE AS total FROM rates
              UNION ALL
              SELECT s, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM steps
              WHERE k < ceil(rate + 12 * sqrt(rate) + 12)),
    chances AS (SELECT s, k, total / max(total) OVER (PARTITION BY s) AS below FROM steps
                UNION ALL
                SELECT s, unnest(range(min(k)))::INTEGER, 0.0::DOUBLE FROM steps GROUP BY s),
    drawn AS (SELECT *, ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, {_DIGITS}))::BIGINT::DOUBLE
                        / {16**_DIGITS}::DOUBLE AS u FROM docs),
    counted AS (SELECT d.doc_id, d.text, d.lang, d.{source}, d.n_chars, s.k AS copy
                FROM drawn d JOIN chances s ON d.{source} IS NOT DISTINCT FROM s.s AND s.below <= d.u)
    SELECT *, md5('{seed}|order|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) || '|' || copy::VARCHAR) AS shuffle_key
    FROM counted"""
