"""Secret scans over an incremental ledger of blobs.

Each text is a blob under the SHA-256 of its content. A ledger holds, for each blob, the (rule, version) pairs that
have been applied to it and what they found. A scan applies only pairs that the ledger lacks, once for equal
texts whatever number of rows hold them, appends what it did as one more table of the ledger, and joins findings back
to all rows. Only DataFrame functions are used.

A null text is empty. Rows may repeat an id; each gets the findings of its own text. Empty tables make empty results.
Extra columns are kept; `blob` and `findings` are replaced by the new ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetrank.llm.common import join_hot


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost, non-overlapping matches are taken; those with a shorter `group` are dropped."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    at_least: int = 1
    #: A group before the finding, which is no part of it.
    lead: int = 0
    #: A string that each match contains, in any case; texts without it are not scanned.
    needs: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, at_least=6),
    Rule("access", r"AKIA[A-Z0-9]+", at_least=20, needs="AKIA"),
    # Runs of these characters: only those of 24 and more are looked for, the others would be dropped.
    Rule("hex", r"[0-9a-f]{24,}"),
    # No repeated groups, and no start inside a run of the same characters: time grows with the text, whatever it holds.
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", version=2, needs="-----BEGIN"),
    Rule("jwt", r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", version=2, lead=1, needs="eyJ"),
)

#: rule is kind@version.
FINDING = "struct<rule:string,kind:string,start:int,end:int>"
LEDGER = f"blob string, applied array<string>, findings array<{FINDING}>"


_MATCH = "struct<rule:string,kind:string,at_least:int,place:int,own:int,before:int,tested:int,lead:int>"


def matches(text: Column, rule: Rule) -> Column:
    """The matches of a rule in order: lengths of each, of the text before it, and of its groups, in code points.

    The text between the matches is what the text splits into, so places follow from lengths.
    """
    pattern = F.lit(rule.pattern)
    own = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else own
    lead = F.regexp_extract_all(text, pattern, F.lit(rule.lead)) if rule.lead else F.transform(own, lambda _: F.lit(""))
    between = F.slice(F.split(text, rule.pattern, -1), 1, F.size(own))
    zipped = F.arrays_zip(own.alias("own"), between.alias("before"), tested.alias("tested"), lead.alias("lead"))

    def described(x: Column, place: Column) -> Column:
        return F.struct(
            F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.at_least).alias("at_least"),
            place.alias("place"), *[F.length(x[name]).alias(name) for name in ("own", "before", "tested", "lead")])

    there = F.regexp_like(text, pattern)
    if rule.needs:
        there = text.contains(rule.needs) & there
    return F.when(there, F.transform(zipped, described)).otherwise(F.array().cast(f"array<{_MATCH}>"))


def findings(unseen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, findings of (blob, text, applied): one row for each blob with any.

    Places are running sums over rows, so a text with millions of matches costs time in proportion and no large arrays
    but the last one.
    """
    none = F.array().cast(f"array<{_MATCH}>")
    found = [F.when(F.array_contains("applied", r.name), matches(F.col("text"), r)).otherwise(none) for r in rules]
    rows = unseen.select("blob", F.inline(F.concat(*found)))
    so_far = Window.partitionBy("blob", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("own")).over(so_far).cast("int")
    placed = rows.withColumn("end", end).filter("tested >= at_least")
    finding = F.struct("rule", "kind", (F.col("end") - F.col("own") + F.col("lead")).alias("start"), "end")
    return placed.groupBy("blob").agg(F.collect_list(finding).alias("findings"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All increments; empty if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(folder)


def scan(versions: DataFrame, ledger: str, increment: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings for all rows (any columns, with `text`), after the ledger was brought up to date.

    `increment` names the table that this scan adds to the ledger; an existing one is refused by the write.
    """
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(r.name) for r in rules])
    text = F.coalesce("text", F.lit(""))
    rows = versions.drop("blob", "findings").withColumn("blob", F.sha2(text, 256))
    done = read_ledger(spark, ledger)
    # Scans of one blob under more and more rules: as many rows as the rules had releases.
    seen = done.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("applied"))).alias("_seen"))
    unseen = rows.select("blob", text.alias("text")).dropDuplicates(["blob"]).join(seen, "blob", "left")
    todo = F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>")))
    unseen = unseen.select("blob", "text", todo.alias("applied")).filter(F.size("applied") > 0)
    none = F.array().cast(f"array<{FINDING}>")
    added = unseen.select("blob", "applied").join(findings(unseen, rules), "blob", "left").select(
        "blob", "applied", F.coalesce("findings", none).alias("findings"))
    added.write.parquet(f"{ledger.rstrip('/')}/{increment}")
    asked = F.filter("findings", lambda x: F.array_contains(wanted, x["rule"]))
    current = read_ledger(spark, ledger).withColumn("findings", asked).filter(F.size("findings") > 0)
    current = current.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    others = [c for c in rows.columns if c not in ("blob", "text")]
    joined = join_hot(rows, current, ["blob"], F.xxhash64(*others) if others else F.lit(0), "left")
    return joined.withColumn("findings", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")))
