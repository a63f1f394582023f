"""Registered queries of the operators in this package, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.llm import (
    ann, classifier, conversation_trie, language, line_dedup, mixing, near_dup, packing, quality_rules, secrets, spelling,
    token_files, warc,
)
from facetrank.shared import scratch_path

NEIGHBOURS = 20
END_OF_TEXT = 2
PACK_END = 0
SEQUENCE = 1024


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str = "doc_id", divisor: int = 3):
    """crc32 of an id as text, modulo the divisor."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def ids_crc32(ids: str = "ids"):
    return F.crc32(ids)


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, NEIGHBOURS)


def op2_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs, quality_rules.ordered_rules(docs))
    return judged.drop("rejected_by", "n_rules_met")


def op3_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_packages(table(spark, sf_dir, "pages"))
    return warc.read_records(spark, packages).drop("payload", "url")


def op4_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op5_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = classifier.fit(docs, labels.filter(remainder() != 1))
    scored = classifier.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", "n_lines", "n_dropped", F.concat_ws(",", F.col("dropped").cast("array<string>")).alias("dropped"))


def op8_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary(), END_OF_TEXT)
    return token_files.read_tokens(spark, manifest).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), ids_crc32().alias("ids_crc32"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, vocabulary(), PACK_END, SEQUENCE)
    return pieces.withColumn("ids_crc32", ids_crc32()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


BASE_KINDS = ("assign", "access", "hex")


def op10_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments of one ledger: texts that the first one scanned are not scanned again."""
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "ledger")
    secrets.scan(docs.filter("doc_id % 2 = 0"), ledger, uuid.uuid4().hex)
    found = secrets.scan(docs, ledger, uuid.uuid4().hex)
    kinds = F.array(*[F.lit(r.kind) for r in secrets.RULES])
    ordered = F.sort_array(F.transform("findings", lambda x: F.struct(
        x["start"].alias("start"), F.array_position(kinds, x["kind"]).alias("place"), x["kind"].alias("kind"),
        x["end"].alias("end"))))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def base(x):
        return x["kind"].isin(*BASE_KINDS)

    def count(kind):
        return F.size(F.filter("_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found.withColumn("_spans", ordered).select(
        "doc_id", *counts, F.sha2(joined(F.filter("_spans", base)), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
    )


#: Conversations of a block share the first turns of its first one, HEADS - 1 at most.
BLOCK_OF_CONVERSATIONS = 100
HEADS = 6


def op11_truncation_peeling(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.turns_in_order(table(spark, sf_dir, "conversations"))
    head = remainder("conv_id", HEADS).cast("int")
    rebuilt = conversation_trie.with_shared_heads(turns, BLOCK_OF_CONVERSATIONS, head, HEADS - 1)
    nodes = conversation_trie.prefix_trie(conversation_trie.sequences(rebuilt))
    return nodes.withColumn("ends_sha256", F.lower(F.hex("ends"))).drop("ends")


def op12_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), spelling.dropped_letter))


def op13_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(divisor=4) == 2, F.lit(False))
    found = language.predicted(docs, language.fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cross_polytope, op2_rule_cascade, op3_zip_warc, op4_minhash_hamming, op5_subword_classifier,
        op6_poisson_mixture, op7_line_alignment, op8_rans_tokens, op9_sum_of_squares, op10_blob_ledger,
        op11_truncation_peeling, op12_fm_index, op13_family_svm,
    )
}
