"""Languages by hierarchical discrimination: the family first, then one-versus-one separators within it.

A text is the square roots of its hashed byte n-gram counts (letters in lower case, all else a blank), at length 1. One linear support
vector machine a family separates it from the others; the family with the largest margin is taken. Within a family
each pair of languages has a linear support vector machine of its own, and the language with most votes is
taken (ties: larger sum of margins, then the smaller name). All are trained by stochastic subgradient steps in numpy, in one task, on at most
PER_LANGUAGE texts of each language, those with the smallest hashes of doc_id: a sample bounded in rows and in bytes, as a
text comes as BUCKETS numbers whatever its length. Whole texts are read, in training as well.

A language that FAMILIES doesn't name is a family of its own. Null languages, and texts that are null or have no letter,
are not learned from; such texts get `und` and a score of 0. Without learned languages every text does. Equal texts
get equal results, a null doc_id is as any other, rows may repeat. Other columns are not read. A learned language
may have any name.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetrank.llm.common import map_batches

#: Texts of a language that are learned from, at most.
PER_LANGUAGE = 400
#: Parts of a language that are ranked by themselves first.
PARTS = 64
BUCKETS = 4096
GRAMS = (1, 2, 3, 4)
EPOCHS = 12
#: Weight of the separators' lengths against their errors.
DECAY = 1e-3
#: Bytes that are hashed at once.
_CHUNK = 1 << 20
_MULTIPLIER = np.uint32(0x01000193)
_ODD = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)

#: Closely related languages (fixed values: ISO 639-1 codes by family).
FAMILIES: Mapping[str, Sequence[str]] = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
UNKNOWN = "und"


def family_of(language: str, families: Mapping[str, Sequence[str]] = FAMILIES) -> str:
    return next((name for name, held in families.items() if language in held), f"only {language}")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


_BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def profile(text: str) -> np.ndarray:
    """Square roots of the hashed n-gram counts, at length 1."""
    raw = b" ".join([b"", *text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split(), b""])
    counts = np.zeros(BUCKETS, np.int64)
    overlap = max(GRAMS) - 1
    for at in range(0, max(1, len(raw) - overlap), _CHUNK):
        part = np.frombuffer(raw, np.uint8, min(_CHUNK + overlap, len(raw) - at), at).astype(np.uint32)
        gram = part
        for n in range(1, max(GRAMS) + 1):
            if n > 1:
                if len(part) < n:
                    break
                gram = gram[:-1] * _MULTIPLIER + part[n - 1 :]
            if n in GRAMS:
                # Grams that begin in the overlap belong to the next part.
                own = gram if at + _CHUNK + overlap >= len(raw) else gram[:_CHUNK]
                counts += np.bincount(((own + np.uint32(n)) * _ODD) >> _SHIFT, minlength=BUCKETS)
    found = np.sqrt(counts, dtype=np.float32)
    length = float(np.linalg.norm(found))
    return found / length if length else found


def separator(rows: np.ndarray, signs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A linear support vector machine with the constant as the last weight; both signs weigh alike."""
    rows = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    weight_of = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum())) * len(rows)
    w, mean = np.zeros(rows.shape[1]), np.zeros(rows.shape[1])
    step, taken = 0, 0
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            step += 1
            rate = 1 / (DECAY * (step + 1 / DECAY))
            wrong = signs[i] * (rows[i] @ w) < 1
            w *= 1 - rate * DECAY
            if wrong:
                w += rate * signs[i] * weight_of[i] * rows[i]
            if epoch >= EPOCHS // 2:
                mean += w
                taken += 1
    return mean / max(1, taken)


@dataclass
class Model:
    """`weights`: one column a family, then one for each pair of languages of a family; the last row is the constant."""

    families: list[str]
    pairs: list[tuple[str, str]]
    members: dict[str, list[str]]
    weights: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        margins = profile(text) @ self.weights[:-1] + self.weights[-1]
        of_families = margins[: len(self.families)]
        best = int(np.argmax(of_families))
        chance = np.exp(2 * (of_families - of_families[best]))
        score = float(1 / chance.sum())
        members = self.members[self.families[best]]
        if len(members) == 1:
            return members[0], score
        votes = {m: [0, 0.0, 0.0] for m in members}
        for (a, b), margin in zip(self.pairs, margins[len(self.families) :]):
            if a in votes:
                for language, m in ((a, float(margin)), (b, -float(margin))):
                    held = votes[language]
                    held[0] += m > 0 or (m == 0 and language == a)
                    held[1] += m
                    held[2] += 1 / (1 + np.exp(-min(max(2 * m, -50), 50)))
        language = min(members, key=lambda m: (-votes[m][0], -votes[m][1], m))
        return language, float(score * votes[language][2] / (len(members) - 1))


def train(profiles: np.ndarray, languages: Sequence[str], families: Mapping[str, Sequence[str]] = FAMILIES, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    found = sorted(set(languages))
    members: dict[str, list[str]] = {}
    for language in found:
        members.setdefault(family_of(language, families), []).append(language)
    names = sorted(members)
    language = np.array(languages, dtype=object)
    family = np.array([family_of(x, families) for x in languages], dtype=object)
    columns = [separator(profiles, np.where(family == name, 1, -1), rng) if len(names) > 1 else np.zeros(BUCKETS + 1)
               for name in names]
    pairs = [(a, b) for name in names for i, a in enumerate(members[name]) for b in members[name][i + 1 :]]
    for a, b in pairs:
        used = (language == a) | (language == b)
        columns.append(separator(profiles[used], np.where(language[used] == a, 1, -1), rng))
    weights = np.array(columns, np.float32).T if columns else np.zeros((BUCKETS + 1, 0), np.float32)
    return Model(names, pairs, members, weights)


def learned_rows(docs: DataFrame, language: str) -> DataFrame:
    """language, doc_id, text: at most PER_LANGUAGE of each."""
    rows = docs.filter(F.col(language).isNotNull() & F.col("text").rlike("\\p{L}")).select(
        F.col(language).cast("string").alias("language"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Ids are ranked without the texts; rows of one id are chosen by a digest of the text.
    order = ["_hash", "doc_id", "_digest"]
    part = F.pmod("_hash", F.lit(PARTS)).alias("_part")
    rows = rows.withColumn("_hash", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)))).withColumn("_digest", F.md5("text"))
    chosen = rows.select("language", "doc_id", "_hash", "_digest", part).distinct()
    # The first of each part, then the first of these: no task ranks more than PARTS * PER_LANGUAGE rows.
    for keys in (["language", "_part"], ["language"]):
        ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        chosen = chosen.withColumn("_rank", ranked).filter(F.col("_rank") <= PER_LANGUAGE)
    chosen = chosen.select(
        F.col("language").alias("_language"), F.col("_hash").alias("_chosen"), F.col("_digest").alias("_of"))
    same = (F.col("language") == F.col("_language")) & (F.col("_hash") == F.col("_chosen")) & (F.col("_digest") == F.col("_of"))
    return rows.join(F.broadcast(chosen), same).dropDuplicates(["language", "_hash", "_digest"]).select("language", "doc_id", "text")


def fit(docs: DataFrame, language: str = "lang", families: Mapping[str, Sequence[str]] = FAMILIES, seed: int = 0) -> Model:
    """Learn from the rows given; filter them first to hold rows out. Only the weights reach the driver."""

    def profiled(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [profile(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["language", "doc_id", "found"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, rows = [], []
        for batch in batches:
            languages += batch.column(0).to_pylist()
            rows += [np.frombuffer(x, np.float16) for x in batch.column(2).to_pylist()]
        model = train(np.array(rows, np.float32).reshape(-1, BUCKETS), languages, families, seed)
        out = io.BytesIO()
        np.save(out, model.weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([out.getvalue()], pa.binary()), pa.array([sorted(set(languages))], pa.list_(pa.string()))], ["weights", "languages"])

    rows = map_batches(learned_rows(docs, language).select("language", "text", "doc_id"), profiled, "language string, doc_id long, found binary")
    # The sample is bounded: one task trains on it.
    one = rows.repartition(1).sortWithinPartitions("language", "doc_id", "found").mapInArrow(learned, "weights binary, languages array<string>")
    found = one.first()
    if found is None:
        return train(np.zeros((0, BUCKETS), np.float32), [], families)
    shape = train(np.zeros((0, BUCKETS), np.float32), [], families)
    members: dict[str, list[str]] = {}
    for name in found["languages"]:
        members.setdefault(family_of(name, families), []).append(name)
    names = sorted(members)
    pairs = [(a, b) for name in names for i, a in enumerate(members[name]) for b in members[name][i + 1 :]]
    return Model(names, pairs, members, np.load(io.BytesIO(bytes(found["weights"]))) if names else shape.weights)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sent.value.predict(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
            ["doc_id", "lang_pred", "score"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(read, run, "doc_id long, lang_pred string, score double")
