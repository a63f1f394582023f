"""Conversation tries, spelling variants and languages against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import CLASHING, SF
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tests_llm_rows import LONG, ODD

from facetrank.llm import conversation_trie, language, spelling
from facetrank.llm.common import join_counted
from facetrank.llm.queries import QUERIES

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in (*CLASHING, "depth", "n")],
])


@pytest.fixture
def conversations(spark, tmp_path):
    """A folder with a table of (conv_id, turn, role, text)."""
    def build(rows):
        full = [(*r, *("x",) * (len(CLASHING) + 2)) for r in rows]
        spark.createDataFrame(full, TURNS).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        return str(tmp_path)

    return build


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    told = {c: [t for _, _, t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    for c, mine in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt = told.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:]  # -7 % 100 is -7 in SQL
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append((c, d == len(rebuilt)))
    children, leaves, saved = Counter(), Counter(), Counter()
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, held in members.items():
        own_saving = (len(held) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += own_saving
    out = []
    for k, held in members.items():
        parent = min(c for c, _ in members[k[:-1]]) if k else None
        ends = ",".join(str(c) for c in sorted(c for c, last in held if last))
        out.append((min(c for c, _ in held), len(k), parent, len(held), children[k], leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, folder):
    df = QUERIES["op11_truncation_peeling"](spark, folder)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=str)


def random_conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 420), n):
        for turn in range(rng.randrange(1, longest)):
            text = rng.choice(["a", "bb", "", None, "ünï"]) if turn < 3 or rng.random() < 0.6 else f"t{rng.randrange(50)}"
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize("seed, longest, band", [(1, 7, 16), (2, 9, 2), (3, 40, 4)])
def test_trie_equals_plain_version(spark, conversations, monkeypatch, seed, longest, band):
    monkeypatch.setattr(conversation_trie, "BAND", band)
    monkeypatch.setattr(conversation_trie, "IDS", 3)
    rows = random_conversations(seed, 60, longest)
    assert trie(spark, conversations(rows)) == plain_trie(rows)


def test_trie_of_copies_and_odd_rows(spark, conversations, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BAND", 3)
    monkeypatch.setattr(conversation_trie, "IDS", 7)
    same = [(1000 + i, t, "user", f"same {t}") for i in range(130) for t in range(9)]
    odd = [(None, 0, "user", "x"), (None, None, None, None), (-7, 0, None, None), (-7, 0, None, None), (-100, 1, "a", "b"),
           (5, None, "r", "first"), (5, -3, "r", "second"), (9, 1, "r", LONG), (9, 1, "r", LONG), (11, 2, "user", "")]
    long_one = [(77, t, "user", f"{t % 5}") for t in range(60)]
    rows = same + odd + long_one
    assert trie(spark, conversations(rows)) == plain_trie(rows)
    # Rebuilt conversations without turns are members of the root.
    short = [(c, 0, "user", "x") for c in range(1, 40)]
    assert trie(spark, conversations(short)) == plain_trie(short)


def test_conversation_that_ends_where_a_longer_one_is_tested(spark, conversations, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BAND", 3)
    rows = [(c, t, "user", f"turn {t}") for c, last in ((101, 9), (7, 3), (350, 6), (8, 6)) for t in range(last)]
    assert trie(spark, conversations(rows)) == plain_trie(rows)


def test_trie_of_nothing(spark, conversations):
    assert trie(spark, conversations([])) == []
    assert trie(spark, conversations([(None, 1, "a", "b")])) == []


def test_lone_conversations_are_stripped_at_once(spark, conversations):
    """A conversation of 400 turns that shares its first 5: rounds follow from what is shared."""
    rows = [(c, t, "user", f"{c if t > 4 else 0} {t}") for c, last in ((200, 400), (201, 8), (350, 300)) for t in range(last)]
    found = conversation_trie.sequences(conversation_trie.turns_in_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    entered = conversation_trie.lone_tails(conversation_trie.ended(found))
    assert {r.conv_id: r["last"] for r in entered.collect()} == {200: 16, 201: 8, 350: 16}
    assert trie(spark, conversations(rows)) == plain_trie(rows)


def test_joins_by_counted_parts(spark, monkeypatch):
    from facetrank.llm import common

    monkeypatch.setattr(common, "PART", 10)
    big = spark.createDataFrame([(i, "hot" if i < 95 else f"k{i}") for i in range(120)] + [(500, None)], "i long, k string")
    small = big.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("rows")).withColumn("v", F.concat("k", F.lit("!")))
    small = small.filter("k <> 'k119'")
    got = join_counted(big, small, "k", "rows", F.xxhash64("i"))
    assert {(r.i, r.k, r.v) for r in got.collect()} == {
        (r.i, r.k, r.v) for r in big.join(small.drop("rows"), "k", "left").collect()}
    assert got.count() == 121


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def random_words(seed, size, letters):
    rng = random.Random(seed)
    words = {}
    while len(words) < size:
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 11)))
        words[word] = 5 * 6 ** rng.randrange(4) + rng.randrange(3)
        for _ in range(rng.randrange(4)):  # words near to it, and near to these
            i, c = rng.randrange(len(word)), rng.choice(letters)
            word = rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word + c, c + word])
            if len(word) >= 6:
                words[word] = 5 * 6 ** rng.randrange(4) + rng.randrange(3)
    return words


@pytest.mark.parametrize("seed, size, letters, cell", [
    (1, 150, "abé", 16_384), (2, 250, "ab", 20), (3, 250, "abcdeé", 30), (4, 60, "aaaab", 7), (5, 300, "aÿ", 16_384)])
def test_variants_equal_plain_version(spark, monkeypatch, seed, size, letters, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "_ASKING", 11)
    words = random_words(seed, size, letters)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(table).collect()}
    assert got == plain_variants(words)


def test_each_pair_is_found_once_by_one_search():
    words = sorted(random_words(9, 120, "abc"))
    n = [1] * len(words)
    every = [True] * len(words)
    forwards = {w: c for w, c, *_ in spelling.neighbours(words, n, every, False)}
    backwards = {w: c for w, c, *_ in spelling.neighbours(words, n, every, True)}
    for w in words:
        near = [x for x in words if one_apart(w, x)]
        behind = [x for x in near if x.startswith(w[: len(w) // 2])]
        assert forwards.get(w, 0) == len(behind)
        assert backwards.get(w, 0) == len(near) - len(behind)


def test_ranks_of_suffixes():
    words = [np.array(w) for w in ([1, 2, 1], [1, 1], [2], [1, 2, 1, 2])]
    index = spelling.SuffixRanks(np.concatenate(words), np.array([len(w) for w in words]))
    text = [0]
    for w in words:
        text += [*w[::-1], 0]
    text = text[:-1]
    turned = sorted(range(len(text)), key=lambda i: text[i:] + text[:i])
    assert index.order.tolist() == turned


def test_chain_of_forms(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(27)] + [("x", "w026"), ("y", "z")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{i:03d}": "w027" for i in range(27)}, "x": "w027", "y": "z"}


def plain_counts(rows, at_least):
    counts = Counter()
    letters = {chr(i) for i in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}
    for doc_id, text in rows:
        for run in "".join(c if c in letters else " " for c in text or "").split(" "):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= at_least}


def test_words_of_whole_texts(documents):
    rng = random.Random(4)
    made = ["".join(rng.choice("abÄé÷×ſZ") for _ in range(rng.randrange(4, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(made) for _ in range(200)) + "\n-Éclair2Éclair_ABCDEF") for i in range(80)]
    rows += ODD + [(90, "abcdefgh" * 30_000), (90, "abcdefgh" * 30_000)]
    for at_least in (1, 5):
        got = {r.word: r.n for r in spelling.word_counts(documents(rows), spelling.dropped_letter, at_least).collect()}
        assert got == plain_counts(rows, at_least)


def test_long_words_and_empty_tables(spark, documents):
    long = "abcdefghijklmnop" * 2500
    words = {long: 5, long[:-1]: 30, "z" + long: 7, "a" * 3000: 5, "a" * 3001: 25, "short é": 9}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(
        spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == plain_variants(words)
    empty = spelling.variants(spelling.word_counts(documents([]), spelling.dropped_letter))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert empty.count() == 0
    assert spelling.variants(spelling.word_counts(documents(ODD))).filter("form is not null").count() == 0


def test_languages_of_held_out_rows(spark):
    found = QUERIES["op13_family_svm"](spark, SF.replace("0.001", "0.01"))
    rows = found.join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def plain_profile(text):
    raw = " ".join("".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).split())
    raw = f" {raw} ".encode() if raw else b" "
    counts = np.zeros(language.BUCKETS)
    for n in language.GRAMS:
        for i in range(len(raw) - n + 1):
            h = 0
            for b in raw[i : i + n]:
                h = (h * 0x01000193 + b) % 2**32
            counts[((h + n) * 0x9E3779B1) % 2**32 >> 20] += 1
    root = np.sqrt(counts)
    return root / (np.linalg.norm(root) or 1)


@pytest.mark.parametrize("text", ["", "a", "Ab, É1 x\n\n日本", "words of a text " * 40, "x" * 700])
@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_profile_equals_plain_version(monkeypatch, text, chunk):
    monkeypatch.setattr(language, "_CHUNK", chunk)
    assert np.allclose(language.profile(text), plain_profile(text), atol=1e-6)


def test_separator_separates():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 8)).astype(np.float32)
    signs = np.where(rows[:, 0] - 2 * rows[:, 1] > 0.5, 1, -1)
    w = language.separator(rows, signs, rng)
    assert np.mean(np.sign(rows @ w[:-1] + w[-1]) == signs) > 0.95


def labelled(spark, rows):
    """(doc_id, text, lang), with columns that bear the operator's own names."""
    schema = "doc_id long, text string, lang string, language string, score string, _rank string, lang_pred string"
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)


def test_pairs_within_families_and_lone_languages(spark):
    texts = {"en": "the of and is weather", "de": "und der das nicht wetter", "nl": "het een niet weer van", "xx": "qopa zuru mimi", "fr": "le la des temps est"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(texts[k].split(), k=9)), k) for i, k in enumerate(list(texts) * 30)]
    model = language.fit(labelled(spark, rows))
    assert model.families == ["germanic", "only xx", "romance"]
    assert model.pairs == [("de", "en"), ("de", "nl"), ("en", "nl")]
    assert all(model.predict(" ".join(rng.choices(t.split(), k=12)))[0] == k for k, t in texts.items())
    again = language.fit(labelled(spark, rows[::-1]))
    assert np.array_equal(model.weights, again.weights)


def test_languages_of_odd_rows(spark):
    rows = [(i, t, "en") for i, t in ODD] + [(20, "der und die", "de"), (21, "x", None), (22, "12 — 34 !", "es"), (23, "٣٤", "es")]
    docs = labelled(spark, rows)
    got = language.predicted(docs, language.fit(docs)).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got} == {"en", "de", "und"}
    assert sorted(str(r.doc_id) for r in got if r.lang_pred == "und") == ["1", "2", "22", "23", "3", "None"]
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    one = labelled(spark, [(1, "only one", "en"), (2, None, None)])
    assert {(r.doc_id, r.lang_pred) for r in language.predicted(one, language.fit(one)).collect()} == {(1, "en"), (2, "und")}
    for none in (labelled(spark, []), labelled(spark, [(1, "a text", None)])):
        assert {r.lang_pred for r in language.predicted(none, language.fit(none)).collect()} <= {"und"}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 5)
    rows = [(i % 40, f"text {i % 60}", "en" if i % 3 else "fr") for i in range(900)] + [(None, "no id", "en")] * 50
    got = language.learned_rows(labelled(spark, rows), "lang").collect()
    assert Counter(r.language for r in got) == {"en": 5, "fr": 5}
