"""Operators on texts against plain versions, on odd rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tests_llm_rows import LONG, ODD

from facetrank.llm import classifier, line_dedup, mixing, near_dup, packing, quality_rules, rans, secrets, token_files, tokens
from facetrank.llm.queries import QUERIES, vocabulary
from facetrank.shared import scratch_path


def plain_shingles(text, size):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def plain_components(texts, size):
    sets = {i: plain_shingles(t, size) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def near_texts():
    rng = random.Random(5)
    texts, i = [], 0
    for group in range(12):
        base = [f"g{group}w{rng.randrange(900)}" for _ in range(rng.choice([3, 30, 200]))]
        for copy in range(rng.choice([1, 2, 9])):
            found = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0.02, 0.04, 0.06, 0.1]))):
                found[rng.randrange(len(found))] = f"n{rng.random()}"
            texts.append((i, " ".join(found).upper() if copy % 2 else " ".join(found)))
            i += 1
    return texts


def test_near_duplicates_equal_brute_force(documents):
    texts = near_texts()
    for size in (2, 5):
        got = {r.doc_id: r for r in near_dup.near_duplicates(documents(texts), size).collect()}
        want = plain_components(texts, size)
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(plain_shingles(dict(texts)[i], size)) for i, r in got.items())
        assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_duplicates_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    texts = near_texts()
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(texts), 2).collect()}
    assert got == plain_components(texts, 2)


def hostile_texts(seed):
    """Pairs of near copies, and documents of smaller id that quote some words of them and lead their keys."""
    rng = random.Random(seed)
    texts = []
    for group in range(30):
        base = [f"g{group}w{rng.randrange(10**6)}" for _ in range(101)]
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(len(copy))] = f"n{rng.random()}"
        texts += [(100_000 + 10 * group, " ".join(base)), (100_001 + 10 * group, " ".join(copy))]
        for i in range(20):
            at, n = rng.randrange(90), rng.randrange(4, 12)
            texts.append((100 * group + i, " ".join([*base[at : at + n], *(f"q{rng.random()}" for _ in range(rng.randrange(6)))])))
    return texts


def test_leaders_that_are_unlike_lose_no_link(documents):
    texts = hostile_texts(3)
    want = plain_components(texts, 2)
    assert sum(want[100_001 + 10 * g] == 100_000 + 10 * g for g in range(30)) > 15
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(texts), 2).collect()} == want


@pytest.mark.parametrize("holders", [4096, 5])
def test_signatures_under_a_key_are_joined_like_brute_force(spark, monkeypatch, holders):
    """Random signatures under shared keys, some within the threshold of each other, whatever leads them."""
    monkeypatch.setattr(near_dup, "HOLDERS", holders)
    rng = np.random.default_rng(8)
    signatures = []
    for _ in range(12):
        base = rng.integers(0, 256, near_dup.PLACES)
        for _ in range(6):
            near = base.copy()
            places = rng.choice(near_dup.PLACES, rng.integers(0, 34), replace=False)
            near[places] = rng.integers(0, 256, len(places))
            signatures.append(near)
    signatures = np.array(signatures, np.uint8)[rng.permutation(len(signatures))]
    held = [sorted(rng.choice(len(signatures), n, replace=False).tolist()) for n in (72, 40, 20, 2, 1)]
    padded = np.zeros((len(signatures), near_dup._LONGS * 8), np.uint8)
    padded[:, : near_dup.PLACES] = signatures
    sets = spark.createDataFrame([(i, row.view("<i8").tolist()) for i, row in enumerate(padded)], "node long, signature array<long>")
    rest = spark.createDataFrame([(k, i) for k, nodes in enumerate(held) for i in nodes], "key long, node long")
    edges = [(r.v, r.u) for r in near_dup._edges_in_keys(rest, sets).collect()]
    root = list(range(len(signatures)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for v, u in edges:
        root[find(v)] = find(u)
    apart = (signatures[:, None] != signatures[None]).sum(2)
    pairs = [(a, b) for nodes in held for a in nodes for b in nodes if a < b and apart[a, b] <= near_dup.THRESHOLD]
    assert pairs and all(find(a) == find(b) for a, b in pairs)
    assert all(apart[v, u] <= near_dup.THRESHOLD + near_dup.SETTLED for v, u in edges)


def test_near_duplicates_of_odd_rows(documents):
    rows = near_dup.near_duplicates(documents(ODD), 2).collect()
    assert len(rows) == len(ODD)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert all(r.component_id == r.doc_id and r.kept and r.n_shingles == 0 for i in (1, 2, 3) for r in by_id[i])
    assert [r.component_id for r in by_id[5]] == [5, 5] and [r.component_id for r in by_id[6]] == [5]
    assert all(r.component_id is None and r.kept for r in by_id[None])
    assert near_dup.near_duplicates(documents([])).collect() == []


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, near_dup.PLACES).astype(np.uint8)
    for _ in range(300):
        b = a.copy()
        b[rng.permutation(near_dup.PLACES)[: near_dup.GUARANTEED]] ^= 1
        assert set(near_dup.keys(a[None])[0]) & set(near_dup.keys(b[None])[0])


def test_quality_rules_measures(documents):
    def plain(text):
        text = text or ""
        found = text.encode().split()
        windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        counts = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        return (len(found), sum(len(w.decode()) for w in found), len(re.findall(r"[#*$%&|<>]", text)),
                len(lines) - len(set(lines)), len(covered))

    rows = [*ODD, (20, "a b c d e a b c d e a # x"), (21, "x y\nx y\n\n \nz"), (22, "x " * 50)]
    df = documents(rows)
    got = quality_rules.judge(df, quality_rules.ordered_rules(df)).collect()
    want = Counter((i, *plain(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert quality_rules.judge(documents([]), quality_rules.ordered_rules(documents([]))).collect() == []


def plain_kept(text):
    """The verdict of base and rules, from definitions alone."""
    text = text or ""
    found = [w.decode() for w in text.encode().split()]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    if len(found) < 10 or 5 * len(covered) > len(found):
        return False
    lines = [x for x in text.split("\n") if x.encode().split()]
    cased = [c for c in text if c.isupper() or c.islower()]
    chars = "".join(found)
    return not (
        len(chars) < 2 * len(found) or len(chars) > 20 * len(found)
        or 5 * len(re.findall(r"[#*$%&|<>]", text)) > len(found)
        or sum(c.isupper() for c in cased) > 0.6 * len(cased)
        or 4 * len(re.findall(r"[!?]", text)) > len(found)
        or 3 * (len(lines) - len(set(lines))) > len(lines)
        or 4 * len([c for c in chars if c.isalpha()]) < len(chars)
        or 10 * len([x for x in lines if x.encode().rstrip().decode().endswith(("...", "\u2026"))]) > 3 * len(lines)
    )


#: One text that each rule alone rejects, in the order of the rules.
REJECTED = (
    " ".join("abcdefghijklmno"), " ".join(f"word{i} #" if i % 2 else f"word{i}" for i in range(40)),
    " ".join(f"LOUD{i}" for i in range(40)), " ".join(f"word{i}{'!' * (i % 2)}" for i in range(40)),
    "\n".join(["same"] * 4 + [f"aa bb{i} cc" for i in range(3)]), " ".join(f"{i * 7919}a" for i in range(10**4, 10**4 + 40)),
    "\n".join(f"broken off {i}..." for i in range(20)),
)


def test_quality_verdicts_equal_brute_force(spark, documents):
    rows = [*ODD, *enumerate(REJECTED, 30), (50, " ".join(f"plain{i}" for i in range(40)))]
    docs = documents(rows)
    got = quality_rules.judge(docs, quality_rules.ordered_rules(docs)).collect()
    assert Counter((r.doc_id, r.kept) for r in got) == Counter((i, plain_kept(t)) for i, t in rows)
    alone = {r.doc_id: r.rejected_by for r in got}
    assert [alone[30 + i] for i in range(len(REJECTED))] == [r.name for r in quality_rules.RULES] and alone[50] is None
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r.kept for r in QUERIES["op2_rule_cascade"](spark, SF).collect()}
    assert found == {i: plain_kept(t) for i, t in texts.items()}


def test_rules_cost_what_they_add():
    texts = [" ".join(f"word{i}" for i in range(5000))] * 20
    cost = dict(zip((r.name for r in quality_rules.RULES), quality_rules.measure(quality_rules.RULES, texts)[0]))
    assert 20 * cost["symbols"] < cost["capitals"] and 20 * cost["repeated_lines"] < cost["letters"]


def test_order_of_rules_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = {r.doc_id: r.kept for r in quality_rules.judge(docs, quality_rules.RULES).collect()}
    assert some == {r.doc_id: r.kept for r in quality_rules.judge(docs, quality_rules.RULES[::-1]).collect()}


def test_best_order_prefers_rejections_per_cost():
    rejected = np.array([[1, 1, 0, 0], [1, 1, 1, 0], [0, 0, 0, 1]], bool)
    assert quality_rules.best_order(np.array([1.0, 5.0, 0.1]), rejected) == [2, 0, 1]


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())  # as it comes
    rng = random.Random(2)
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(" \n\t.,'!abA1é日　\xa0\x1cs") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for text in [*texts, "<|endoftext|> a", "it's  we'll 's.", "a\n  b", "x ʰ ý."]:
        assert np.frombuffer(tokens.encode(vocabulary(), text), tokens.ID).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 16384, 65536, 65537, 150_000])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.uint32)
    assert (rans.decode(rans.encode(ids)) == ids).all()


def test_rans_one_id_and_checksum():
    data = bytearray(rans.encode(np.full(70_000, 7, np.uint32)))
    assert (rans.decode(bytes(data)) == 7).all()
    data = bytearray(rans.encode(np.arange(5000, dtype=np.uint32)))
    data[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(data))


def test_token_files_round_trip(spark, documents, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 50)
    manifest = token_files.write_tokens(documents(ODD), vocabulary(), 2)
    got = sorted(token_files.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for row, (doc_id, text) in zip(got, want, strict=True):
        assert (row.doc_id, row.start) == (doc_id, at)
        assert bytes(row.ids) == tokens.encode(vocabulary(), text) + np.array([2], tokens.ID).tobytes()
        at += len(row.ids) // 4
    empty = token_files.write_tokens(documents([]), vocabulary(), 2)
    assert token_files.read_tokens(spark, empty).collect() == []


def test_packing(documents, monkeypatch):
    monkeypatch.setattr(packing, "MAX_OPEN", 3)
    pieces = packing.pack(documents(ODD), vocabulary(), 0, 64).collect()
    whole = Counter()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[(p.doc_id, p.doc_tokens)].append(p)
    for (doc_id, total), found in by_doc.items():
        assert sum(p.length for p in found) % total == 0
        whole[doc_id] += sum(p.length for p in found) // total
    assert whole == Counter(i for i, _ in ODD)
    expected = Counter(tokens.encode(vocabulary(), t) + b"\0\0\0\0" for _, t in ODD)
    long = b"".join(bytes(p.ids) for p in sorted(by_doc[(8, by_doc_total(by_doc, 8))], key=lambda p: p.start))
    assert long == tokens.encode(vocabulary(), LONG) + b"\0\0\0\0" and expected[long] == 1
    fill = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill[p.sequence_id] and p.length == len(p.ids) // 4
        fill[p.sequence_id] += p.length
    assert max(fill.values()) == 64 and sum(n < 64 for n in fill.values()) <= 3
    assert packing.pack(documents([]), vocabulary(), 0).collect() == []


def by_doc_total(by_doc, doc_id):
    return next(total for i, total in by_doc if i == doc_id)


def test_sum_of_squares_choice():
    packer = packing.SumOfSquares(10)
    packer.counts[[4, 6]] = [3, 1]
    # Into 6 fills a window; into 4 leaves 8 open; a new window would open at 4.
    def cost(level):
        n = packer.counts.copy()
        n[level] -= level > 0
        n[level + 4] += level + 4 < 10
        return (n**2).sum()
    best = min((cost(level), -level) for level in (0, 4, 6))
    assert packer.level_for(4) == -best[1]


def plain_spans(text):
    out = []
    for place, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.at_least:
                start = m.start() + (len(m.group(rule.lead)) if rule.lead else 0)
                out.append((start, place, f"{rule.kind}:{start}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


SECRETS = [
    *ODD, (30, "password = 'hunter22' é token:ab secret:token:abcdefgh API_KEY=\"k/k+k=k\" passwd= x"),
    (31, "日本 AKIA" + "A1" * 8 + " AKIAshort AKIAAKIA" + "B" * 16), (32, "f" * 23 + " " + "a0" * 12 + "g" + "0" * 40),
    (33, "-----BEGIN RSA PRIVATE KEY----- eyJabcdefgh12.eyJabcdefgh12.abcdefgh12 Token : zzzzzz"),
    (34, "password = 'hunter22' é token:ab secret:token:abcdefgh API_KEY=\"k/k+k=k\" passwd= x"),
]


HOSTILE = [
    "-----BEGIN ", "A ", "-----BEGIN A", "eyJaaaaaaaa", "eyJaaaaaaaa.", ".eyJaaaaaaaa", "eyJaaaaaaaa.eyJaaaaaaaa ", "token ", "AKIA",
    "0123456789abcdef", "secret:'a ", "token=abcdef ",
]


def test_secret_scan_of_hostile_texts(spark, documents):
    """Four megabytes of what patterns begin with: time grows with the text, and no stack overflows."""
    short = [(i, "-----BEGIN " + piece * 50 + " x") for i, piece in enumerate(HOSTILE)]
    long = [(100 + i, "-----BEGIN " + piece * (4_000_000 // len(piece))) for i, piece in enumerate(HOSTILE)]
    docs = documents(short + long).select("doc_id", "text").repartition(12, "doc_id")
    began = time.monotonic()
    found = secrets.scan(docs, scratch_path(spark, "ledger"), "one")
    counts = {r.doc_id: r.n for r in found.select("doc_id", F.size("findings").alias("n")).collect()}
    assert time.monotonic() - began < 90
    assert counts[111] == 4_000_000 // len(HOSTILE[11])
    few = {r.doc_id: r.findings for r in found.filter("doc_id < 100").collect()}
    for i, text in short:
        assert sorted(f"{x.kind}:{x.start}:{x.end}" for x in few[i]) == sorted(plain_spans(text))


def test_tokens_and_key_blocks_in_texts(spark, documents):
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM"
    texts = [f"a {jwt} b", jwt, f"({jwt}).", f"x.{jwt}", f"x{jwt}", f"{jwt} {jwt}", f"é😀 {jwt}, -----BEGIN RSA PRIVATE KEY-----",
             "-----BEGIN PRIVATE KEY-----", "-----BEGIN EC  PRIVATE KEY-----x", "-----BEGIN PUBLIC KEY-----"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.findings for r in secrets.scan(documents(rows), scratch_path(spark, "ledger"), "one").collect()}
    for i, text in rows:
        found = sorted(got[i], key=lambda x: (x.start, x.end))
        assert [f"{x.kind}:{x.start}:{x.end}" for x in found] == plain_spans(text)
    assert [text[x.start : x.end] for i, text in rows[:4] for x in got[i]] == [jwt] * 4
    assert got[4] == [] and len(got[5]) == 2


def test_secret_spans(spark, documents):
    ledger = scratch_path(spark, "ledger")
    got = secrets.scan(documents(SECRETS).select("doc_id", "text", "score", "key"), ledger, "one").collect()
    found = Counter((r.doc_id, tuple(sorted(f"{f.kind}:{f.start}:{f.end}" for f in r.findings))) for r in got)
    assert found == Counter((i, tuple(sorted(plain_spans(t)))) for i, t in SECRETS)


def test_ledger_scans_only_unseen_pairs(spark, documents):
    ledger = scratch_path(spark, "ledger")
    docs = documents(SECRETS)
    secrets.scan(docs.filter("doc_id < 32"), ledger, "one")
    first = secrets.read_ledger(spark, ledger)
    blobs = {r.blob for r in first.collect()}
    secrets.scan(docs, ledger, "two")
    second = spark.read.parquet(f"{ledger}/two")
    assert not blobs & {r.blob for r in second.collect()}
    newer = tuple(replace(r, version=r.version + (r.kind == "hex")) for r in secrets.RULES)
    got = secrets.scan(docs, ledger, "three", newer)
    assert {tuple(r.applied) for r in spark.read.parquet(f"{ledger}/three").collect()} == {("hex@2",)}
    assert sum(len(r.findings) for r in got.collect()) == sum(len(plain_spans(t)) for _, t in SECRETS)
    assert secrets.scan(documents([]), scratch_path(spark, "ledger"), "one").collect() == []


def test_mixing_native_and_edges(documents, plan_of, monkeypatch):
    df = mixing.mix(documents(ODD), epochs=3.0)
    assert not any(x in plan_of(df) for x in ("EvalPython", "InPandas", "InArrow"))
    rows = df.collect()
    assert {r.copy for r in rows if r.doc_id == 8} == set(range(sum(r.doc_id == 8 for r in rows)))
    assert mixing.mix(documents([])).collect() == []
    monkeypatch.setattr(mixing, "SENT_SOURCES", 0)
    again = mixing.mix(documents(ODD), epochs=3.0).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixing_reaches_its_targets(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("abcde").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    share = {r.source: r["count"] for r in mixing.mix(docs, temperature=0.0).groupBy("source").count().collect()}
    assert all(abs(n - 20_000 / 8) < 250 for n in share.values()) and len(share) == 8


def test_mixing_at_large_rates(spark):
    docs = spark.range(100).select(
        F.col("id").alias("doc_id"), F.lit("abcde").alias("text"), F.lit("small").alias("source"))
    for rate in (150.0, 700.0, 1000.0, 5000.0):
        copies = [r["count"] for r in mixing.mix(docs, epochs=rate).groupBy("doc_id").count().collect()]
        assert len(copies) == 100 and abs(np.mean(copies) - rate) < 5 * (rate / 100) ** 0.5
        assert 0.6 * rate < np.var(copies) < 1.6 * rate


def test_mixing_equals_its_sql_at_any_rate(spark, documents):
    """Sources with rates below 1, of some tens, above 100 and above 1,000."""
    rows = [*((f"big {i}", "big") for i in range(3000)), *((f"middle {i}", "middle") for i in range(30)),
            *((f"few {i}", None) for i in range(13)), ("one doc", "one")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (t, s) in enumerate(rows)], documents([]).select(
        "doc_id", "text", "lang", "source", "n_chars").schema)
    got = mixing.mix(docs, temperature=0.0, epochs=2.0).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(mixing.mix_sql("documents", temperature=0.0, epochs=2.0)).df()
    assert len(got) > 5_000 and got.groupby("doc_id").size().max() > 1000
    names = ["doc_id", "copy", "shuffle_key"]
    assert sorted(map(tuple, got[names].to_numpy().tolist())) == sorted(map(tuple, want[names].to_numpy().tolist()))


def test_patience():
    a, b = [1, 2, 3, 9, 4, 5, 9], [7, 2, 3, 8, 4, 5, 6, 9]
    assert line_dedup.patience(a, b) == [(1, 1), (2, 2), (4, 4), (5, 5), (6, 7)]
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_line_dedup(documents):
    def line(name, n=12):
        return " ".join(f"{name}{i}" for i in range(n))

    passage = "\n".join([line("p"), line("q"), line("r")])
    rows = [
        (1, f"{line('a')}\n{passage}\n{line('b')}"), (2, f"{passage}\n{line('c')}"), (3, line("p")),
        (4, f"{line('d')}\n{line('p')}\n{line('e')}"), (5, f"{line('a')}\n{passage}\n{line('b')}"), (6, passage), (6, passage),
        *[(i, t) for i, t in ODD if i is None or i > 6],
    ]
    got = defaultdict(list)
    for r in line_dedup.dedup_lines(documents(rows)).collect():
        got[r.doc_id].append(r)
    assert got[1][0].text == rows[0][1] and got[1][0].dropped == []
    assert got[2][0].text == line("c") and got[2][0].dropped == [0, 1, 2]
    assert got[3][0].n_dropped == got[4][0].n_dropped == 0  # 12 words are no passage
    assert got[5][0].text == "" and got[5][0].n_dropped == got[5][0].n_lines == 5
    assert [r.text for r in got[6]] == ["", ""]
    assert len(got[None]) == 2 and {r.text for r in got[None]} == {t for i, t in ODD if i is None}
    assert got[8][0].text == LONG and got[1][0].score == "x"
    assert line_dedup.dedup_lines(documents([])).collect() == []


def plain_dropped(texts, min_words=20):
    """Lines of each text, in order, that lie in a block of min_words words which an earlier text holds."""
    dropped, before = [], set()
    for text in texts:
        lines, here, gone = text.split("\n"), set(), set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[i:j]) >= min_words:
                    here.add(tuple(lines[i:j]))
                    if tuple(lines[i:j]) in before:
                        gone |= set(range(i, j))
        before |= here
        dropped.append(sorted(gone))
    return dropped


def many_words(name, n=12):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("holders", [63, 64, 3000])
def test_line_dedup_at_any_frequency(documents, holders):
    passage = [many_words(x) for x in "pqrst"]
    texts = [f"{many_words(f'x{i}')}\n{line}\n{many_words(f'y{i}')}" for i, line in enumerate(passage)]
    texts += [f"{many_words(f'v{i}')}\n" + "\n".join(passage) + f"\n{many_words(f'w{i}')}" for i in range(holders)]
    got = {r.doc_id: r.dropped for r in line_dedup.dedup_lines(documents(list(enumerate(texts)))).collect()}
    assert got == {i: [1, 2, 3, 4, 5] if i > 5 else [] for i in range(holders + 5)}


@pytest.mark.parametrize("first, later", [(1, 2), (2, 1), (2, 2)])
def test_line_dedup_of_a_passage_held_twice(documents, first, later):
    passage = [many_words(x) for x in "pqrst"]

    def text(i, times):
        return "\n".join(line for n in range(times) for line in [many_words(f"x{i}n{n}n"), *passage, many_words(f"y{i}n{n}n")])

    texts = [text(i, later if i else first) for i in range(70)]
    got = {r.doc_id: r.dropped for r in line_dedup.dedup_lines(documents(list(enumerate(texts)))).collect()}
    assert got == {i: [7 * n + k for n in range(later) for k in range(1, 6)] if i else [] for i in range(70)}


def test_line_dedup_of_short_lines(documents):
    verse = "\n".join(many_words(f"v{i}w", 3) for i in range(20))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents([(i, f"own {i}\n{verse}") for i in range(30)])).collect()}
    assert got == {i: f"own {i}" if i else f"own 0\n{verse}" for i in range(30)}


def test_line_dedup_equals_brute_force(documents):
    rng = random.Random(3)
    kinds = ["", " ", *[many_words(f"k{n}n", n) for n in (1, 3, 5, 7, 9, 11, 13, 20, 21)]]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    texts = list(dict.fromkeys(texts))
    got = {r.doc_id: r.dropped for r in line_dedup.dedup_lines(documents(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(plain_dropped(texts)))


def test_classifier_learns_and_takes_odd_rows(spark, documents):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op5_subword_classifier"](spark, SF).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and np.mean([a == b for a, b in held]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    model = classifier.fit(docs, labels)
    odd = classifier.score(documents(ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    chosen = sorted(classifier.labelled_rows(docs, labels, "quality").collect(), key=lambda r: (r.doc_id, r._label, hashlib.md5(r.text.encode()).hexdigest()))
    plain = classifier.train([r.text for r in chosen], [r._label for r in chosen])
    assert np.allclose(plain.weight, model.weight, atol=1e-6) and plain.constant == pytest.approx(model.constant)
    none = classifier.fit(docs, labels.filter("false"))
    assert {r.score for r in classifier.score(documents(ODD), none).collect()} == {0.5}
    assert "x" == classifier.scored(documents(ODD), none).first()["kept"]
    assert classifier.score(documents([]), model).collect() == []


def test_digests_of_files_are_stable():
    assert hashlib.sha1(rans.encode(np.arange(300, dtype=np.uint32))).hexdigest() == hashlib.sha1(rans.encode(np.arange(300, dtype=np.uint32))).hexdigest()
