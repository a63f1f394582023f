"""Neighbour search, archives and the pipeline."""

from __future__ import annotations

import hashlib
import io
import zipfile

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tests_llm_rows import ODD

import corpus_pipeline
from facetrank.llm import ann, warc
from facetrank.llm.zip_archive import Reader, Writer

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("score", T.StringType()),
])


def brute(rows, queries, k):
    out = {}
    for q in queries:
        v = np.array(dict(rows)[q], float)
        found = sorted((-float(np.dot(np.array(x, float), v)), i) for i, x in set((i, tuple(x)) for i, x in rows) if i != q)
        out[q] = [i for _, i in found[:k]]
    return out


def test_recall_on_a_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = {}
    for r in ann.nearest(table, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    hits = sum(len(set(want[q]) & {i for _, i in got[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))
    assert all(sorted(r for r, _ in found) == list(range(1, len(found) + 1)) for found in got.values())


def test_all_buckets_give_the_exact_result(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 40)
    monkeypatch.setattr(ann, "CELL_QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(-3, 4)).astype(np.float32).tolist()) for i in range(200)]
    rows += [(i, rows[5][1]) for i in range(200, 260)] + [(7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    got = {}
    for r in ann.nearest(df, F.col("id") % 4 == 0, k=5, probes=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows, [i for i, _ in rows if i % 4 == 0], 5)


def test_small_tables_give_all_candidates(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(11)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    got = {}
    for r in ann.nearest(df, F.col("id") >= 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows, range(11), 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, nan]), (5, [inf, 1.0]),
            (6, [1.0, None]), (None, [1.0, 0.0]), (40, [1.0, 0.0, 0.0]), (60, [1e30, -1e30]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("id") % 20 == 0, probes=4).collect())
    assert got == [(0, 1, 60), (0, 2, 20), (0, 3, 7), (20, 1, 60), (20, 2, 0), (20, 3, 7), (60, 1, 0), (60, 2, 20), (60, 3, 7)]
    assert ann.nearest(df.filter("false"), F.col("id") % 20 == 0).collect() == []


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 8))
    y = ann.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(ann.hadamard(y), x)


def in_memory(data):
    return Reader(lambda at, n: data[at : at + n], len(data))


def test_reads_archives_of_the_standard_library():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", b"hello")
        z.writestr("ä/b.bin", bytes(range(256)) * 9)
        z.writestr("c.txt", b"x" * 500, zipfile.ZIP_DEFLATED)
        with z.open("wide", "w", force_zip64=True) as member:
            member.write(b"wide member")
        z.comment = b"a comment with PK\5\6 inside"
    data = out.getvalue()
    reader = in_memory(data)
    members = {m.name: m for m in reader.members()}
    assert set(members) == {"a.txt", "ä/b.bin", "c.txt", "wide"}
    for name, want in (("a.txt", b"hello"), ("ä/b.bin", bytes(range(256)) * 9), ("wide", b"wide member")):
        at = reader.data_at(members[name])
        assert data[at : at + members[name].size] == want
    with pytest.raises(ValueError):
        reader.data_at(members["c.txt"])
    with pytest.raises(ValueError):
        in_memory(b"no archive").members()


def test_standard_library_reads_our_zip64():
    out = io.BytesIO()

    def append(data):
        at = out.tell()
        out.write(data)
        return at

    writer = Writer(append)
    at = writer.add("x/y.warc", [b"abc", b"def"])
    writer.add("empty", [])
    writer.finish()
    data = out.getvalue()
    assert data[at : at + 6] == b"abcdef"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("x/y.warc") == b"abcdef" and z.read("empty") == b""
    assert [(m.name, m.size) for m in in_memory(data).members()] == [("x/y.warc", 6), ("empty", 0)]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER", 3000)
    monkeypatch.setattr(warc, "PACKAGE", 9000)
    monkeypatch.setattr(warc, "RANGE", 2000)
    big, large = "<p>é\r\n\r\n" * 300, "".join(map(str, range(9000)))
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None),
            (6, "u", ""), (None, "u", big), (7, "u", large), (8, "u", large), (8, "u", large)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.read_records(spark, warc.write_packages(df)).collect()
    assert len(got) == len(rows)
    last = {big: 9, large: 8}
    for r in got:
        html = [h for i, _, h in rows if i == r.page_id][0] or ""
        data = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        if html in last and r.page_id != last[html]:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", last[html], None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
    assert warc.read_records(spark, warc.write_packages(df.filter("false"))).collect() == []


def test_pipeline_stages(spark, documents):
    docs = documents(ODD).select("doc_id", "text", "lang", "source", "n_chars", "score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    empty = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_pipeline_keeps_clean_and_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    clean = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi").count()
    assert kept.join(labels.filter("quality = 1"), "doc_id", "left_semi").count() >= 0.97 * clean
    texts = [r.text for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).filter("trim(text) <> ''").collect()]
    assert len(texts) == len(set(texts))
