"""Vector expressions against numpy; texts; encoders; index."""

import numpy as np
import pytest
from facetrank.functions import text, vectors as vec
from facetrank.operators.encoder import HashedEncoder, ModelEncoder
from facetrank.plans import index
from facetrank.plans.search import nearest_products
from facetrank.schema import VECTOR_SCHEMA
from facetrank.sources import tables as store
from pyspark.sql import functions as F


def test_normalize_and_distance(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 7)).astype(np.float32), rng.normal(size=(20, 7)).astype(np.float32)
    a[3] = 0
    rows = [(i, a[i].tolist(), b[i].tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>").orderBy("i").select(
        vec.l2_normalize(F.col("a")).alias("unit"),
        vec.l2_distance(F.col("a"), F.col("b")).alias("d"),
        vec.l2_distance_to("a", b[0].tolist()).alias("d0"),
    )
    got = df.collect()
    a, b = a.astype(float), b.astype(float)
    norms = np.linalg.norm(a, axis=1, keepdims=True)
    assert np.allclose([r["unit"] for r in got], a / np.clip(norms, 1e-12, None))
    assert np.allclose([r["d"] for r in got], np.linalg.norm(a - b, axis=1), atol=1e-12)
    assert np.allclose([r["d0"] for r in got], np.linalg.norm(a - b[0], axis=1), atol=1e-12)


@pytest.mark.parametrize("dim", [1, 3, 64, 65, 384])
def test_distance_to_a_fixed_vector(spark, dim):
    rng = np.random.default_rng(dim)
    a, q = rng.normal(size=(50, dim)).astype(np.float32), rng.normal(size=dim)
    df = spark.createDataFrame([(i, a[i].tolist()) for i in range(50)], "i int, a array<float>")
    got = [r["d"] for r in df.select("i", vec.l2_distance_to("a", q).alias("d")).orderBy("i").collect()]
    assert np.allclose(got, np.linalg.norm(a.astype(float) - q, axis=1), rtol=1e-12)
    assert df.limit(0).select(vec.l2_distance_to("a", q)).collect() == []


def test_distance_of_different_lengths_fails(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<float>, b array<float>")
    for distance in (
        vec.l2_distance(F.col("a"), F.col("b")), vec.l2_distance_to("a", [1.0]), vec.l2_distance_to("a", [1.0] * 3),
        vec.l2_distance_to("a", [1.0] * 70),
    ):
        with pytest.raises(Exception, match="different length|INVALID_ARRAY_INDEX"):
            df.select(distance).collect()


def test_masked_mean_pool(spark):
    rng = np.random.default_rng(2)
    tokens, expected = [], {}
    for text_id, n in enumerate([1, 5, 300, 4]):
        x = rng.normal(size=(n, 3)).astype(np.float32)
        mask = np.zeros(n, int) if text_id == 3 else np.r_[1, rng.integers(0, 2, n - 1)]
        tokens += [(text_id, i, int(m), v.tolist()) for i, (m, v) in enumerate(zip(mask, x))]
        expected[text_id] = (x.astype(float) * mask[:, None]).sum(0) / max(mask.sum(), 1e-9)
    df = spark.createDataFrame(tokens, "text_id int, pos int, mask int, vec array<float>")
    got = {r["text_id"]: r["vec"] for r in vec.masked_mean_pool(df, "text_id", 3).collect()}
    assert set(got) == set(expected)
    for key, value in expected.items():
        assert np.allclose(got[key], value)
    assert got[3] == [0.0, 0.0, 0.0]


def test_product_text_skips_missing_parts(articles):
    kinds, texts = ["Umbrella", "", None], ["Opens by itself; 96 cm.", "", None]
    cases = [(i * 10 + j, kind, said) for i, kind in enumerate(kinds) for j, said in enumerate(texts)]
    rows = articles(*[
        {"article_id": n, "product_code": n, "prod_name": f"No. {n}", "product_type_name": kind, "detail_desc": said}
        for n, kind, said in cases
    ])
    got = {r["article_id"]: r["t"] for r in rows.select("article_id", text.product_text().alias("t")).collect()}
    assert got == {n: ". ".join(x for x in (f"No. {n}", kind, said) if x) for n, kind, said in cases}


def test_blank_is_unicode_aware(spark):
    cases = {"": True, "  ": True, "\t\n\r": True, "  　\x85\x1c": True, " a ": False, "​": False, None: True}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", text.is_blank(F.col("s")).alias("b"))
    assert {r["s"]: r["b"] for r in df.collect()} == cases


WORDS = {
    100: "Copper kettle that whistles once the water boils.",
    200: "Folding ladder of ash wood, seven rungs.",
    300: "Telescope on a tripod: planets, moons and distant ships.",
    400: "Beeswax candle, burns nine hours without smoke.",
}


@pytest.fixture(scope="module")
def catalog(articles):
    return articles(*[
        {"article_id": c * 1000 + v, "product_code": c, "prod_name": f"P{c}", "detail_desc": d if v == 0 else "other"}
        for c, d in WORDS.items() for v in range(2)
    ]).cache()


@pytest.fixture(scope="module")
def encoder(catalog):
    return HashedEncoder.fit(index.product_texts(catalog), "texto", 1024)


def test_text_of_the_lowest_article_stands_for_the_product(spark, catalog):
    whole = {r["product_code"]: r["texto"] for r in index.product_texts(catalog).collect()}
    assert whole == {c: f"P{c}. Poncho. {d}" for c, d in WORDS.items()}
    none = spark.createDataFrame([], VECTOR_SCHEMA)
    assert {r["product_code"]: r["texto"] for r in index.product_texts(catalog, none).collect()} == whole


def test_index_is_built_once_and_extended(spark, catalog, encoder, tmp_path):
    path = str(tmp_path / "index")
    report = index.build_index(catalog.filter("product_code < 300"), path, encoder)
    assert (report.indexados, report.total) == (2, 2)
    assert index.extend_index(catalog, path, encoder) == index.IndexReport(2, 4)
    assert index.extend_index(catalog, path, encoder) == index.IndexReport(0, 4)
    vectors = store.read_vectors(spark, path, encoder.model_id)
    assert store.ready(catalog, vectors) and not store.ready(catalog.limit(0), vectors)
    norms = [np.linalg.norm(r["embedding"]) for r in vectors.collect()]
    assert np.allclose(norms, 1.0, atol=1e-5)
    with pytest.raises(Exception, match="(?i)exists"):
        index.build_index(catalog, path, encoder)
    with pytest.raises(ValueError, match="holds vectors of"):
        store.read_vectors(spark, path, "other")


@pytest.mark.parametrize("query, expected", [
    ("boils water", 100), ("a LADDER with many rungs", 200), ("moons of other planets", 300), ("smoke of a candle", 400),
])
def test_nearest_product_shares_words(spark, catalog, encoder, query, expected):
    asked = spark.createDataFrame([(1, query)], "query_id long, consulta_semantica string")
    query_vec = index.embed_requests(asked, encoder).first()["query_vec"]
    vectors = index.embed_products(catalog, None, encoder)
    rows = nearest_products(catalog, vectors, query_vec, limit=4).collect()
    assert rows[0]["product_code"] == expected
    assert [r["distancia"] for r in rows] == sorted(r["distancia"] for r in rows)


def test_encoder_is_deterministic_and_can_be_stored(spark, encoder, tmp_path):
    texts = spark.createDataFrame([(1, "Warm  JACKET, warm"), (2, "warm jacket warm"), (3, ""), (4, None)], "i int, s string")
    encoder.save(str(tmp_path / "encoder"))
    again = HashedEncoder.load(str(tmp_path / "encoder"))
    assert (again.model_id, again.dim) == (encoder.model_id, 1024)
    one = {r["i"]: r["embedding"] for r in encoder(texts, "s").collect()}
    two = {r["i"]: r["embedding"] for r in again(texts, "s").collect()}
    assert one == two and one[1] == one[2]
    assert one[3] == one[4] == [0.0] * 1024


def test_model_encoder(spark):
    def make_predict():
        return lambda texts: np.array([[len(t), t.count("a"), 1.0] for t in texts], dtype=np.float32)

    model = ModelEncoder(make_predict, "counts", 3, batch_size=2)
    texts = spark.createDataFrame([(i, "a" * i) for i in range(5)], "i int, s string")
    got = {r["i"]: r["embedding"] for r in model(texts, "s").collect()}
    for i in range(5):
        raw = np.array([i, i, 1.0])
        assert np.allclose(got[i], raw / np.linalg.norm(raw), atol=1e-6)
    with pytest.raises(Exception, match="expected a vector of length 4"):
        ModelEncoder(make_predict, "counts", 4)(texts, "s").collect()


def test_vector_sink_refuses_bad_rows(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 0.0])], VECTOR_SCHEMA)
    path = str(tmp_path / "v")
    store.write_vectors(good, path, 2, "m")
    with pytest.raises(store.DuplicateKey):
        store.append_vectors(good, path, 2, "m")
    with pytest.raises(store.DuplicateKey):
        store.append_vectors(spark.createDataFrame([(2, [1.0, 0.0])] * 2, VECTOR_SCHEMA), path, 2, "m")
    with pytest.raises(Exception, match="expected a vector of length 2, got 3"):
        store.append_vectors(spark.createDataFrame([(2, [1.0, 0.0, 0.0])], VECTOR_SCHEMA), path, 2, "m")
    store.append_vectors(spark.createDataFrame([(2, [0.0, 1.0])], VECTOR_SCHEMA), path, 2, "m")
    assert store.read_vectors(spark, path, "m").count() == 2


class Counted:
    """An encoder that counts the texts it is given and fails at a call."""

    def __init__(self, encoder, counter, fail_at=None):
        self.encoder, self.counter, self.fail_at, self.calls = encoder, counter, fail_at, 0
        self.model_id, self.dim = encoder.model_id, encoder.dim

    def __call__(self, texts, column, output="embedding"):
        self.calls += 1
        if self.calls == self.fail_at:
            raise RuntimeError("lost")
        self.counter.append(sorted(r["product_code"] for r in texts.select("product_code").collect()))
        return self.encoder(texts, column, output)


def test_lost_build_keeps_its_commits(spark, articles, tmp_path):
    catalog = articles(*[{"article_id": i, "product_code": i // 2, "detail_desc": f"word{i} and thing{i % 7}"} for i in range(120)])
    encoder = HashedEncoder.fit(index.product_texts(catalog), "texto", 16)
    path, whole = str(tmp_path / "index"), str(tmp_path / "whole")
    first, second, third = [], [], []
    with pytest.raises(RuntimeError, match="lost"):
        index.build_index_in_commits(catalog, path, Counted(encoder, first, fail_at=4), products_per_commit=8)
    done = {p for commit in first for p in commit}
    assert len(first) == 3 and 0 < len(done) < 60
    assert {r["product_code"] for r in store.read_vectors(spark, path, encoder.model_id).collect()} == done
    report = index.build_index_in_commits(catalog, path, Counted(encoder, second), products_per_commit=8)
    assert report == index.IndexReport(60 - len(done), 60)
    assert sorted(p for commit in second for p in commit) == sorted(set(range(60)) - done)
    assert index.build_index_in_commits(catalog, path, Counted(encoder, third)) == index.IndexReport(0, 60)
    assert third == [[]]
    index.build_index(catalog, whole, encoder)
    rows = [sorted(store.read_vectors(spark, p, encoder.model_id).collect()) for p in (path, whole)]
    assert rows[0] == rows[1]


def test_commits_of_an_empty_catalog(spark, articles, tmp_path):
    catalog = articles({"article_id": 1, "product_code": 1})
    encoder = HashedEncoder.fit(index.product_texts(catalog), "texto", 4)
    assert index.build_index_in_commits(catalog.limit(0), str(tmp_path / "index"), encoder) == index.IndexReport(0, 0)
