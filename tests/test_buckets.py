"""Buckets of vectors: exact answers from fewer vectors, near answers with a measured recall."""

import numpy as np
import pytest
from facetrank.plans.buckets import SHARE, build_buckets, nearest_by_buckets, open_buckets
from facetrank.plans.search import nearest_products

DIM, GROUPS, LIMIT = 16, 60, 10


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(GROUPS, DIM)) * 2
    # One group of some 200 vectors, the others of some 50; equal vectors, a zero vector.
    group = np.where(rng.random(3000) < 0.05, 0, rng.integers(0, GROUPS, 3000))
    found = (middles[group] + rng.normal(size=(3000, DIM)) * 0.3).astype(np.float32)
    found[100:110] = found[99]
    found[200] = 0
    return found


@pytest.fixture(scope="module")
def stored(spark, points, tmp_path_factory):
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    vectors = spark.createDataFrame(rows, "product_code long, embedding array<float>").cache()
    path = str(tmp_path_factory.mktemp("buckets") / "index")
    build_buckets(vectors, path)
    return vectors, open_buckets(spark, path)


@pytest.fixture(scope="module")
def catalog(articles):
    return articles(*[{"article_id": i, "product_code": i} for i in range(3000)]).cache()


def test_every_vector_is_in_one_bucket(stored):
    vectors, buckets = stored
    read = buckets.read(buckets.numbers.tolist())
    assert sorted(map(str, read.collect())) == sorted(map(str, vectors.collect()))
    assert buckets.sizes.sum() == 3000 and len(buckets.numbers) <= 54


def test_recall_and_share_on_clustered_vectors(points, stored):
    vectors, buckets = stored
    bucket_of = {r["product_code"]: r["bucket"] for r in buckets.vectors.select("product_code", "bucket").collect()}
    bucket = np.array([bucket_of[i] for i in range(len(points))])
    hits, shares, exact_shares = 0, [], []
    for i in range(0, 3000, 10):
        far = np.linalg.norm(points.astype(float) - points[i].astype(float), axis=1)
        order = np.lexsort((np.arange(len(far)), far))[:LIMIT]
        chosen = buckets.nearest(points[i], SHARE, LIMIT)
        shares.append(buckets.share_of(chosen))
        hits += np.isin(bucket[order], chosen).sum()
        # What is exact leaves out no neighbour, whatever was read first.
        kept = buckets.within(points[i], far[order[-1]])
        exact_shares.append(buckets.share_of(kept))
        assert np.isin(bucket[order], kept).all()
    assert hits / (300 * LIMIT) >= 0.9
    assert np.mean(shares) < 0.2
    assert np.mean(exact_shares) < 0.6


def test_answers_equal_a_whole_scan(points, stored, catalog):
    vectors, buckets = stored
    for i, limit in ((7, 10), (105, 30), (200, 100)):
        query = points[i].tolist()
        expected = nearest_products(catalog, vectors, query, limit).collect()
        # A share so small that the first buckets don't hold the whole answer.
        assert nearest_by_buckets(catalog, buckets, query, limit, share=0.0).collect() == expected
    near = nearest_by_buckets(catalog, buckets, points[7].tolist(), 10, exact=False).collect()
    assert len(near) == 10 and near[0]["product_code"] == 7


def test_small_and_empty_tables(spark, stored, catalog, tmp_path):
    vectors, _ = stored
    two = vectors.filter("product_code < 2")
    buckets = build_buckets(two, str(tmp_path / "two"))
    query = [0.5] * DIM
    assert nearest_by_buckets(catalog, buckets, query, 5).collect() == nearest_products(catalog, two, query, 5).collect()
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "product_code long, embedding array<float>")
    found = nearest_by_buckets(catalog, build_buckets(equal, str(tmp_path / "equal")), [1.0, 2.0], 3).collect()
    assert [r["product_code"] for r in found] == [0, 1, 2]
    with pytest.raises(ValueError, match="no vectors"):
        build_buckets(two.limit(0), str(tmp_path / "none"))


def test_other_buckets_are_skipped_by_the_scan(stored, plan_of):
    _, buckets = stored
    assert "PushedFilters: [In(bucket" in plan_of(buckets.read([1, 2]))
