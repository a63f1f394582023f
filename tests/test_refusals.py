"""What must be refused, and one request against the same request in a table."""

import numpy as np
import pytest

from facetrank.functions.arrays import distances
from facetrank.functions.vectors import l2_distance_to
from facetrank.operators.encoder import HashedEncoder
from facetrank.plans import batch, search
from facetrank.schema import Filters
from facetrank.sources import tables as store


def test_repeated_article_is_refused(articles, tmp_path):
    twice = articles({"article_id": 1, "product_code": 9}, {"article_id": 1, "product_code": 8})
    with pytest.raises(store.DuplicateKey):
        store.write_catalog(twice, str(tmp_path / "catalog"))
    with pytest.raises(store.DuplicateKey):
        store.save_catalog_table(twice, "refused_catalog", 2, str(tmp_path / "table"))


def test_fits_on_other_texts_have_other_ids(spark, tmp_path):
    first, second = (
        HashedEncoder.fit(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 8, "mine")
        for texts in (["wool coat", "silk scarf"], ["wool coat", "wool sock", "linen"])
    )
    assert first.model_id != second.model_id
    first.save(str(tmp_path / "fit"))
    assert HashedEncoder.load(str(tmp_path / "fit")).model_id == first.model_id


@pytest.mark.parametrize("fields", [
    {"colores": ["Red", None]}, {"colores": [None]}, {"colores_excluidos": ["Red", None]}, {"colores": ["Red", "Blue", None]},
])
def test_batch_equals_single_with_nulls(articles, requests, fields):
    catalog = articles(*[
        {"article_id": i, "product_code": i, "perceived_colour_master_name": c}
        for i, c in enumerate(["Red", "Blue", None, "Green"])
    ])
    one = search.facet_search(catalog, Filters(**{k: tuple(v) for k, v in fields.items()}))
    many = batch.facet_search_batch(catalog, requests(fields))
    assert [r.product_code for r in many.orderBy("rank").collect()] == [r.product_code for r in one.collect()]


@pytest.mark.parametrize("vector", [None, [], [1.0, float("nan")], [float("inf"), 0.0]])
def test_bad_request_vectors_are_refused(spark, four, requests, vector):
    vectors = spark.createDataFrame([(100, [1.0, 0.0])], "product_code long, embedding array<float>")
    with pytest.raises(ValueError):
        batch.search_batch(four, vectors, requests({"query_vec": vector}))


def test_repeated_query_id_is_refused(four, requests):
    with pytest.raises(store.DuplicateKey):
        batch.facet_search_batch(four, requests({"query_id": 1}, {"query_id": 1}))


def test_bad_limit_is_refused_even_if_no_result_is_read(spark, four, requests):
    vectors = spark.createDataFrame([(100, [1.0, 0.0])], "product_code long, embedding array<float>")
    with pytest.raises(Exception, match="limite"):
        batch.search_batch(four, vectors, requests({"query_vec": [1.0, 0.0], "limite": 500}))


@pytest.mark.parametrize("dim", [64, 65, 384])
def test_one_arithmetic_for_all_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(300, dim)).astype(np.float32)
    query = rng.normal(size=dim).astype(np.float32).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, embedding array<float>")
    rows = df.select("i", l2_distance_to("embedding", query).alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == distances(x.astype(float), np.asarray(query)).tolist()
