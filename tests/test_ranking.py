"""Vector ranking: single requests, tables of requests, cells, reports."""

import numpy as np
import pyarrow as pa
import pytest
from facetrank.operators.cells import nearest, nearest_in_block
from facetrank.operators.facet_keys import KEY, candidates, number_keys, variant_groups
from facetrank.operators.versions import tagged_groups
from facetrank.operators.ranking import product_rows, rank_candidates, request_rows
from facetrank.operators.relax import relaxed_keys
from facetrank.plans.batch import search_batch
from facetrank.plans.reports import envelopes, filter_report
from facetrank.plans.search import RANKED_RESULT, hybrid_search, nearest_products
from facetrank.schema import VECTOR_SCHEMA, Filters
from facetrank.sources import tables as store
from pyspark.sql import functions as F

AXES = {15: [1.0, 0.0, 0.0], 27: [0.0, 1.0, 0.0], 38: [0.6, 0.8, 0.0], 46: [0.0, 0.0, 1.0]}


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(list(AXES.items()), VECTOR_SCHEMA).cache()


def codes(df):
    return [r["product_code"] for r in df.collect()]


def test_filter_beats_similarity(four, vectors):
    found = hybrid_search(four, vectors, Filters(publico="Divided"), [1.0, 0.0, 0.0])
    assert codes(found) == [46]
    assert tuple(found.columns) == RANKED_RESULT


def test_survivors_are_ordered_by_distance(four, vectors):
    rows = hybrid_search(four, vectors, Filters(), [1.0, 0.0, 0.0]).collect()
    assert [r["product_code"] for r in rows] == [15, 38, 27, 46]
    assert [r["distancia"] for r in rows] == pytest.approx([0.0, 0.8**0.5, 2**0.5, 2**0.5])


def test_ranking_comes_after_the_filter(four, vectors):
    assert codes(hybrid_search(four, vectors, Filters(publico="Menswear"), [1.0, 0.0, 0.0], limit=1)) == [38]


def test_product_without_vector_drops_out(four, vectors):
    some = vectors.filter("product_code <> 38")
    assert codes(hybrid_search(four, some, Filters(publico="Menswear"), [1.0, 0.0, 0.0])) == [27]


def test_limits(four, vectors):
    assert len(codes(hybrid_search(four, vectors, Filters(), [0.0, 0.0, 1.0], limit=2))) == 2
    for limit in (0, 101):
        with pytest.raises(ValueError):
            hybrid_search(four, vectors, Filters(), [0.0, 0.0, 1.0], limit=limit)
        with pytest.raises(ValueError):
            nearest_products(four, vectors, [0.0, 0.0, 1.0], limit=limit)


def test_bad_query_vectors_fail(four, vectors):
    with pytest.raises(Exception, match="different length|INVALID_ARRAY_INDEX"):
        hybrid_search(four, vectors, Filters(), [1.0, 0.0]).collect()
    for query in ([], [1.0, float("nan"), 0.0]):
        with pytest.raises(ValueError):
            hybrid_search(four, vectors, Filters(), query)


def test_texts_are_scanned_for_the_winners_only(spark, four, vectors, plan_of, tmp_path):
    store.write_catalog(four, str(tmp_path / "catalog"))
    catalog = store.read_catalog(spark, str(tmp_path / "catalog"))
    found = hybrid_search(catalog, vectors, Filters(tono="Light"), [1.0, 0.0, 0.0], limit=1)
    plan = plan_of(found)
    assert "EqualTo(perceived_colour_value_name,Light)" in plan and "EqualTo(article_id,387)" in plan
    assert codes(found) == [38]
    plan = plan_of(nearest_products(catalog, vectors, [1.0, 0.0, 0.0], limit=2))
    assert "In(product_code, [15,38])" in plan and "In(article_id, [157,387])" in plan
    assert codes(hybrid_search(catalog, vectors, Filters(publico="Ladieswear"), [1.0, 0.0, 0.0])) == []


def test_nearest_products_count_all_variants(articles, vectors):
    catalog = articles(
        {"article_id": 7, "product_code": 38}, {"article_id": 3, "product_code": 38},
        {"article_id": 9, "product_code": 15},
    )
    rows = nearest_products(catalog, vectors, [0.6, 0.8, 0.0], limit=3).collect()
    # 27 is the second neighbour but has no article, and is not replaced by another one.
    assert [(r["product_code"], r["article_id"], r["variantes"]) for r in rows] == [(38, 3, 2), (15, 9, 1)]
    assert rows[0]["distancia"] == pytest.approx(0.0, abs=1e-6)


def test_vectors_of_different_length_fail_the_batch(spark, four, vectors, requests):
    longer = vectors.union(spark.createDataFrame([(500, [1.0] * 4)], VECTOR_SCHEMA))
    mixed = longer.withColumn("product_code", F.when(F.col("product_code") == 500, 15).otherwise(F.col("product_code")))
    for table, query in ((vectors, [1.0, 0.0]), (mixed, [1.0, 0.0, 0.0])):
        with pytest.raises(Exception, match="vectors of different length"):
            search_batch(four, table, requests({"query_vec": query})).results.collect()


def test_block_with_nan_duplicates_and_ties():
    x = np.array([[1.0, 0.0], [np.nan, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0]])
    codes, q = np.array([5, 1, 4, 2, 3]), np.array([[1.0, 0.0], [0.0, 1.0]])
    first, second = nearest(x, codes, q, np.array([3, 100]))
    assert codes[first[0]].tolist() == [2, 5, 3]
    assert codes[second[0]].tolist() == [3, 4, 2, 5, 1]


def test_block_merges_keys_and_takes_empty_sides():
    entry = pa.struct([("key_id", pa.int64()), ("article_id", pa.int64()), ("variantes", pa.int64())])
    products = pa.table({
        "product_code": [8, 9], "embedding": pa.array([[1.0, 0.0], [0.0, 1.0]], pa.list_(pa.float32())),
        "under": pa.array([[{"key_id": 1, "article_id": 84, "variantes": 2}, {"key_id": 7, "article_id": 81, "variantes": 3}],
                           [{"key_id": 7, "article_id": 90, "variantes": 1}]], pa.list_(entry)),
    })
    requests = pa.table({
        "query_id": [1, 2, 3], "keys": pa.array([[7, 1], [1], [5]], pa.list_(pa.int64())), "limite": pa.array([9, 9, 9], pa.int32()),
        "query_vec": pa.array([[0.0, 1.0]] * 3, pa.list_(pa.float32())),
    })
    rows = [tuple(r.values())[:4] for r in nearest_in_block(products, requests).to_pylist()]
    assert rows == [(1, 9, 90, 1), (1, 8, 81, 5), (2, 8, 84, 2)]
    assert nearest_in_block(products.slice(0, 0), requests).num_rows == 0
    assert nearest_in_block(products, requests.slice(2)).num_rows == 0


def test_batch_equals_single_requests(four, vectors, requests):
    asked = [
        {}, {"publico": "Menswear"}, {"colores": ["Grey", "Yellow"], "limite": 2}, {"colores_excluidos": ["Pink"]},
    ]
    rows = [{**a, "query_vec": v} for a in asked for v in ([1.0, 0.0, 0.0], [0.0, 0.6, 0.8])]
    got = search_batch(four, vectors, requests(*rows)).results.collect()
    for i, row in enumerate(rows, 1):
        fields = {k: v for k, v in row.items() if k not in ("limite", "query_vec")}
        single = hybrid_search(four, vectors, Filters(**fields), row["query_vec"], row.get("limite", 24)).collect()
        mine = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
        assert [tuple(r)[2:-1] for r in mine] == [tuple(r)[:-1] for r in single]
        assert [r["distancia"] for r in mine] == pytest.approx([r["distancia"] for r in single])


def test_stored_groups_can_be_passed_in(four, vectors, requests):
    asked = requests({"query_vec": [1.0, 0.0, 0.0]})
    found = search_batch(four, vectors, asked, groups=tagged_groups(four)).results
    assert [r["product_code"] for r in found.orderBy("rank").collect()] == [15, 38, 27, 46]


def test_limit_out_of_bounds_fails_the_batch(four, vectors, requests):
    with pytest.raises(Exception, match="limite must be between"):
        search_batch(four, vectors, requests({"query_vec": [1.0, 0.0, 0.0], "limite": 101})).results.collect()


@pytest.mark.parametrize("cell_rows, cell_requests", [(32_768, 8_192), (7, 3), (1, 1)])
def test_any_cell_size_gives_the_exact_answer(spark, articles, requests, cell_rows, cell_requests):
    """Duplicate vectors, a product with most of the articles, and requests that share one key."""
    rng = np.random.default_rng(5)
    colours = ["Red", "Blue", "Black", None]
    rows = [
        {"article_id": i, "product_code": 0 if i % 3 == 0 else i // 4,
         "perceived_colour_master_name": colours[rng.integers(4)]}
        for i in range(160)
    ]
    products = sorted({r["product_code"] for r in rows})
    base = rng.normal(size=(8, 5)).astype(np.float32)
    vector = {p: base[i % 8] for i, p in enumerate(products)}
    asked = [
        {"query_vec": base[j % 8].tolist() if j % 2 else rng.normal(size=5).tolist(), "limite": 1 + j % 9,
         "colores": [[], ["Red"], ["Red", "Blue"]][j % 3], "colores_excluidos": [[], ["Black"]][j % 2]}
        for j in range(12)
    ]
    catalog, table = articles(*rows), requests(*asked)
    stored = spark.createDataFrame([(p, v.tolist()) for p, v in vector.items()], VECTOR_SCHEMA)
    groups = variant_groups(catalog)
    matches = relaxed_keys(table, groups)
    keys = number_keys(matches)
    asking = matches.join(keys.select("key_id", *KEY), KEY).select("query_id", "key_id")
    found = candidates(groups, keys)
    got = rank_candidates(found, stored, asking, table, cell_rows, cell_requests).collect()
    # A vector travels once for each cell of requests, and a request once for each block that it needs.
    assert product_rows(found, stored, 3, 4).count() == 4 * found.select("product_code").distinct().count()
    sent = request_rows(found, asking, table, 3, 4)
    assert sent.count() == sent.select("query_id", "block").distinct().count() <= 3 * len(asked)
    for j, request in enumerate(asked, 1):
        expected = {}
        for r in rows:
            colour = r["perceived_colour_master_name"]
            if request["colores"] and colour not in request["colores"]:
                continue
            if request["colores_excluidos"] and (colour is None or colour in request["colores_excluidos"]):
                continue
            expected.setdefault(r["product_code"], []).append(r["article_id"])
        query = np.float32(request["query_vec"]).astype(np.float64)
        distance = {p: float(np.sqrt(((vector[p].astype(np.float64) - query) ** 2).sum())) for p in expected}
        top = sorted(expected, key=lambda p: (distance[p], p))[: request["limite"]]
        mine = sorted((r for r in got if r["query_id"] == j), key=lambda r: r["rank"])
        assert [r["product_code"] for r in mine] == top
        assert [(r["article_id"], r["variantes"]) for r in mine] == [(min(expected[p]), len(expected[p])) for p in top]
        assert [r["distancia"] for r in mine] == pytest.approx([distance[p] for p in top])


def test_batch_plan_has_no_pairs_and_cuts_before_the_shuffle(spark, plan_of):
    from conftest import SF
    from workload import tables as t

    plan = plan_of(search_batch(t.catalog(spark, SF), t.vectors(spark, SF), t.requests(spark, SF)).results)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in plan


def test_envelope(four, vectors, requests):
    asked = requests(
        {"frase": "chaqueta de lentejuelas", "publico": "Sport", "estampado": "Sequin", "query_vec": [1.0, 0.0, 0.0]},
        {"frase": "un vestido", "publico": "Menswear", "query_vec": [0.0, 1.0, 0.0], "limite": 1},
        {"frase": "nada", "colores_excluidos": ["Pink", "Grey", "Yellow", "Green"], "query_vec": [0.0, 1.0, 0.0]},
    )
    answers = search_batch(four, vectors, asked)
    one, two, three = envelopes(answers).orderBy("query_id").collect()
    assert tuple(one.asDict()) == (
        "query_id", "frase", "total", "filtros_pedidos", "filtros_aplicados", "filtros_relajados", "resultados",
    )
    assert (one["frase"], one["total"], one["filtros_relajados"]) == ("chaqueta de lentejuelas", 1, ["estampado"])
    assert (one["filtros_pedidos"]["estampado"], one["filtros_aplicados"]["estampado"]) == ("Sequin", None)
    # The total counts rows returned, after the limit.
    assert (two["total"], [r["product_code"] for r in two["resultados"]]) == (1, [27])
    assert (three["total"], three["resultados"]) == (0, [])


def test_filter_report(four, vectors, requests):
    asked = requests(
        {"publico": "Menswear", "categoria": "Nightwear", "colores": ["Metal", "Red"], "estampado": "Lace",
         "query_vec": [1.0, 0.0, 0.0]},
        {"query_vec": [1.0, 0.0, 0.0]},
    )
    rows = filter_report(search_batch(four, vectors, asked).requests).orderBy("query_id", "pos").collect()
    assert [tuple(r)[2:] for r in rows] == [
        ("publico", "Menswear", False), ("categoria", "Nightwear", True), ("colores", "Metal, Red", True),
        ("estampado", "Lace", True),
    ]
