"""What large batches leave on disk: vectors and requests once each, and no shuffle files of finished steps."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from facetrank.operators import ranking
from facetrank.operators.cells import Cell, _entries
from facetrank.operators.encoder import HashedEncoder
from facetrank.plans import index
from facetrank.plans.phrase import search_phrases
from facetrank.schema import CLOTHING, VECTOR_SCHEMA
from facetrank.shared import write_once
from pyspark.sql import functions as F
from workload import tables as t


@pytest.fixture
def ranked_input(spark):
    """40 products under one key, every third under another one too; 12 requests for either or both keys, equal vectors among them."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(9, 4)).astype(np.float32)
    vector = {p: base[p % 9] for p in range(40)}
    held = [(k, p, 100 * p + k, 1 + k) for p in vector for k in (0, 1) if k == 0 or p % 3 == 0]
    asks = {q: [[0], [1], [0, 1]][q % 3] for q in range(1, 13)}
    queries = {q: base[q % 9] if q % 2 else rng.normal(size=4).astype(np.float32) for q in asks}
    return vector, held, asks, queries, (
        spark.createDataFrame(held, "key_id long, product_code long, article_id long, variantes long"),
        spark.createDataFrame([(p, v.tolist()) for p, v in vector.items()], VECTOR_SCHEMA),
        spark.createDataFrame([(q, k) for q, keys in asks.items() for k in keys], "query_id long, key_id long"),
        spark.createDataFrame([(q, v.tolist(), 1 + q % 5) for q, v in queries.items()], "query_id long, query_vec array<float>, limite int"),
    )


# Four cells that read a block, four that read two, and two cells with two stripes of a block each.
@pytest.mark.parametrize("block_products, cell_requests", [(40, 2), (20, 2), (20, 6)])
def test_blocks_and_cells_copy_nothing(spark, ranked_input, monkeypatch, block_products, cell_requests):
    vector, held, asks, queries, tables = ranked_input
    sent = []
    for name in ("product_rows", "request_rows"):
        made = getattr(ranking, name)
        monkeypatch.setattr(ranking, name, lambda *a, made=made, **b: sent.append(made(*a, **b)) or sent[-1])
    got = ranking.rank_candidates(*tables, block_products, cell_requests).collect()
    # With copies it was a row for each vector and cell, and for each request and block.
    assert [rows.count() for rows in sent] == [len(vector), len(asks)]
    for q, keys in asks.items():
        found = {}
        for k, p, article, n in held:
            if k in keys:
                found.setdefault(p, []).append((article, n))
        distance = {p: float(np.sqrt(((vector[p].astype(float) - queries[q].astype(float)) ** 2).sum())) for p in found}
        top = sorted(found, key=lambda p: (distance[p], p))[:1 + q % 5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["product_code"], r["article_id"], r["variantes"]) for r in mine] == [
            (p, min(a for a, _ in found[p]), sum(n for _, n in found[p])) for p in top]
        assert [r["distancia"] for r in mine] == pytest.approx([distance[p] for p in top])


def test_a_cell_may_meet_blocks_in_any_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)).astype(np.float32)[rng.integers(0, 150, 400)]
    x[::9, 1] = np.nan
    entry = pa.struct([("key_id", pa.int64()), ("article_id", pa.int64()), ("variantes", pa.int64())])
    under = [[{"key_id": k, "article_id": 10 * i, "variantes": 1} for k in range(3) if i % (k + 1) == 0] for i in range(400)]
    products = pa.table({"product_code": rng.permutation(400), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())),
                         "under": pa.array(under, pa.list_(entry))})
    requests = pa.table({
        "query_id": np.arange(90), "keys": pa.array([[[0], [2], [1, 2]][i % 3] for i in range(90)], pa.list_(pa.int64())),
        "limite": pa.array(rng.integers(1, 101, 90), pa.int32()), "query_vec": pa.array(rng.normal(size=(90, 6)).tolist(), pa.list_(pa.float32()))})

    def met(*blocks):
        cell = Cell(requests)
        for block in blocks:
            cell.meet(block, _entries(block))
        return [tuple(map(repr, r.values())) for r in cell.best().to_pylist()]

    parts = [products.slice(a, 100).combine_chunks() for a in (200, 0, 300, 100)]
    assert met(products) == met(*parts) == met(*parts[::-1])


def _shuffled(spark) -> int:
    """Bytes of shuffle files."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*.data"))


def test_finished_steps_leave_no_shuffle_files(spark, articles, tmp_path):
    rng = np.random.default_rng(8)
    texts = ["".join(chr(c) for c in rng.integers(97, 123, 2_000)) for _ in range(60)]
    catalog = articles(*[{"article_id": i, "product_code": i // 2, "detail_desc": said} for i, said in enumerate(texts)])
    before = _shuffled(spark)
    write_once(catalog.groupBy("product_code").agg(F.max("detail_desc").alias("said")), "said")
    encoder = HashedEncoder.fit(index.product_texts(catalog), "texto", 8)
    index.build_index(catalog, str(tmp_path / "index"), encoder)
    # Three shuffles of the texts were left, 120 KB at least; the count of the index leaves a few rows.
    assert _shuffled(spark) < before + 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_product_codes_of_envelopes_come_without_texts(spark, four, plan_of, tmp_path):
    path = str(tmp_path / "index")
    encoder = HashedEncoder.fit(index.product_texts(four), "texto", 16)
    index.build_index(four, path, encoder)
    phrases = spark.createDataFrame(
        [(1, "rain hat", '{"publico":"Sport"}', None), (2, "wool", '{"colores_excluidos":["Yellow","Grey","Green","Pink"]}', None), (3, "shorts", None, None)],
        "query_id long, frase string, response_1 string, response_2 string")
    found = search_phrases(four, path, phrases, CLOTHING, encoder, limit=2)
    rows = {r["query_id"]: r for r in found.collect()}
    assert {q: r["productos"] for q, r in rows.items()} == {q: [p["product_code"] for p in r["resultados"]] for q, r in rows.items()}
    assert (rows[1]["productos"], rows[2]["productos"], len(rows[3]["productos"])) == ([15], [], 2)
    assert rows[1]["resultados"][0]["detail_desc"] == "Woven by hand."
    assert "detail_desc" in plan_of(found).split("Exchange", 1)[1]
    lists = plan_of(found.select("query_id", "productos"))
    assert "collect_list" in lists and not any("detail_desc" in line for line in lists.splitlines() if "collect_list" in line)


def test_texts_of_few_articles_are_not_shuffled(spark, plan_of, tmp_path):
    spark.range(20).select(
        F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("SMALL").alias("p_type"), F.lit("Brand#1").alias("p_brand"),
        F.lit(2).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(t.BROADCAST_ROWS + 1).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    whole = t.catalog(spark, str(tmp_path))
    described = whole.filter("detail_desc IS NOT NULL")
    plan = plan_of(described)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert described.count() == 20 and whole.count() == 20
