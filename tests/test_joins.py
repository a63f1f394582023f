"""Joins of tables that grow with the input: compressed files must not make Spark broadcast them."""

import re

from facetrank.operators.facet_keys import candidates, matching_keys, number_keys, request_levels, variant_groups
from facetrank.operators.ranking import request_rows
from facetrank.operators.relax import apply_relaxation
from facetrank.plans.batch import search_batch
from facetrank.schema import VECTOR_SCHEMA
from facetrank.shared import write_once
from pyspark.sql import functions as F
from workload import tables as t


def test_requests_are_not_broadcast(spark, four, requests, plan_of):
    asked = write_once(requests({"query_vec": [1.0, 0.0, 0.0]}), "requests")
    matches = write_once(spark.createDataFrame([(1, 0)], "query_id long, level int"), "matches")
    assert "BroadcastExchange" not in plan_of(apply_relaxation(asked, matches))
    held = spark.createDataFrame([(3, 15)], "key_id long, product_code long")
    asking = spark.createDataFrame([(1, 3)], "query_id long, key_id long")
    plan = plan_of(request_rows(held, asking, asked, 1, 1))
    by_request = re.findall(r"\(\d+\) (\w+Join).*\nLeft keys \[1\]: \[query_id", plan)
    assert by_request == ["SortMergeJoin"], plan


def test_levels_and_groups_are_not_broadcast(spark, four, requests, plan_of):
    groups = write_once(variant_groups(four), "groups")
    levels = request_levels(write_once(requests({"publico": "Sport"}, {}), "requests"))
    matches = matching_keys(levels, groups)
    assert re.findall(r"\(\d+\) (\w+Join).*\nLeft keys \[5\]: \[mask", plan_of(matches)) == ["SortMergeJoin"]
    found = candidates(groups, number_keys(write_once(matches, "matches")))
    assert re.findall(r"\(\d+\) (\w+Join).*\nLeft keys \[10\]", plan_of(found)) == ["SortMergeJoin"]
    assert found.select("product_code").distinct().count() == 4


def test_vectors_are_not_broadcast(spark, four, requests, plan_of):
    vectors = spark.createDataFrame([(15, [1.0, 0.0, 0.0])], VECTOR_SCHEMA)
    found = search_batch(four, vectors, requests({"query_vec": [1.0, 0.0, 0.0]})).results
    on_product = re.findall(r"\(\d+\) (\w+Join).*\nLeft keys \[1\]: \[product_code", plan_of(found))
    assert on_product and set(on_product) == {"SortMergeJoin"}
    assert [r["product_code"] for r in found.collect()] == [15]


def test_large_given_tables_with_small_files_are_not_broadcast(spark, plan_of, tmp_path):
    part = spark.range(t.BROADCAST_ROWS + 1).select(
        F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("SMALL").alias("p_type"),
        F.lit("Brand#1").alias("p_brand"), F.lit(1).alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    described = t.catalog(spark, str(tmp_path)).filter("detail_desc IS NOT NULL")
    assert "BroadcastExchange" not in plan_of(described)
    assert variant_groups(described).count() == 3
