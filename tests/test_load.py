"""CSV scan, cleaning, upsert, load figures, stored tables, profile."""

import csv
import random

import pytest
from facetrank.operators import facet_keys, load, profile
from facetrank.plans.load import load_catalog
from facetrank.schema import CATALOG_COLUMNS, CATEGORIA
from facetrank.sources import tables as store
from facetrank.sources.csv import NA_TOKENS, read_catalog_csv, write_catalog_csv
from pyspark.sql import functions as F

# More columns than the catalog has, in an order of their own.
HEADER = ["detail_desc", "season", "article_id", "prod_name", "product_code", "price", *CATALOG_COLUMNS[3:-1]]


def write_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, HEADER, restval="x")
        writer.writeheader()
        writer.writerows(rows)


def test_csv_columns_are_picked_by_name(spark, tmp_path):
    text = 'Soft "cotton", long\nsleeves; ¡cómodo! '
    write_csv(tmp_path / "a.csv", [
        {"article_id": "0108775015", "product_code": "0108775", "prod_name": "Strap top", "detail_desc": text},
        {"article_id": 2, "product_code": 3, "prod_name": "None", "detail_desc": "", "index_group_name": "NA"},
    ])
    one, two = read_catalog_csv(spark, str(tmp_path / "a.csv")).orderBy("seq").collect()
    assert tuple(one.asDict()) == (*CATALOG_COLUMNS, "seq")
    assert (one["article_id"], one["product_code"], one["detail_desc"]) == (108775015, 108775, text)
    assert (two["prod_name"], two["detail_desc"], two["index_group_name"]) == (None, None, None)
    assert two["graphical_appearance_name"] == "x"


def test_missing_value_tokens(spark, tmp_path):
    kept = ["nA", " NA", "none", "0", "-"]
    write_csv(tmp_path / "a.csv", [
        {"article_id": i, "product_code": 1, "prod_name": "p", "detail_desc": token}
        for i, token in enumerate([*NA_TOKENS, *kept])
    ])
    rows = read_catalog_csv(spark, str(tmp_path / "a.csv")).orderBy("article_id").collect()
    assert [r["detail_desc"] for r in rows] == [None] * len(NA_TOKENS) + kept


def test_csv_limit_takes_the_first_rows_in_file_order(spark, tmp_path):
    for part in (2, 1):
        write_csv(tmp_path / f"part-{part}.csv", [
            {"article_id": part * 100 - i, "product_code": 1, "prod_name": "p"} for i in range(5)
        ])
    first = read_catalog_csv(spark, str(tmp_path), limit=7).orderBy("seq").collect()
    assert [r["article_id"] for r in first] == [100, 99, 98, 97, 96, 200, 199]
    assert read_catalog_csv(spark, str(tmp_path)).count() == 10


def test_csv_round_trip(spark, articles, tmp_path):
    rows = articles(
        {"article_id": 1, "product_code": 1, "detail_desc": ' "quoted",\r\n line \\ end" '},
        {"article_id": 2, "product_code": 1, "product_type_name": None},
    )
    write_catalog_csv(rows, str(tmp_path / "out"))
    back = read_catalog_csv(spark, str(tmp_path / "out")).drop("seq")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


@pytest.fixture(scope="module")
def raw(articles):
    return articles(
        {"article_id": 1, "product_code": 100},
        {"article_id": 2, "product_code": 200, "product_group_name": "Furniture"},
        {"article_id": 3, "product_code": 300, "product_group_name": "Cosmetic"},
        {"article_id": 4, "product_code": 400, "product_group_name": "Underwear/nightwear", "detail_desc": None},
        {"article_id": 5, "product_code": 500, "detail_desc": None},
        {"article_id": 6, "product_code": 600, "product_group_name": None},
    )


def test_clean_keeps_known_categories_with_text(raw):
    assert [r["article_id"] for r in load.clean(raw, CATEGORIA).collect()] == [1]


def test_load_report(raw):
    assert load.load_report(raw, CATEGORIA).first().asDict() == {
        "leidas": 6, "fuera_de_lista": 4, "sin_descripcion": 1, "descartadas": 5, "insertadas": 1,
    }


def test_loading_twice_adds_nothing(articles):
    rows = articles(
        {"article_id": 1, "product_code": 100}, {"article_id": 2, "product_code": 100},
        {"article_id": 3, "product_code": 200},
    )
    batch = rows.withColumn("seq", F.monotonically_increasing_id())
    once = load.upsert(rows.limit(0), batch)
    twice = load.upsert(once, batch)
    assert load.catalog_totals(twice).first().asDict() == {"filas": 3, "productos": 2, "variantes_extra": 1}


def test_last_write_wins_also_within_a_batch(articles):
    stored = articles(
        {"article_id": 1, "product_code": 1, "prod_name": "old"}, {"article_id": 2, "product_code": 1, "prod_name": "kept"}
    )
    batch = articles(
        {"article_id": 1, "product_code": 1, "prod_name": "second"},
        {"article_id": 3, "product_code": 2, "prod_name": "new", "graphical_appearance_name": None},
        {"article_id": 1, "product_code": 1, "prod_name": "first"},
    ).withColumn("seq", F.when(F.col("prod_name") == "second", 9).otherwise(1))
    rows = {r["article_id"]: r for r in load.upsert(stored, batch).collect()}
    assert {k: r["prod_name"] for k, r in rows.items()} == {1: "second", 2: "kept", 3: "new"}
    assert rows[3]["graphical_appearance_name"] is None


def test_hot_key_is_cut_before_the_shuffle(articles, plan_of):
    rows = articles({"article_id": 1, "product_code": 1})
    assert "WindowGroupLimit" in plan_of(load.upsert(rows, rows.withColumn("seq", F.lit(1))))


def test_facet_distribution(raw):
    rows = [tuple(r) for r in load.facet_distribution(raw).collect()]
    assert rows[0] == ("categoria", "Accessories", 2)
    assert rows[-1] == ("publico", "Divided", 6)
    assert [r[2] for r in rows if r[0] == "categoria"] == [2, 1, 1, 1, 1]


def test_required_columns_fail_on_null(articles):
    rows = articles({"article_id": 1, "product_code": 1})
    assert store.check_catalog(rows).count() == 1
    for name in ("article_id", "product_code", "prod_name"):
        broken = rows.withColumn(name, F.lit(None).cast(rows.schema[name].dataType))
        with pytest.raises(Exception, match=f"{name} must not be null"):
            store.check_catalog(broken).collect()


def test_catalog_versions(spark, raw, tmp_path):
    path = str(tmp_path / "v1")
    store.write_catalog(raw, path)
    assert sorted(map(tuple, store.read_catalog(spark, path).collect()), key=lambda r: r[0]) == sorted(
        map(tuple, raw.collect()), key=lambda r: r[0])
    with pytest.raises(Exception, match="(?i)exists"):
        store.write_catalog(raw.limit(1), path)
    assert store.read_catalog(spark, path).count() == 6


def test_bucketed_catalog_is_joined_in_place(spark, raw, plan_of, tmp_path):
    stored = store.save_catalog_table(raw, "catalog_bucketed", 4, str(tmp_path / "bucketed"))
    assert sorted(r["article_id"] for r in stored.collect()) == [1, 2, 3, 4, 5, 6]
    batch = raw.filter("article_id < 3").withColumn("seq", F.lit(1))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = load.upsert(stored, batch)
        plan = plan_of(merged)
        assert merged.count() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Bucketed: true" in plan
    # The only shuffles are those of the batch: its keys, and its rows to find the last ones.
    assert plan.count("Exchange\n") == 2
    with pytest.raises(Exception, match="(?i)exists"):
        store.save_catalog_table(raw, "catalog_bucketed", 4)


def test_repeated_keys(articles):
    rows = articles({"article_id": 1, "product_code": 1}, {"article_id": 1, "product_code": 2}, {"article_id": 3, "product_code": 2})
    assert [tuple(r) for r in store.repeated_keys(rows, "article_id").collect()] == [(1, 2)]
    with pytest.raises(store.DuplicateKey):
        store.refuse_repeated(rows, "article_id")


def test_column_profile_and_value_counts(spark):
    wide = [(i, f"v{i % 3}" if i % 4 else None, "x" * 100 + str(i // 2), f"u{i}") for i in range(100)]
    df = spark.createDataFrame(wide, "id long, few string, text string, many string")
    rows = {r["columna"]: (r["filas"], r["nulos"], r["distintos"]) for r in profile.column_profile(df).collect()}
    assert rows == {"few": (100, 25, 3), "text": (100, 0, 50), "many": (100, 0, 100)}
    facets = {r["columna"]: r["es_faceta"] for r in profile.facet_candidates(df).collect()}
    assert facets == {"few": True, "text": True, "many": False}
    counts = [tuple(r) for r in profile.value_counts(df, max_values=10).collect()]
    assert counts == [("few", "v0", 25), ("few", "v1", 25), ("few", "v2", 25)]
    assert profile.value_counts(df, max_values=1).count() == 0


def test_text_nulls_and_sample(raw):
    assert profile.text_nulls(raw).first()["nulos"] == 2
    assert [r["article_id"] for r in profile.text_sample(raw, "article_id").collect()] == [1, 2, 3]


def test_first_rows_cut_at_any_place_equal_the_sorted_ones(spark, tmp_path):
    for name, ids in (("a", range(3)), ("b", range(3, 4)), ("c", range(4, 9))):
        write_csv(tmp_path / f"{name}.csv", [{"article_id": i, "product_code": 1, "prod_name": "p"} for i in ids])
    for limit in range(1, 11):
        first = read_catalog_csv(spark, str(tmp_path), limit=limit)
        assert sorted(r["article_id"] for r in first.collect()) == list(range(min(limit, 9)))
        assert "TakeOrdered" not in first._jdf.queryExecution().executedPlan().toString()


def test_load_reads_its_input_once(spark, raw, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = raw.withColumn("seq", F.col("article_id")).mapInArrow(counted, raw.withColumn("seq", F.col("article_id")).schema)
    report = load_catalog(rows, CATEGORIA, str(tmp_path / "v1")).first().asDict()
    assert read.value == 6
    assert report == {
        "leidas": 6, "fuera_de_lista": 4, "sin_descripcion": 1, "descartadas": 5, "insertadas": 1,
        "filas": 1, "productos": 1, "variantes_extra": 0,
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_refreshed_groups_equal_a_rebuild(articles, seed):
    """Random batches: new articles, changed facets, articles that move to another product."""
    rng = random.Random(seed)

    def rows(ids):
        return [{"article_id": i, "product_code": rng.randrange(12), "perceived_colour_master_name": rng.choice(["Red", "Pink", None]),
                 "graphical_appearance_name": rng.choice(["Dot", "Lace"])} for i in ids]

    before = articles(*rows(range(60)))
    batch = articles(*rows(rng.sample(range(80), 9))).withColumn("seq", F.col("article_id"))
    after = load.upsert(before, batch)
    fresh = facet_keys.refresh_groups(facet_keys.variant_groups(before), before, after, batch)
    want = facet_keys.variant_groups(after)
    assert sorted(map(str, fresh.select(want.columns).collect())) == sorted(map(str, want.collect()))
