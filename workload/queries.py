"""Registered queries: each runs one operator of the library over the whole given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.functions import text, vectors as vec
from facetrank.operators import answers, encoder, facet_keys, load, profile, relax, versions
from facetrank.plans import batch, buckets, index, phrase, reports, search
from facetrank.plans import load as load_plan
from facetrank.schema import CATALOG_COLUMNS, FILTER_FIELDS, HARD_FIELDS, Filters
from facetrank.shared import scratch_path, write_once
from facetrank.sources import csv, tables as store
from workload import tables as t

# The requests of the single-request queries; the SQL checks state them again.
HYBRID_VECTOR = 7
HYBRID = Filters(publico="PROMO", colores_excluidos=("red",))
FACETS = Filters(categoria="bolt", tono="Light")
IN_NOT_IN = Filters(colores=("red", "blue", "old"), colores_excluidos=("old",), publico="SMALL")
COUNTED = Filters(publico="MEDIUM", colores_excluidos=("blue", "hot"))
KNN_VECTOR = 11
KNN_LIMIT = 30
#: Rows of a CSV file, about: a task sorts and writes one file.
FILE_ROWS = 32_768


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distancia", F.round("distancia", 4))


def _lists_as_text(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.array_join(c, "|"))
    return df


# One request at a time


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    query_vec = t.vector_of(spark, sf, HYBRID_VECTOR)
    return _rounded(search.hybrid_search(t.catalog(spark, sf), t.vectors(spark, sf), HYBRID, query_vec))


def facet_search(spark, sf):
    return search.facet_search(t.catalog(spark, sf), FACETS)


def facet_in_notin(spark, sf):
    return search.facet_search(t.catalog(spark, sf), IN_NOT_IN, limit=100)


def facet_count(spark, sf):
    return search.facet_count(t.catalog(spark, sf), COUNTED)


def knn_global(spark, sf):
    query_vec = t.vector_of(spark, sf, KNN_VECTOR)
    return _rounded(
        search.nearest_products(t.catalog(spark, sf), t.vectors(spark, sf), query_vec, KNN_LIMIT)
    )


def knn_buckets(spark, sf):
    """The nearest products through buckets, exactly."""
    stored = buckets.build_buckets(t.vectors(spark, sf), scratch_path(spark, "buckets"))
    query_vec = t.vector_of(spark, sf, KNN_VECTOR)
    return _rounded(buckets.nearest_by_buckets(t.catalog(spark, sf), stored, query_vec, KNN_LIMIT))


# Tables of requests


def strict_requests(spark, sf):
    return batch.rejected_requests(t.view(spark, sf, t.UNCHECKED_REQUESTS), t.VOCABULARY)


def _accepted(spark, sf):
    return batch.accepted_requests(t.view(spark, sf, t.UNCHECKED_REQUESTS), t.VOCABULARY)


def facet_batch(spark, sf):
    return batch.facet_search_batch(t.catalog(spark, sf), _accepted(spark, sf))


def facet_envelopes(spark, sf):
    asked = _accepted(spark, sf)
    found = reports.facet_envelopes(asked, batch.facet_search_batch(t.catalog(spark, sf), asked))
    return found.select(
        "query_id",
        "total",
        text.filters_json("filtros_aplicados.", HARD_FIELDS).alias("filtros_aplicados"),
        F.array_join(F.transform("resultados", lambda r: r["product_code"].cast("string")), ",").alias("productos"),
    )


def relax_batch(spark, sf):
    relaxed = relax.relax(t.requests(spark, sf), t.catalog(spark, sf))
    shown = relaxed.select("query_id", "filtros_relajados", *[f"aplicado_{f}" for f in FILTER_FIELDS])
    return _lists_as_text(shown, "filtros_relajados", "aplicado_colores", "aplicado_colores_excluidos")


def _answers(spark, sf) -> batch.Answers:
    return batch.search_batch(t.catalog(spark, sf), t.vectors(spark, sf), t.requests(spark, sf))


def hybrid_batch(spark, sf):
    return _rounded(_answers(spark, sf).results)


def search_envelopes(spark, sf):
    return reports.envelopes(_answers(spark, sf)).select(
        "query_id",
        "frase",
        "total",
        text.filters_json("filtros_pedidos.").alias("filtros_pedidos"),
        text.filters_json("filtros_aplicados.").alias("filtros_aplicados"),
        F.array_join("filtros_relajados", ", ").alias("filtros_relajados"),
        F.array_join(F.transform("resultados", lambda r: r["product_code"].cast("string")), ",").alias("productos"),
    )


def filter_report(spark, sf):
    return reports.filter_report(relax.relax(t.requests(spark, sf), t.catalog(spark, sf)))


def filters_as_json(spark, sf):
    return t.requests(spark, sf).select(
        "query_id", text.filters_json().alias("completo"), text.compact_filters_json().alias("compacto")
    )


# Load


def catalog_clean(spark, sf):
    return load.clean(t.catalog(spark, sf), t.WHITELIST)


def catalog_from_csv(spark, sf):
    path = scratch_path(spark, "csv")
    csv.write_catalog_csv(t.catalog(spark, sf), path)
    return load.clean(csv.read_catalog_csv(spark, path), t.WHITELIST).drop("seq")


def catalog_first_rows(spark, sf):
    """The first two thirds of a catalog in several files, in file order."""
    path = scratch_path(spark, "csv")
    whole = t.catalog(spark, sf)
    n = whole.count()
    files = max(8, -(-n // FILE_ROWS))
    csv.write_catalog_csv(whole.repartitionByRange(files, "article_id").sortWithinPartitions("article_id"), path)
    return csv.read_catalog_csv(spark, path, limit=n * 2 // 3).drop("seq")


def load_catalog(spark, sf):
    """Two loads, the second over the first; the report of each."""
    first, second = scratch_path(spark, "catalog"), scratch_path(spark, "catalog")
    rows = t.view(spark, sf, t.FIRST_LOAD).withColumn("seq", F.col("article_id"))
    one = load_plan.load_catalog(rows, t.WHITELIST, first)
    stored = store.read_catalog(spark, first)
    two = load_plan.load_catalog(t.view(spark, sf, t.SECOND_LOAD), t.WHITELIST, second, stored)
    return one.withColumn("carga", F.lit(1)).unionByName(two.withColumn("carga", F.lit(2)))


def upsert_last_wins(spark, sf):
    return load.upsert(t.view(spark, sf, t.FIRST_LOAD), t.view(spark, sf, t.SECOND_LOAD))


def groups_refreshed(spark, sf):
    """Variant groups of the first load, brought up to date for the second one."""
    first, second = t.view(spark, sf, t.FIRST_LOAD), t.view(spark, sf, t.SECOND_LOAD)
    after = load.upsert(first, second)
    return facet_keys.refresh_groups(facet_keys.variant_groups(first), first, after, second)


def groups_current(spark, sf):
    """Stored groups of two versions of the catalog against each of them: only those of the same version are taken."""
    first, second = t.view(spark, sf, t.FIRST_LOAD), t.view(spark, sf, t.SECOND_LOAD)
    catalogs = {1: first, 2: load.upsert(first, second)}
    paths = {number: scratch_path(spark, "groups") for number in catalogs}
    versions.tagged_groups(first).write.parquet(paths[1])
    stored = {1: spark.read.parquet(paths[1])}
    versions.refreshed_groups(stored[1], first, catalogs[2], second).write.parquet(paths[2])
    stored[2] = spark.read.parquet(paths[2])
    shown = [
        groups.agg(F.count(F.lit(1)).alias("grupos"), F.sum("variantes").alias("articulos")).select(
            "*", F.lit(a).alias("version"), F.lit(b).alias("catalogo"), F.lit(versions.is_current(groups, catalogs[b])).alias("vigente")
        )
        for a, groups in stored.items() for b in catalogs
    ]
    return reduce(DataFrame.unionByName, shown)


def catalog_checked(spark, sf):
    """Write a version of the catalog, read it back, and look for repeated keys."""
    path = scratch_path(spark, "catalog")
    store.write_catalog(t.catalog(spark, sf), path)
    stored = store.read_catalog(spark, path)
    return stored.agg(F.count("*").alias("filas"), F.count("detail_desc").alias("con_texto")).withColumn(
        "repetidas", F.lit(store.repeated_keys(stored, "article_id").count())
    )


def vectors_stored(spark, sf):
    """Write part of the vectors, append the others, read the index back."""
    path = scratch_path(spark, "vectors")
    given = t.load(spark, sf, "embeddings").withColumnRenamed("vec_id", "product_code")
    store.write_vectors(given.filter("label <> 0"), path, t.DIM, "given")
    store.append_vectors(given.filter("label = 0"), path, t.DIM, "given")
    stored = store.read_vectors(spark, path, "given")
    return stored.select("product_code", F.size("embedding").alias("dim"), F.round(vec.l2_norm(F.col("embedding")), 4).alias("norma"))


def tables_ready(spark, sf):
    """Readiness of the tables, and of a catalog that lost its rows in cleaning."""
    whole, index_rows = t.catalog(spark, sf), t.vectors(spark, sf)
    return whole.agg(F.count("*").alias("filas")).select(
        "filas",
        F.lit(store.ready(whole, index_rows)).alias("listas"),
        F.lit(store.ready(load.clean(whole, ["Furniture"]), index_rows)).alias("listas_sin_filas"),
    )


def catalog_totals(spark, sf):
    return load.catalog_totals(t.catalog(spark, sf))


def facet_distribution(spark, sf):
    return load.facet_distribution(t.catalog(spark, sf))


def load_report(spark, sf):
    return load.load_report(t.catalog(spark, sf), t.WHITELIST)


# Profile


def column_profile(spark, sf):
    return profile.column_profile(t.catalog(spark, sf))


def profile_sketched(spark, sf):
    """Every column of two loads: exact figures of both, and whether the merged sketches of each are within three errors."""
    loads = [t.view(spark, sf, sql).select(*CATALOG_COLUMNS) for sql in (t.FIRST_LOAD, t.SECOND_LOAD)]
    stored = [write_once(profile.column_sketches(rows), "sketches") for rows in loads]
    near = profile.merge_sketches(reduce(DataFrame.unionByName, stored))
    near = near.select("columna", F.col("filas").alias("_filas"), F.col("nulos").alias("_nulos"), F.col("distintos").alias("_distintos"))
    exact = profile.column_profile(reduce(DataFrame.unionByName, loads), every_type=True)
    bound = 3 * 1.04 / 2 ** (profile.SKETCH_LG_K / 2)
    close = F.abs(F.col("_distintos") - F.col("distintos")) <= F.lit(bound) * F.col("distintos")
    same = (F.col("_filas") == F.col("filas")) & (F.col("_nulos") == F.col("nulos"))
    return exact.join(near, "columna").select("columna", "filas", "nulos", "distintos", (same & close).alias("dentro"))


def value_counts(spark, sf):
    return profile.value_counts(t.catalog(spark, sf))


def text_nulls(spark, sf):
    return profile.text_nulls(t.catalog(spark, sf))


def text_sample(spark, sf):
    return profile.text_sample(t.catalog(spark, sf), "article_id")


# Vectors


def masked_mean_pool(spark, sf):
    pooled = vec.masked_mean_pool(t.tokens(spark, sf), "text_id", t.DIM)
    return pooled.select("text_id", F.posexplode("vec").alias("pos", "valor")).withColumn(
        "valor", F.round("valor", 4) + F.lit(0.0)
    )


def l2_normalize(spark, sf):
    """Vectors scaled by their label, back to unit length; label 0 makes zero vectors, which stay zero."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    unit = t.load(spark, sf, "embeddings").select("vec_id", "embedding", vec.l2_normalize(scaled).alias("unit"))
    return unit.select(
        "vec_id",
        F.round(vec.l2_norm(F.col("unit")), 4).alias("norma"),
        (F.round(F.element_at("unit", 1), 4) + F.lit(0.0)).alias("primero"),
        F.round(vec.l2_distance(F.col("unit"), F.col("embedding")), 4).alias("distancia"),
    )


# Index


def product_texts(spark, sf):
    return index.product_texts(t.catalog(spark, sf))


def pending_products(spark, sf):
    return index.pending_products(t.catalog(spark, sf), t.view(spark, sf, t.PARTIAL_INDEX))


def index_build(spark, sf):
    """Build an index over half the catalog, extend it to the whole, and show what is stored."""
    path = scratch_path(spark, "index")
    whole = t.catalog(spark, sf)
    model = encoder.HashedEncoder.fit(index.product_texts(whole), "texto", t.DIM)
    first = index.build_index(t.view(spark, sf, t.FIRST_LOAD), path, model)
    second = index.extend_index(whole, path, model)
    third = index.extend_index(whole, path, model)
    return store.read_vectors(spark, path, model.model_id).select(
        "product_code",
        F.size("embedding").alias("dim"),
        F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 10_000).cast("long").cast("string")), ",").alias("valores"),
        F.round(vec.l2_norm(F.col("embedding")), 4).alias("norma"),
        F.lit(first.indexados).alias("primera"),
        F.lit(second.indexados).alias("segunda"),
        F.lit(third.indexados).alias("tercera"),
        F.lit(second.total).alias("total"),
    )


def index_in_commits(spark, sf):
    """An index over half the catalog in commits, then the rest of the whole catalog as after a lost run."""
    path = scratch_path(spark, "index")
    whole = t.catalog(spark, sf)
    model = encoder.HashedEncoder.fit(index.product_texts(whole), "texto", t.DIM)
    half = t.view(spark, sf, t.FIRST_LOAD)
    per_commit = half.count() // 8
    first = index.build_index_in_commits(half, path, model, per_commit)
    second = index.build_index_in_commits(whole, path, model, per_commit)
    return store.read_vectors(spark, path, model.model_id).select(
        "product_code",
        F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 10_000).cast("long").cast("string")), ",").alias("valores"),
        F.lit(first.indexados).alias("primera"),
        F.lit(second.indexados).alias("segunda"),
        F.lit(second.total).alias("total"),
    )


# Model answers


def validate_answers(spark, sf):
    typed = answers.validate_answers(t.view(spark, sf, t.MODEL_ANSWERS), t.VOCABULARY)
    return _lists_as_text(typed, "colores", "colores_excluidos", "campos_descartados")


def answers_to_search(spark, sf):
    """Model answers to ranked products; the vector of a request is a given one, by its number."""
    typed = answers.validate_answers(t.view(spark, sf, t.MODEL_ANSWERS), t.VOCABULARY)
    given = t.load(spark, sf, "embeddings").select(F.col("vec_id").alias("_vec"), F.col("embedding").alias("query_vec"))
    asked = typed.withColumn("_vec", F.col("query_id") % given.count()).join(given, "_vec").drop("_vec")
    asked = asked.withColumn("limite", F.lit(3))
    found = batch.search_batch(t.catalog(spark, sf), t.vectors(spark, sf), asked)
    return _rounded(found.results.select("query_id", "rank", "product_code", "article_id", "variantes", "distancia"))


def phrase_search(spark, sf):
    """Answers to ranked products through the encoder alone: its index and its request vectors."""
    path = scratch_path(spark, "index")
    whole = load.clean(t.catalog(spark, sf), t.WHITELIST)
    model = encoder.HashedEncoder.fit(index.product_texts(whole), "texto", t.DIM)
    index.build_index(whole, path, model)
    typed = answers.validate_answers(t.view(spark, sf, t.MODEL_ANSWERS), t.VOCABULARY)
    asked = index.embed_requests(typed, model).withColumn("limite", F.lit(5))
    found = batch.search_batch(whole, store.read_vectors(spark, path, model.model_id), asked)
    return _rounded(found.results.select("query_id", "rank", "product_code", "article_id", "variantes", "distancia"))


def phrase_envelopes(spark, sf):
    """The whole way from a phrase and its answers to an envelope, by one call."""
    path = scratch_path(spark, "index")
    whole = load.clean(t.catalog(spark, sf), t.WHITELIST)
    model = encoder.HashedEncoder.fit(index.product_texts(whole), "texto", t.DIM)
    index.build_index(whole, path, model)
    found = phrase.search_phrases(whole, path, t.view(spark, sf, t.MODEL_ANSWERS), t.VOCABULARY, model, limit=5)
    return found.select(
        "query_id", "frase", "total", F.array_join("filtros_relajados", ", ").alias("filtros_relajados"),
        F.array_join(F.transform("productos", lambda p: p.cast("string")), ",").alias("productos"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search, facet_search, facet_in_notin, facet_count, knn_global, knn_buckets,
        strict_requests, facet_batch, facet_envelopes, relax_batch, hybrid_batch, search_envelopes,
        filter_report, filters_as_json,
        catalog_clean, catalog_from_csv, catalog_first_rows, load_catalog, upsert_last_wins, groups_refreshed, groups_current, catalog_checked, vectors_stored,
        tables_ready, catalog_totals, facet_distribution, load_report,
        column_profile, profile_sketched, value_counts, text_nulls, text_sample,
        masked_mean_pool, l2_normalize,
        product_texts, pending_products, index_build, index_in_commits,
        validate_answers, answers_to_search, phrase_search, phrase_envelopes,
    )
}
