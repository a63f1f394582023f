"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables, BENCH_CPUS: cores. All queries run twice in the same session and the
second pass counts, as in a service that is up. The registered queries derive their catalog from the
given tables each time; the `stored_` ones first load it (`store_catalog`) and then search the stored tables.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from functools import partial
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from facetrank.operators.versions import tagged_groups  # noqa: E402
from facetrank.plans import batch, search  # noqa: E402
from facetrank.shared import scratch_path  # noqa: E402
from facetrank.sources import tables as store  # noqa: E402
from workload import queries  # noqa: E402
from workload import tables as t  # noqa: E402
from workload.session import local_session, ship_package  # noqa: E402

HEADLINE = (
    "hybrid_search", "facet_search", "knn_global", "relax_batch", "hybrid_batch", "facet_batch",
    "filter_report", "validate_answers", "answers_to_search", "catalog_clean", "catalog_from_csv",
    "upsert_last_wins", "facet_distribution", "column_profile", "masked_mean_pool", "index_build",
)


def run(query) -> float:
    start = time.perf_counter()
    result = query()
    if result is not None:
        result.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


class Stored:
    """Catalog, variant groups and vectors as a load job leaves them; each load writes a new version."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def store_catalog(self) -> None:
        paths = {name: scratch_path(self.spark, name) for name in ("catalog", "groups", "vectors")}
        store.write_catalog(t.catalog(self.spark, self.sf_dir), paths["catalog"])
        self.catalog = store.read_catalog(self.spark, paths["catalog"])
        tagged_groups(self.catalog).write.parquet(paths["groups"])
        self.groups = self.spark.read.parquet(paths["groups"])
        store.write_vectors(t.vectors(self.spark, self.sf_dir), paths["vectors"], t.DIM, "given")
        self.vectors = store.read_vectors(self.spark, paths["vectors"], "given")
        self.query_vec = t.vector_of(self.spark, self.sf_dir, queries.HYBRID_VECTOR)

    def stored_hybrid_search(self):
        return search.hybrid_search(self.catalog, self.vectors, queries.HYBRID, self.query_vec)

    def stored_facet_search(self):
        return search.facet_search(self.catalog, queries.FACETS)

    def stored_knn_global(self):
        return search.nearest_products(self.catalog, self.vectors, self.query_vec)

    def stored_hybrid_batch(self):
        asked = t.requests(self.spark, self.sf_dir)
        return batch.search_batch(self.catalog, self.vectors, asked, groups=self.groups).results


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)))
    ship_package(spark)
    stored = Stored(spark, sf_dir)
    timed = {name: partial(queries.QUERIES[name], spark, sf_dir) for name in HEADLINE}
    timed |= {f.__name__: f for f in (
        stored.store_catalog, stored.stored_hybrid_search, stored.stored_facet_search, stored.stored_knn_global,
        stored.stored_hybrid_batch,
    )}
    seconds = {}
    for _ in ("warm-up", "measured"):
        for name, query in timed.items():
            seconds[name] = round(run(query), 3)
    requests = t.requests(spark, sf_dir).count()
    answers = t.view(spark, sf_dir, t.MODEL_ANSWERS).count()
    products = t.catalog(spark, sf_dir).select("product_code").distinct().count()
    rates = {
        "searches_per_sec": round(requests / seconds["stored_hybrid_batch"], 1),
        "answers_validated_per_sec": round(answers / seconds["validate_answers"], 1),
        # index_build fits the encoder, builds half the index, extends it, and finds nothing more to add.
        "products_indexed_per_sec": round(products / seconds["index_build"], 1),
    }
    sf = re.search(r"sf([0-9.]+)$", sf_dir.rstrip("/"))
    print(json.dumps({
        "metric": "total_wall_clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rates": rates,
        "sf": float(sf.group(1)) if sf else None,
    }))


if __name__ == "__main__":
    main()
