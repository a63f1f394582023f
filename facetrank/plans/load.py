"""From raw rows to a new version of the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation

from facetrank.operators import load
from facetrank.schema import CATALOG_COLUMNS
from facetrank.shared import write_once
from facetrank.sources.tables import read_catalog, write_catalog

FIGURES = ("leidas", "fuera_de_lista", "sin_descripcion", "descartadas", "insertadas")


def load_catalog(
    rows: DataFrame, categories: Sequence[str], path: str, stored: DataFrame | None = None, seq: str = "seq"
) -> DataFrame:
    """Clean `rows`, put them over `stored` and write the result as a new version at `path`.

    One row: the figures of `load_report` and the totals of the written version. Of rows that share an `article_id` the last one by
    `seq` wins. `path` must be new; the stored version is not touched, so a failed load costs nothing. Variant groups
    that were stored for the old version are those of the old version: see `facet_keys.refresh_groups`.

    `rows` are read once: what is kept of them is stored on the way, and the figures are counted by that write.
    """
    seen = Observation()
    counted = rows.observe(seen, *load.figures(categories))
    kept = write_once(load.clean(counted, categories).select(*CATALOG_COLUMNS, seq), "loaded")
    before = stored if stored is not None else kept.select(*CATALOG_COLUMNS).limit(0)
    write_catalog(load.upsert(before, kept, seq), path)
    totals = load.catalog_totals(read_catalog(rows.sparkSession, path)).first().asDict()
    report = {**{name: seen.get[name] for name in FIGURES}, **totals}
    return rows.sparkSession.createDataFrame([tuple(report.values())], ", ".join(f"{name} long" for name in report))
