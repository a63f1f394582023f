"""Files of the ordered CSV catalog."""

from conftest import SF
from workload import queries, tables as t


def test_files_grow_in_number_not_in_size(spark, monkeypatch):
    written = []
    plain = queries.csv.write_catalog_csv

    def write(df, path):
        written.append(path)
        plain(df, path)

    monkeypatch.setattr(queries, "FILE_ROWS", 10)
    monkeypatch.setattr(queries.csv, "write_catalog_csv", write)
    whole = t.catalog(spark, SF)
    n = whole.count()
    found = queries.catalog_first_rows(spark, SF).collect()
    sizes = [r["count"] for r in spark.read.csv(written[0], header=True, multiLine=True, escape='"')
             .selectExpr("_metadata.file_path AS file").groupBy("file").count().collect()]
    assert n > 160 and sum(sizes) == n and max(sizes) < n // 8
    assert sorted(map(repr, found)) == sorted(map(repr, whole.orderBy("article_id").limit(n * 2 // 3).collect()))
