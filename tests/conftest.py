from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from facetrank.schema import CATALOG_SCHEMA, FILTER_SCHEMA  # noqa: E402
from pyspark.sql import types as T  # noqa: E402
from workload.session import local_session, ship_package  # noqa: E402

SF = "/root/testdata/sf0.001"

DEFAULTS = {
    "product_type_name": "Poncho", "product_group_name": "Accessories", "index_group_name": "Divided",
    "perceived_colour_master_name": "Green", "perceived_colour_value_name": "Bright",
    "graphical_appearance_name": "Check", "detail_desc": "Woven by hand.",
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship_package(session)
    return session


@pytest.fixture(scope="session")
def articles(spark):
    """Build a catalog from dicts; missing columns take the defaults above."""
    def build(*rows):
        full = [{**DEFAULTS, "prod_name": f"Article of {r['product_code']}", **r} for r in rows]
        return spark.createDataFrame(
            [tuple(r[f.name] for f in CATALOG_SCHEMA) for r in full], CATALOG_SCHEMA
        )

    return build


REQUEST_SCHEMA = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("frase", T.StringType())]
    + list(FILTER_SCHEMA)
    + [T.StructField("query_vec", T.ArrayType(T.FloatType())), T.StructField("limite", T.IntegerType())]
)


@pytest.fixture(scope="session")
def requests(spark):
    """Build a table of requests from dicts, numbered from 1."""
    def build(*rows):
        base = {"colores": [], "colores_excluidos": [], "consulta_semantica": "x", "frase": "f", "limite": 24}
        table = [{**base, "query_id": i, **r} for i, r in enumerate(rows, 1)]
        return spark.createDataFrame(
            [tuple(r.get(f.name) for f in REQUEST_SCHEMA) for r in table], REQUEST_SCHEMA
        )

    return build


@pytest.fixture(scope="session")
def variants(articles):
    """Six articles of three products: four ponchos, a pair of shoes, a poncho of another range."""
    grey = {"perceived_colour_master_name": "Grey"}
    shoes = {"index_group_name": "Sport", "product_group_name": "Shoes", "perceived_colour_value_name": "Dark",
             "graphical_appearance_name": "Mesh"}
    return articles(
        {"article_id": 11, "product_code": 70}, {"article_id": 12, "product_code": 70, "perceived_colour_master_name": "Pink"},
        {"article_id": 13, "product_code": 70, **grey}, {"article_id": 14, "product_code": 70, "perceived_colour_value_name": "Dark", **grey},
        {"article_id": 21, "product_code": 80, **grey, **shoes}, {"article_id": 31, "product_code": 90, "index_group_name": "Ladieswear"},
    ).cache()


@pytest.fixture(scope="session")
def four(articles):
    """Four products of one article each: 15 for sports, 27 and 38 for men, 46 divided."""
    table = """
        15 | Rain hat      | Hat      | Sport    | Accessories        | Yellow | Bright | Dot
        27 | Wool vest     | Vest     | Menswear | Garment Upper body | Grey   | Dark   | Melange
        38 | Beach shorts  | Shorts   | Menswear | Swimwear           | Green  | Light  | Check
        46 | Felt slippers | Slippers | Divided  | Shoes              | Pink   | Medium | Embroidery"""
    columns = ("prod_name", "product_type_name", "index_group_name", "product_group_name", "perceived_colour_master_name",
               "perceived_colour_value_name", "graphical_appearance_name")
    cells = [[c.strip() for c in line.split("|")] for line in table.strip().splitlines()]
    return articles(*[
        {"article_id": 10 * int(code) + 7, "product_code": int(code), **dict(zip(columns, rest))} for code, *rest in cells
    ]).cache()


@pytest.fixture(scope="session")
def plan_of():
    """The physical plan as text."""
    def text(df) -> str:
        import contextlib
        import io

        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        return out.getvalue()

    return text
