from __future__ import annotations

import importlib.util
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))

# The fixtures and constants of the tests above; this folder's file has the same module name.
_spec = importlib.util.spec_from_file_location("outer_conftest", HERE.parent / "conftest.py")
_outer = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_outer)
SF = _outer.SF

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

#: Names that the operators use themselves, or that a join could mistake.
CLASHING = ("score", "copy", "component", "node", "key", "ids", "rank", "kept", "_salt")


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from {doc_id: text} or a list of (doc_id, text), with clashing columns."""
    def build(rows):
        rows = list(rows.items()) if isinstance(rows, dict) else rows
        full = [(i, t, "en", None if i is None else f"s{i % 3}", len(t or "")) + ("x",) * len(CLASHING) for i, t in rows]
        extra = [T.StructField(c, T.StringType()) for c in CLASHING]
        return spark.createDataFrame(full, T.StructType([*DOCUMENTS, *extra])).repartition(3)

    return build


