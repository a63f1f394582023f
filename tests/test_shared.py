"""Intermediate tables."""

from pathlib import Path

import pytest
from facetrank.shared import scratch, scratch_path, write_once


def test_tables_of_a_block_go_with_it(spark):
    kept = write_once(spark.range(3), "kept")
    with scratch(spark) as folder:
        inside = write_once(spark.range(5), "inside")
        with scratch(spark) as deeper:
            write_once(spark.range(1), "deeper")
            assert deeper.startswith(folder) and Path(deeper).exists()
        assert not Path(deeper).exists()
        assert inside.count() == 5
    assert not Path(folder).exists()
    assert kept.count() == 3
    assert "block-" not in scratch_path(spark, "after")


def test_tables_of_a_failed_block_go_too(spark):
    with pytest.raises(KeyError), scratch(spark) as folder:
        write_once(spark.range(5), "inside")
        raise KeyError
    assert not Path(folder).exists()
