"""CSV files read in many blocks give the rows of a reader that takes each file whole."""

import random

import pytest
from facetrank.schema import CATALOG_COLUMNS
from facetrank.sources.csv import read_catalog_csv

BLOCK = "spark.sql.files.maxPartitionBytes"
HEADER = ["season", *reversed(CATALOG_COLUMNS), "note `x`"]


@pytest.fixture
def blocks(spark):
    """Set the size of blocks for a test."""
    def set_to(size):
        spark.conf.set(BLOCK, str(size))

    before = spark.conf.get(BLOCK)
    yield set_to
    spark.conf.set(BLOCK, before)


def cell(rng) -> str:
    kind = rng.randrange(9)
    if kind == 0:
        return ""
    if kind < 4:
        return "".join(rng.choices("abé ñ0;'\\", k=rng.randrange(1, 8)))
    text = "".join(rng.choices(["a", "é", ",", "\n", '""', "\r\n", " ", "\n\n", '"",""', "x" * 40], k=rng.randrange(12)))
    return f'"{text}"'


def write(path, rng, n, end):
    lines = [",".join(f'"{h}"' for h in HEADER)]
    for i in range(n):
        cells = [cell(rng) for _ in HEADER]
        cells[HEADER.index("article_id")] = str(i)
        cells[HEADER.index("product_code")] = f'"{i // 3}"'
        if rng.randrange(20) == 0:
            cells = cells[: HEADER.index("article_id") + 1]
        if rng.randrange(20) == 0:
            cells.append("more")
        lines.append(",".join(cells))
        if rng.randrange(15) == 0:
            lines.append("")
    path.write_bytes((end.join(lines) + (end if rng.randrange(2) else "")).encode())


def rows_of(df):
    return [tuple(r)[:-1] for r in df.orderBy("seq").collect()]


def unix(rows):
    """The reader of whole files turns line breaks inside cells into those of Unix if its first row ends otherwise."""
    return [tuple(c.replace("\r\n", "\n") if isinstance(c, str) else c for c in r) for r in rows]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_give_the_rows_of_whole_files(spark, blocks, tmp_path, seed, end):
    rng = random.Random(seed)
    write(tmp_path / "a.csv", rng, 60, end)
    write(tmp_path / "b.csv", rng, 3, end)
    write(tmp_path / "c.csv", rng, 0, end)
    expected = rows_of(read_catalog_csv(spark, str(tmp_path), split=False))
    assert len(expected) == 63
    for size in (400, 3000, 1 << 20):
        blocks(size)
        assert unix(rows_of(read_catalog_csv(spark, str(tmp_path)))) == unix(expected)
    blocks(1500)
    assert unix(rows_of(read_catalog_csv(spark, str(tmp_path), limit=30))) == unix(expected[:30])


def test_one_file_is_read_by_several_tasks(spark, blocks, tmp_path):
    write(tmp_path / "a.csv", random.Random(3), 400, "\n")
    blocks(4000)
    found = read_catalog_csv(spark, str(tmp_path / "a.csv"))
    assert found.select("seq.block").distinct().count() > 5
    assert found.rdd.getNumPartitions() > 3


def test_a_cell_over_many_blocks_and_a_header_over_two(spark, blocks, tmp_path):
    header = ",".join([*CATALOG_COLUMNS, '"a\nlong\n' + "header" * 60 + '"'])
    rows = [f'{i},7,p,t,g,i,c,v,a,"{"line\n" * (300 if i == 2 else 1)}",x' for i in range(5)]
    (tmp_path / "a.csv").write_text("\n".join([header, *rows]))
    expected = rows_of(read_catalog_csv(spark, str(tmp_path), split=False))
    assert [len(r[-1]) for r in expected] == [5, 5, 1500, 5, 5]
    for size in (90, 333):
        blocks(size)
        assert rows_of(read_catalog_csv(spark, str(tmp_path))) == expected


def test_byte_order_mark_and_file_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + ",".join(f'"{c}"' for c in CATALOG_COLUMNS).encode() + b'\n1,2,"p\nq"')
    (tmp_path / "b.csv").write_text("\n\n" + ",".join(CATALOG_COLUMNS))
    assert [r[:3] for r in rows_of(read_catalog_csv(spark, str(tmp_path)))] == [(1, 2, "p\nq")]


@pytest.mark.parametrize("text", ['5" pipe', 'open "quote', '"closed" by mistake"x"'])
def test_bare_quotes_are_refused(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(",".join(CATALOG_COLUMNS) + f"\n1,2,{text},t,g\n3,4,p,t,g\n")
    with pytest.raises(Exception, match="quote|ends inside"):
        read_catalog_csv(spark, str(tmp_path)).collect()
    assert read_catalog_csv(spark, str(tmp_path), split=False).count() >= 1
