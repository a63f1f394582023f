"""Exact nearest products for many requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.operators.cells import BLOCK, RANKED, REQUESTS, nearest_in_block, nearest_in_cell, pack_block, pack_requests
from facetrank.schema import MAX_LIMIT
from facetrank.shared import by_shuffle, write_once

# Products of a block and requests of a cell: bounds what a task holds in memory and computes at once.
BLOCK_PRODUCTS = 16_384
CELL_REQUESTS = 8_192
# Requests of a cell where cells are many enough for all tasks: each cell reads every vector.
MOST_REQUESTS = 65_536
# Rows that the requests of a cell keep, about.
MOST_KEPT = 1 << 20


def _dealt(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def product_rows(candidates: DataFrame, vectors: DataFrame, n_blocks: int, n_cells: int) -> DataFrame:
    """(block, request_cell, product_code, embedding, under): each candidate's vector once for each cell of requests.

    `under` lists (key_id, article_id, variantes) of the keys that the product is under: at most one entry a mask and variant.
    """
    listed = candidates.groupBy("product_code").agg(F.collect_list(F.struct("key_id", "article_id", "variantes")).alias("under"))
    return listed.join(by_shuffle(vectors.select("product_code", "embedding")), "product_code").select(
        _dealt("product_code", n_blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))).alias("request_cell"),
        "product_code", "embedding", "under")


def request_rows(candidates: DataFrame, asking: DataFrame, requests: DataFrame, n_blocks: int, n_cells: int) -> DataFrame:
    """(block, request_cell, query_id, keys, query_vec, limite): each request once for each block that holds one of its keys."""
    places = candidates.select("key_id", _dealt("product_code", n_blocks).alias("block")).distinct()
    keys = asking.join(places, "key_id").groupBy("query_id", "block").agg(F.collect_list("key_id").alias("keys"))
    asked = requests.select("query_id", "query_vec", F.col("limite").cast("int").alias("limite"))
    return keys.join(by_shuffle(asked), "query_id").select(
        "block", _dealt("query_id", n_cells).alias("request_cell"), "query_id", "keys", "query_vec", "limite")


def cells_for(n_requests: int, n_blocks: int, tasks: int, cell_requests: int = CELL_REQUESTS) -> int:
    """As many cells as `tasks` need, of `cell_requests` or more each; beyond that, cells grow up to MOST_REQUESTS before they multiply."""
    fewest = -(-n_requests // max(cell_requests, MOST_REQUESTS))
    return max(1, fewest, min(-(-n_requests // cell_requests), -(-tasks // n_blocks)))


def rank_candidates(
    candidates: DataFrame,
    vectors: DataFrame,
    asking: DataFrame,
    requests: DataFrame,
    block_products: int = BLOCK_PRODUCTS,
    cell_requests: int = CELL_REQUESTS,
) -> DataFrame:
    """(query_id, rank, product_code, article_id, variantes, distancia): top `limite` per request.

    candidates: (key_id, product_code, article_id, variantes); asking: (query_id, key_id); requests: (query_id,
    query_vec, limite).

    Products are dealt into blocks, requests into cells. A single cell is ranked in the plan of the result, with a copy of the few requests
    for each block (`_by_copies`). Many cells and blocks would copy both sides as often as there are parts of the other, which is the
    square of the input: `_by_reading` ranks them when the function is called, and each block is stored once and read by all tasks. Pairs
    of request and product are never stored, and a key shared by the whole catalog or by all requests is spread over many tasks. Any
    product of a request's final top is in the top of its block, which makes the merged result exact.
    """
    candidates = write_once(candidates, "candidates")
    n_blocks = max(1, -(-vectors.count() // block_products))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = requests.agg(F.count(F.lit(1)).alias("n"), F.sum("limite").alias("kept")).first()
    n_cells = cells_for(asked["n"], n_blocks, tasks, cell_requests)
    if n_cells == 1:
        found = _by_copies(candidates, vectors, asking, requests, n_blocks, n_cells)
    else:
        n_cells = max(cells_for(asked["n"], 1, tasks, cell_requests), -(-asked["kept"] // MOST_KEPT))
        n_stripes = min(n_blocks, -(-tasks // n_cells))
        found = write_once(_by_reading(candidates, vectors, asking, requests, n_blocks, n_cells, n_stripes), "nearest")
    return keep_top(found, requests.select("query_id", "limite"), ["distancia", "product_code"])


def _by_copies(
    candidates: DataFrame, vectors: DataFrame, asking: DataFrame, requests: DataFrame, n_blocks: int, n_cells: int
) -> DataFrame:
    """The top rows of each block. A block meets a cell in one task: a vector travels once for each cell, whatever the number of keys
    its product is under, and a request once for each block."""
    products = product_rows(candidates, vectors, n_blocks, n_cells)
    wanted = request_rows(candidates, asking, requests, n_blocks, n_cells)
    cell = ["block", "request_cell"]
    return products.groupBy(*cell).cogroup(wanted.groupBy(*cell)).applyInArrow(nearest_in_block, RANKED)


def _by_reading(
    candidates: DataFrame, vectors: DataFrame, asking: DataFrame, requests: DataFrame, n_blocks: int, n_cells: int, n_stripes: int
) -> DataFrame:
    """The top rows of each stripe of blocks. Each block becomes a row, shuffled once; a task has a cell, reads the blocks of a stripe one
    after the other, and keeps the top rows of its requests. One stripe holds all blocks unless cells are too few for all tasks.

    Vectors, requests and top rows are stored once (top rows once a stripe), so what is on disk grows with the input, not with its square.
    """
    blocks = product_rows(candidates, vectors, n_blocks, 1).groupBy("block").applyInArrow(pack_block, BLOCK)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stripes = blocks.repartitionById(n_stripes, F.col("block") % n_stripes).select((place == 0).alias("first"), "products", "entries")
    wanted = request_rows(candidates, asking, requests, 1, 1).select("query_id", "keys", "query_vec", "limite")
    # Requests for the same keys share cells, so a cell has few keys and looks each of them up once a block.
    by_keys = F.xxhash64(F.array_sort("keys")), F.xxhash64("query_id")
    cells = wanted.repartitionByRange(n_cells, *by_keys).mapInArrow(pack_requests, REQUESTS)
    # Rows of blocks with rows of requests: the requests of a cell go to Python with the first block only.
    meeting = stripes.join(cells.hint("shuffle_replicate_nl"), F.col("first") | F.col("requests").isNull())
    return meeting.mapInArrow(nearest_in_cell, RANKED)


def keep_top(rows: DataFrame, limits: DataFrame, order: list[str]) -> DataFrame:
    """Number the rows of each request and keep the first `limite`; limits: (query_id, limite).

    The constant bound lets Spark cut each map task to its own top before the shuffle.
    """
    by_request = Window.partitionBy("query_id").orderBy(*order)
    return (
        rows.withColumn("rank", F.row_number().over(by_request))
        .filter(F.col("rank") <= MAX_LIMIT)
        .join(by_shuffle(limits), "query_id")
        .filter("rank <= limite")
        .drop("limite")
    )
