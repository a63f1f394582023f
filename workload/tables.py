"""SQL that turns the given tables into search inputs. One text serves Spark and the SQL check."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.shared import by_shuffle

# Vocabularies of the given `part` table.
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
NOUNS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
ADJECTIVES = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
TONES = ("Light", "Medium", "Dark")
BRANDS = tuple(f"Brand#{n}" for n in range(1, 26))
VOCABULARY = {
    "publico": TYPES, "categoria": NOUNS, "colores": ADJECTIVES, "tono": TONES, "estampado": BRANDS,
}
WHITELIST = tuple(n for n in NOUNS if n != "ring")
DIM = 64
#: Given tables of more rows are never broadcast, however small their files are.
BROADCAST_ROWS = 100_000

ARTICLES = """
SELECT p.p_partkey AS article_id,
       CAST(floor(p.p_partkey / 4) AS BIGINT) AS product_code,
       p.p_name AS prod_name,
       CASE WHEN p.p_size % 10 = 0 THEN NULL ELSE split_part(p.p_name, ' ', 2) END AS product_type_name,
       split_part(p.p_name, ' ', 2) AS product_group_name,
       p.p_type AS index_group_name,
       CASE WHEN p.p_size = 1 THEN NULL ELSE split_part(p.p_name, ' ', 1) END AS perceived_colour_master_name,
       CASE WHEN p.p_size <= 16 THEN 'Light' WHEN p.p_size <= 33 THEN 'Medium' ELSE 'Dark' END
           AS perceived_colour_value_name,
       p.p_brand AS graphical_appearance_name,
       d.text AS detail_desc
FROM {part} p LEFT JOIN {documents} d ON d.doc_id = p.p_partkey
"""

VECTORS = "SELECT vec_id AS product_code, embedding FROM {embeddings}"

# Products with label 0 count as not indexed yet.
PARTIAL_INDEX = "SELECT vec_id AS product_code, embedding FROM {embeddings} WHERE label <> 0"

# One request per vector. Each facet takes known values, an unknown one and none in turn, so that
# requests match at once, after some relaxation, or (all colours excluded) never.
REQUESTS = """
SELECT vec_id AS query_id,
       concat('busca ', CAST(vec_id AS STRING)) AS frase,
       nullif(split_part('ECONOMY,LARGE,MEDIUM,PROMO,SMALL,STANDARD,CUSTOM,,', ',',
                         CAST(vec_id % 9 AS INT) + 1), '') AS publico,
       nullif(split_part('anvil,bolt,gear,gizmo,plate,ring,rod,widget,sprocket,,', ',',
                         CAST(floor(vec_id / 3) AS INT) % 11 + 1), '') AS categoria,
       coalesce(split(nullif(split_part(';red;red,blue;hot,cold,purple;;small;purple;', ';',
                                        CAST(floor(vec_id / 5) AS INT) % 8 + 1), ''), ','), {no_strings})
           AS colores,
       coalesce(split(nullif(split_part(';red;blue,old;;blue,cold,hot,large,new,old,red,small;', ';',
                                        CAST(floor(vec_id / 7) AS INT) % 6 + 1), ''), ','), {no_strings})
           AS colores_excluidos,
       nullif(split_part(',Light,Medium,Dark,Dusty,', ',', CAST(floor(vec_id / 2) AS INT) % 6 + 1), '')
           AS tono,
       CASE WHEN (vec_id * 7) % 40 < 27 THEN concat('Brand#', CAST((vec_id * 7) % 40 + 1 AS STRING)) END
           AS estampado,
       concat('pieza ', CAST(vec_id AS STRING)) AS consulta_semantica,
       embedding AS query_vec,
       CAST(1 + vec_id % 24 AS INT) AS limite
FROM {embeddings}
"""

# The same requests with some limits out of bounds.
UNCHECKED_REQUESTS = f"""
SELECT query_id, publico, categoria, colores, colores_excluidos, tono, estampado,
       CASE WHEN query_id % 37 = 0 THEN 0 WHEN query_id % 41 = 0 THEN 101 ELSE limite END AS limite
FROM ({REQUESTS}) r
"""

# Answers of a model about each part: complete ones, wrong values, wrong types, broken text, no answer.
MODEL_ANSWERS = """
SELECT p_partkey AS query_id,
       concat('quiero ', p_name) AS frase,
       CASE p_partkey % 14
         WHEN 0 THEN concat('{{"publico":"', p_type, '","categoria":"', split_part(p_name, ' ', 2),
             '","colores":["', split_part(p_name, ' ', 1), '"],"colores_excluidos":[],"tono":null,"estampado":"',
             p_brand, '","consulta_semantica":"', p_name, '"}}')
         WHEN 1 THEN concat('{{"publico":"', p_type, '","colores":["', split_part(p_name, ' ', 1),
             '","turquesa"],"consulta_semantica":" ', p_name, ' "}}')
         WHEN 2 THEN '{{"publico":5,"colores":"red","tono":["Light"],"estampado":"Brand#3","consulta_semantica":7}}'
         WHEN 3 THEN '{{roto'
         WHEN 4 THEN NULL
         WHEN 5 THEN '{{}}'
         WHEN 6 THEN concat('{{"tono":"Medium","consulta_semantica":"   ","publico":"', p_type, '"}}')
         WHEN 7 THEN '[]'
         WHEN 8 THEN '{{"tono":"Dark"}} junk'
         WHEN 9 THEN concat('{{"talla":"', CAST(p_size AS STRING),
             '","colores":null,"colores_excluidos":["red",null],"categoria":"', split_part(p_name, ' ', 2), '"}}')
         WHEN 10 THEN '{{"consulta_semantica":{{"no":"es texto"}},"publico":"PROMO","estampado":{{}}}}'
         WHEN 11 THEN 'null'
         WHEN 12 THEN '{{"tono":"Oscuro","consulta_semantica":false,"colores":["red","red"],"categoria":"bolt"}}'
         ELSE concat('{{"colores_excluidos":["', split_part(p_name, ' ', 1), '","old"],"consulta_semantica":"',
             p_name, ' barato"}}')
       END AS response_1,
       CASE p_partkey % 5
         WHEN 0 THEN concat('{{"publico":"', p_type, '"}}')
         WHEN 1 THEN NULL
         WHEN 2 THEN '{{"a":'
         WHEN 3 THEN '"texto"'
         ELSE '{{"tono":"Dark","consulta_semantica":"segunda"}}'
       END AS response_2
FROM {part}
"""

# Two overlapping load batches: the second changes the brand; `seq` is the input order.
FIRST_LOAD = f"SELECT * FROM ({ARTICLES}) a WHERE article_id < (SELECT count(*) * 3 / 4 FROM {{part}})"
SECOND_LOAD = " UNION ALL ".join(
    f"""
SELECT article_id, product_code, prod_name, product_type_name, product_group_name, index_group_name,
       perceived_colour_master_name, perceived_colour_value_name,
       concat(graphical_appearance_name, ' v{copy}') AS graphical_appearance_name,
       detail_desc, article_id * 2 + {copy} AS seq
FROM ({ARTICLES}) a
WHERE article_id >= (SELECT count(*) / 2 FROM {{part}}) AND {which}
"""
    for copy, which in ((1, "true"), (2, "article_id % 3 = 0"))
)

# Words of whole documents as tokens: the vector of a word follows from document, length and place; one-letter words are masked.
SPARK_WORDS = """SELECT doc_id AS text_id, pos, CASE WHEN length(word) = 1 THEN 0 ELSE 1 END AS mask,
             (doc_id * 131 + length(word) * 31 + pos) % (SELECT count(*) FROM {embeddings}) AS vec_id
      FROM {documents} LATERAL VIEW posexplode(split(text, ' ', -1)) t AS pos, word"""
SPARK_TOKENS = f"""
SELECT w.text_id, w.pos, w.mask, e.embedding AS vec
FROM ({SPARK_WORDS}) w
JOIN {{embeddings}} e ON e.vec_id = w.vec_id
"""

# Vectors that a task holds while words stream by, texts whose words it takes, and words of a text that stay together.
BLOCK_VECTORS = 65_536
CELL_TEXTS = 65_536
RUN_WORDS = 4_096


# Tables stay open between queries, as in a service; no rows are cached.
@lru_cache
def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return by_shuffle(table) if table.count() > BROADCAST_ROWS else table


@lru_cache
def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The DataFrame of one of the texts above over the tables in `sf_dir`."""
    used = {t: load(spark, sf_dir, t) for t in ("part", "documents", "embeddings") if f"{{{t}}}" in sql}
    if {"part", "documents"} <= used.keys() and used["documents"].count() > BROADCAST_ROWS >= used["part"].count():
        # Where the join allows it, few articles go to the texts, which stay where they are.
        used["part"] = F.broadcast(used["part"])
    return spark.sql(sql.replace("{no_strings}", "CAST(array() AS ARRAY<STRING>)"), **used)


def sql_text(sql: str) -> str:
    """The same text for a database that has the tables under their own names."""
    return sql.format(
        part="part", documents="documents", embeddings="embeddings", no_strings="CAST([] AS VARCHAR[])"
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ARTICLES)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, VECTORS)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, REQUESTS)


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """The vector of one product, as a request would bring it."""
    row = load(spark, sf_dir, "embeddings").filter(f"vec_id = {int(vec_id)}").select("embedding").head()
    return list(row["embedding"])


def tokens(spark: SparkSession, sf_dir: str, block_vectors: int = BLOCK_VECTORS, cell_texts: int = CELL_TEXTS) -> DataFrame:
    """The rows of `SPARK_TOKENS`, with the words of a text one after the other in each task.

    Up to a block of vectors goes to all tasks. More are dealt into blocks, and texts into cells: a block meets a cell in one task, where
    words keep the order of their documents. A plain join would scatter the words of a text over all tasks, each with its own vector.
    """
    words, given = view(spark, sf_dir, SPARK_WORDS), load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    blocks = -(-given.count() // block_vectors)
    if blocks <= 1:
        return words.join(F.broadcast(given), "vec_id").select("text_id", "pos", "mask", "vec")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(-(-load(spark, sf_dir, "documents").count() // cell_texts), -(-tasks // blocks))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) * cells
    cell = F.pmod(F.xxhash64("text_id", F.floor(F.col("pos") / RUN_WORDS)), F.lit(cells))
    # The join keeps the dealing by place alone only with this setting (it changes no result of any query).
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    dealt = words.withColumn("place", block + cell).repartition(blocks * cells, "place")
    copies = given.withColumn("place", F.explode(F.sequence(block, block + cells - 1))).repartition(blocks * cells, "place")
    return dealt.join(copies.hint("shuffle_hash"), ["place", "vec_id"]).select("text_id", "pos", "mask", "vec")
