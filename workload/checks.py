"""SQL that computes the registered queries in another way, over the same tables.

Relaxation is checked by comparing every request with every article: per pair the highest facet
that fails, per request the minimum of it.
"""

from __future__ import annotations

from facetrank.schema import CATALOG_COLUMNS
from workload import tables as t

_ARTICLES = t.sql_text(t.ARTICLES)
_VECTORS = t.sql_text(t.VECTORS)
_REQUESTS = t.sql_text(t.REQUESTS)
_UNCHECKED = t.sql_text(t.UNCHECKED_REQUESTS)
_ANSWERS = t.sql_text(t.MODEL_ANSWERS)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_WITH = f"WITH articles AS ({_ARTICLES}), vectors AS ({_VECTORS})"

_WIDE = """article_id, product_code, prod_name, product_type_name, product_group_name, index_group_name,
    perceived_colour_master_name, perceived_colour_value_name, graphical_appearance_name, detail_desc"""


def _facet_search(condition: str, limit: int) -> str:
    return f"""
{_WITH}, picked AS (
  SELECT product_code, min(article_id) AS article_id, count(*) AS variantes
  FROM articles WHERE {condition} GROUP BY product_code)
SELECT a.*, p.variantes FROM picked p JOIN articles a USING (article_id, product_code)
ORDER BY product_code LIMIT {limit}"""


def _distance(a: str, b: str) -> str:
    return f"list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


# The facets of a request against those of an article: the number of the highest facet that fails.
_NEED = """greatest(
    CASE WHEN r.estampado IS NULL OR coalesce(a.graphical_appearance_name = r.estampado, false) THEN 0 ELSE 1 END,
    CASE WHEN r.tono IS NULL OR coalesce(a.perceived_colour_value_name = r.tono, false) THEN 0 ELSE 2 END,
    CASE WHEN len(r.colores) = 0 OR coalesce(list_contains(r.colores, a.perceived_colour_master_name), false)
         THEN 0 ELSE 3 END,
    CASE WHEN r.categoria IS NULL OR coalesce(a.product_group_name = r.categoria, false) THEN 0 ELSE 4 END,
    CASE WHEN r.publico IS NULL OR coalesce(a.index_group_name = r.publico, false) THEN 0 ELSE 5 END)"""


def _relaxed(requests: str, tables: str = _WITH) -> str:
    return f"""
{tables}, requests AS ({requests}),
pairs AS (
  SELECT r.query_id, a.product_code, a.article_id, {_NEED} AS need
  FROM requests r JOIN articles a
    ON len(r.colores_excluidos) = 0
    OR (a.perceived_colour_master_name IS NOT NULL
        AND NOT list_contains(r.colores_excluidos, a.perceived_colour_master_name))),
levels AS (
  SELECT r.query_id, coalesce(min(p.need), 5) AS lv
  FROM requests r LEFT JOIN pairs p USING (query_id) GROUP BY r.query_id),
relaxed AS (
  SELECT r.*, lv,
    CASE WHEN lv >= 1 AND r.estampado IS NOT NULL THEN ['estampado'] ELSE [] END
      || CASE WHEN lv >= 2 AND r.tono IS NOT NULL THEN ['tono'] ELSE [] END
      || CASE WHEN lv >= 3 AND len(r.colores) > 0 THEN ['colores'] ELSE [] END
      || CASE WHEN lv >= 4 AND r.categoria IS NOT NULL THEN ['categoria'] ELSE [] END
      || CASE WHEN lv >= 5 AND r.publico IS NOT NULL THEN ['publico'] ELSE [] END AS dropped,
    CASE WHEN lv >= 5 THEN NULL ELSE publico END AS a_publico,
    CASE WHEN lv >= 4 THEN NULL ELSE categoria END AS a_categoria,
    CASE WHEN lv >= 3 THEN CAST([] AS VARCHAR[]) ELSE colores END AS a_colores,
    CASE WHEN lv >= 2 THEN NULL ELSE tono END AS a_tono,
    CASE WHEN lv >= 1 THEN NULL ELSE estampado END AS a_estampado
  FROM requests r JOIN levels USING (query_id))"""


def _ranked(requests: str, tables: str = _WITH) -> str:
    return f"""
{_relaxed(requests, tables)}, products AS (
  SELECT query_id, product_code, min(article_id) AS article_id, count(*) AS variantes
  FROM pairs JOIN levels USING (query_id) WHERE need <= lv GROUP BY query_id, product_code),
given AS MATERIALIZED (SELECT product_code, CAST(embedding AS DOUBLE[]) AS e FROM vectors),
asking AS MATERIALIZED (SELECT query_id, CAST(query_vec AS DOUBLE[]) AS e FROM requests),
distances AS (
  SELECT p.*, list_distance(v.e, r.e) AS d
  FROM products p JOIN given v USING (product_code) JOIN asking r USING (query_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, product_code) AS rank FROM distances),
results AS (
  SELECT k.query_id, k.rank, k.product_code, k.article_id, k.variantes, round(k.d, 4) AS distancia
  FROM ranked k JOIN requests r USING (query_id) WHERE k.rank <= r.limite)"""


_PEDIDOS = """to_json({'publico': publico, 'categoria': categoria, 'colores': colores,
    'colores_excluidos': colores_excluidos, 'tono': tono, 'estampado': estampado,
    'consulta_semantica': consulta_semantica})"""
_HARD = """to_json({'publico': publico, 'categoria': categoria, 'colores': colores,
    'colores_excluidos': colores_excluidos, 'tono': tono, 'estampado': estampado})"""
_APLICADOS = """to_json({'publico': a_publico, 'categoria': a_categoria, 'colores': a_colores,
    'colores_excluidos': colores_excluidos, 'tono': a_tono, 'estampado': a_estampado,
    'consulta_semantica': consulta_semantica})"""

_REJECTED = f"""
SELECT query_id, 'publico' AS campo, publico AS valor FROM asked
WHERE publico IS NOT NULL AND NOT list_contains({_list(t.TYPES)}, publico)
UNION ALL SELECT query_id, 'categoria', categoria FROM asked
WHERE categoria IS NOT NULL AND NOT list_contains({_list(t.NOUNS)}, categoria)
UNION ALL SELECT query_id, 'colores', c FROM (SELECT query_id, unnest(colores) AS c FROM asked)
WHERE NOT list_contains({_list(t.ADJECTIVES)}, c)
UNION ALL SELECT query_id, 'colores_excluidos', c FROM (SELECT query_id, unnest(colores_excluidos) AS c FROM asked)
WHERE NOT list_contains({_list(t.ADJECTIVES)}, c)
UNION ALL SELECT query_id, 'tono', tono FROM asked
WHERE tono IS NOT NULL AND NOT list_contains({_list(t.TONES)}, tono)
UNION ALL SELECT query_id, 'estampado', estampado FROM asked
WHERE estampado IS NOT NULL AND NOT list_contains({_list(t.BRANDS)}, estampado)
UNION ALL SELECT query_id, 'limite', CAST(limite AS VARCHAR) FROM asked WHERE limite < 1 OR limite > 100"""

_FACET_BATCH = f"""
{_WITH}, asked AS ({_UNCHECKED}), rejected AS ({_REJECTED}),
accepted AS (SELECT * FROM asked WHERE query_id NOT IN (SELECT query_id FROM rejected)),
found AS (
  SELECT r.query_id, a.product_code, min(a.article_id) AS article_id, count(*) AS variantes
  FROM accepted r JOIN articles a
    ON (r.publico IS NULL OR a.index_group_name = r.publico)
   AND (r.categoria IS NULL OR a.product_group_name = r.categoria)
   AND (len(r.colores) = 0 OR list_contains(r.colores, a.perceived_colour_master_name))
   AND (len(r.colores_excluidos) = 0 OR (a.perceived_colour_master_name IS NOT NULL
        AND NOT list_contains(r.colores_excluidos, a.perceived_colour_master_name)))
   AND (r.tono IS NULL OR a.perceived_colour_value_name = r.tono)
   AND (r.estampado IS NULL OR a.graphical_appearance_name = r.estampado)
  GROUP BY r.query_id, a.product_code),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY product_code) AS rank FROM found),
results AS (
  SELECT n.* FROM numbered n JOIN accepted r USING (query_id) WHERE n.rank <= r.limite)"""

_CLEAN = f"product_group_name IN ({', '.join(repr(w) for w in t.WHITELIST)}) AND detail_desc IS NOT NULL"

_TEXTO = "concat_ws('. ', nullif(prod_name, ''), nullif(product_type_name, ''), nullif(detail_desc, ''))"

_STRING_COLUMNS = (
    "prod_name", "product_type_name", "product_group_name", "index_group_name",
    "perceived_colour_master_name", "perceived_colour_value_name", "graphical_appearance_name",
    "detail_desc",
)
_LONG_FORM = " UNION ALL ".join(f"SELECT '{c}' AS columna, {c} AS valor FROM articles" for c in _STRING_COLUMNS)

_EVERY_COLUMN = " UNION ALL ".join(f"SELECT '{c}' AS columna, CAST({c} AS VARCHAR) AS valor FROM articles" for c in CATALOG_COLUMNS)

# Model answers: an answer is usable if it is one JSON object, or a list without elements.
_SCALARS = {"publico": t.TYPES, "categoria": t.NOUNS, "tono": t.TONES, "estampado": t.BRANDS}
_COLOUR_LISTS = ("colores", "colores_excluidos")


def _usable(column: str) -> str:
    return f"""CASE WHEN {column} IS NOT NULL AND json_valid({column})
        AND json_type({column}) IN ('OBJECT', 'ARRAY')
        AND NOT (json_type({column}) = 'ARRAY' AND json_array_length({column}) > 0)
        THEN CASE WHEN json_type({column}) = 'ARRAY' THEN '{{}}' ELSE {column} END END"""


def _scalar(name: str, known) -> str:
    kind, value = f"json_type(j, '$.{name}')", f"json_extract_string(j, '$.{name}')"
    ok = f"coalesce({kind} = 'VARCHAR' AND list_contains({_list(known)}, {value}), false)"
    return f"""
    CASE WHEN {ok} THEN {value} END AS {name},
    CASE WHEN {kind} IS NOT NULL AND {kind} <> 'NULL' AND NOT {ok} THEN '{name}' END AS bad_{name}"""


def _colour_list(name: str) -> str:
    kind = f"json_type(j, '$.{name}')"
    items = f"json_extract_string(j, '$.{name}[*]')"
    ok = f"""coalesce({kind} = 'ARRAY' AND len(list_filter({items},
        lambda v: NOT coalesce(list_contains({_list(t.ADJECTIVES)}, v), false))) = 0, false)"""
    return f"""
    CASE WHEN {ok} THEN {items} ELSE CAST([] AS VARCHAR[]) END AS {name},
    CASE WHEN {kind} IS NOT NULL AND NOT {ok} THEN '{name}' END AS bad_{name}"""


_VALIDATED = f"""
answers AS ({_ANSWERS}),
usable AS (
  SELECT query_id, frase, {_usable("response_1")} AS one, {_usable("response_2")} AS two FROM answers),
chosen AS (
  SELECT query_id, frase, coalesce(one, two, '{{}}') AS j,
    CASE WHEN one IS NOT NULL THEN 1 WHEN two IS NOT NULL THEN 2 ELSE 0 END AS intento
  FROM usable),
fields AS (
  SELECT query_id, frase, intento, CASE WHEN intento = 0 THEN 2 ELSE intento - 1 END AS intentos_fallidos,
    {", ".join(_scalar(n, v) for n, v in _SCALARS.items())},
    {", ".join(_colour_list(n) for n in _COLOUR_LISTS)},
    CASE WHEN json_type(j, '$.consulta_semantica') = 'VARCHAR'
          AND trim(json_extract_string(j, '$.consulta_semantica')) <> ''
         THEN json_extract_string(j, '$.consulta_semantica') ELSE frase END AS consulta_semantica,
    CASE WHEN json_type(j, '$.consulta_semantica') NOT IN ('VARCHAR', 'NULL')
          AND CAST(json_extract(j, '$.consulta_semantica') AS VARCHAR) NOT IN ('false', '0', '[]', '{{}}')
         THEN 'consulta_semantica' END AS bad_consulta_semantica
  FROM chosen)"""

_COMPACT = """concat('{', array_to_string(list_filter([
    CASE WHEN publico IS NOT NULL THEN concat('"publico":', to_json(publico)) END,
    CASE WHEN categoria IS NOT NULL THEN concat('"categoria":', to_json(categoria)) END,
    CASE WHEN len(colores) > 0 THEN concat('"colores":', to_json(colores)) END,
    CASE WHEN len(colores_excluidos) > 0 THEN concat('"colores_excluidos":', to_json(colores_excluidos)) END,
    CASE WHEN tono IS NOT NULL THEN concat('"tono":', to_json(tono)) END,
    CASE WHEN estampado IS NOT NULL THEN concat('"estampado":', to_json(estampado)) END,
    concat('"consulta_semantica":', to_json(consulta_semantica))], lambda x: x IS NOT NULL), ','), '}')"""

_ASKED_BY_ANSWERS = f"""
SELECT f.query_id, f.publico, f.categoria, f.colores, f.colores_excluidos, f.tono, f.estampado,
       e.embedding AS query_vec, 3 AS limite
FROM fields f JOIN (SELECT *, count(*) OVER () AS vectors FROM embeddings) e ON e.vec_id = f.query_id % e.vectors"""



def _encoded(name: str, texts: str, fitted: str) -> str:
    """Tables `name` (id, embedding) of the (id, texto) in `texts`, by the weights of a fit on those in `fitted`."""
    def hashed(table: str, source: str) -> str:
        return f"""
{table} AS (
  SELECT id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {t.DIM} AS b,
    CASE WHEN CAST('0x' || substr(md5(word), 9, 1) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END AS s
  FROM (SELECT id, unnest(regexp_extract_all(lower(texto), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {source}))"""

    return f"""{hashed(f"{name}_fit", fitted)}, {hashed(f"{name}_words", texts)},
{name}_weights AS (
  SELECT g.b, ln(CAST((SELECT count(*) FROM {fitted}) + 1 AS DOUBLE) / (coalesce(f.m, 0) + 1)) AS w
  FROM range({t.DIM}) g(b) LEFT JOIN (SELECT b, count(DISTINCT id) AS m FROM {name}_fit GROUP BY b) f ON f.b = g.b),
{name}_sums AS (SELECT id, b, sum(s) AS s FROM {name}_words GROUP BY id, b),
{name}_raw AS (
  SELECT x.id, list(coalesce(s.s, 0) * w.w ORDER BY w.b) AS v
  FROM {texts} x CROSS JOIN {name}_weights w LEFT JOIN {name}_sums s ON s.id = x.id AND s.b = w.b GROUP BY x.id),
{name}_norms AS (SELECT id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS n FROM {name}_raw),
{name} AS (SELECT id, CAST(list_transform(v, lambda x: x / n) AS FLOAT[]) AS embedding FROM {name}_norms)"""


_PRODUCT_TEXTS = f"""
picked AS (SELECT min(article_id) AS article_id FROM articles GROUP BY product_code),
texts AS (SELECT product_code AS id, {_TEXTO} AS texto FROM articles JOIN picked USING (article_id))"""

_PHRASES = f"""
WITH articles AS (SELECT * FROM ({_ARTICLES}) WHERE {_CLEAN}), {_PRODUCT_TEXTS}, {_VALIDATED},
said AS (SELECT query_id AS id, consulta_semantica AS texto FROM fields),
{_encoded("indexed", "texts", "texts")}, {_encoded("asked", "said", "texts")},
vectors AS (SELECT id AS product_code, embedding FROM indexed)"""

_PHRASE_REQUESTS = "SELECT f.*, a.embedding AS query_vec, 5 AS limite FROM fields f JOIN asked a ON a.id = f.query_id"

_INDEX_HALF = f"SELECT DISTINCT product_code FROM ({t.sql_text(t.FIRST_LOAD)})"

_KNN = f"""
{_WITH}, nearest AS (
  SELECT v.product_code, {_distance("v.embedding", "q.embedding")} AS d
  FROM vectors v, (SELECT embedding FROM embeddings WHERE vec_id = 11) q
  ORDER BY d, v.product_code LIMIT 30),
picked AS (
  SELECT product_code, d, min(article_id) AS article_id, count(*) AS variantes
  FROM nearest JOIN articles USING (product_code) GROUP BY product_code, d)
SELECT a.*, p.variantes, round(p.d, 4) AS distancia FROM picked p JOIN articles a USING (article_id, product_code)"""

CHECKS = {
    "hybrid_search": f"""
{_WITH}, picked AS (
  SELECT product_code, min(article_id) AS article_id, count(*) AS variantes FROM articles
  WHERE index_group_name = 'PROMO' AND perceived_colour_master_name NOT IN ('red') GROUP BY product_code)
SELECT a.*, p.variantes, round({_distance("v.embedding", "q.embedding")}, 4) AS distancia
FROM picked p JOIN vectors v USING (product_code) JOIN articles a USING (article_id, product_code),
  (SELECT embedding FROM embeddings WHERE vec_id = 7) q
ORDER BY {_distance("v.embedding", "q.embedding")}, product_code LIMIT 24""",
    "facet_search": _facet_search("product_group_name = 'bolt' AND perceived_colour_value_name = 'Light'", 24),
    "facet_in_notin": _facet_search(
        """index_group_name = 'SMALL' AND perceived_colour_master_name IN ('red', 'blue', 'old')
        AND perceived_colour_master_name NOT IN ('old')""", 100),
    "facet_count": f"""
{_WITH} SELECT count(DISTINCT product_code) AS productos FROM articles
WHERE index_group_name = 'MEDIUM' AND perceived_colour_master_name NOT IN ('blue', 'hot')""",
    "knn_buckets": _KNN,
    "knn_global": _KNN,
    "strict_requests": f"WITH asked AS ({_UNCHECKED}) {_REJECTED}",
    "facet_batch": f"""{_FACET_BATCH}
SELECT r.query_id, r.rank, r.variantes, a.* FROM results r JOIN articles a USING (article_id, product_code)""",
    "facet_envelopes": f"""{_FACET_BATCH}, lists AS (
  SELECT query_id, count(*) AS total, string_agg(CAST(product_code AS VARCHAR), ',' ORDER BY rank) AS productos
  FROM results GROUP BY query_id)
SELECT query_id, coalesce(total, 0) AS total, CAST({_HARD} AS VARCHAR) AS filtros_aplicados,
  coalesce(productos, '') AS productos
FROM accepted LEFT JOIN lists USING (query_id)""",
    "relax_batch": f"""{_relaxed(_REQUESTS)}
SELECT query_id, array_to_string(dropped, '|') AS filtros_relajados, a_publico AS aplicado_publico,
  a_categoria AS aplicado_categoria, array_to_string(a_colores, '|') AS aplicado_colores,
  array_to_string(colores_excluidos, '|') AS aplicado_colores_excluidos, a_tono AS aplicado_tono,
  a_estampado AS aplicado_estampado, consulta_semantica AS aplicado_consulta_semantica
FROM relaxed""",
    "hybrid_batch": f"""{_ranked(_REQUESTS)}
SELECT r.query_id, r.rank, r.variantes, r.distancia, a.* FROM results r JOIN articles a USING (article_id, product_code)""",
    "search_envelopes": f"""{_ranked(_REQUESTS)}, lists AS (
  SELECT query_id, count(*) AS total, string_agg(CAST(product_code AS VARCHAR), ',' ORDER BY rank) AS productos
  FROM results GROUP BY query_id)
SELECT query_id, frase, coalesce(total, 0) AS total, CAST({_PEDIDOS} AS VARCHAR) AS filtros_pedidos,
  CAST({_APLICADOS} AS VARCHAR) AS filtros_aplicados, array_to_string(dropped, ', ') AS filtros_relajados,
  coalesce(productos, '') AS productos
FROM relaxed LEFT JOIN lists USING (query_id)""",
    "filter_report": f"""{_relaxed(_REQUESTS)}, shown AS (
  SELECT query_id, dropped, 1 AS pos, 'publico' AS campo, publico AS valor FROM relaxed
  UNION ALL SELECT query_id, dropped, 2, 'categoria', categoria FROM relaxed
  UNION ALL SELECT query_id, dropped, 3, 'colores', nullif(array_to_string(colores, ', '), '') FROM relaxed
  UNION ALL SELECT query_id, dropped, 4, 'colores_excluidos', nullif(array_to_string(colores_excluidos, ', '), '')
    FROM relaxed
  UNION ALL SELECT query_id, dropped, 5, 'tono', tono FROM relaxed
  UNION ALL SELECT query_id, dropped, 6, 'estampado', estampado FROM relaxed)
SELECT query_id, pos, campo, valor, list_contains(dropped, campo) AS relajado FROM shown WHERE valor IS NOT NULL""",
    "filters_as_json": f"""
WITH requests AS ({_REQUESTS})
SELECT query_id, CAST({_PEDIDOS} AS VARCHAR) AS completo, {_COMPACT} AS compacto FROM requests""",
    "catalog_clean": f"{_WITH} SELECT * FROM articles WHERE {_CLEAN}",
    "catalog_from_csv": f"{_WITH} SELECT * FROM articles WHERE {_CLEAN}",
    "catalog_first_rows": f"""
{_WITH}, placed AS (SELECT *, row_number() OVER (ORDER BY article_id) AS place, count(*) OVER () AS n FROM articles)
SELECT {_WIDE} FROM placed WHERE place <= n * 2 // 3""",
    "load_catalog": f"""
WITH batches AS (
  SELECT 1 AS carga, * FROM ({t.sql_text(t.FIRST_LOAD)})
  UNION ALL SELECT 2, * EXCLUDE (seq) FROM ({t.sql_text(t.SECOND_LOAD)})),
flagged AS (
  SELECT *, product_group_name IN ({', '.join(repr(w) for w in t.WHITELIST)}) AS known,
    detail_desc IS NOT NULL AS described FROM batches),
figures AS (
  SELECT carga, count(*) AS leidas, count(*) FILTER (NOT known) AS fuera_de_lista,
    count(*) FILTER (known AND NOT described) AS sin_descripcion,
    count(*) FILTER (NOT (known AND described)) AS descartadas,
    count(*) FILTER (known AND described) AS insertadas FROM flagged GROUP BY carga),
totals AS (
  SELECT r.carga, count(DISTINCT f.article_id) AS filas, count(DISTINCT f.product_code) AS productos
  FROM figures r JOIN flagged f ON f.carga <= r.carga AND f.known AND f.described GROUP BY r.carga)
SELECT *, filas - productos AS variantes_extra FROM figures JOIN totals USING (carga)""",
    "upsert_last_wins": f"""
WITH stored AS ({t.sql_text(t.FIRST_LOAD)}), batch AS ({t.sql_text(t.SECOND_LOAD)}),
every AS (
  SELECT *, -1 AS seq FROM stored UNION ALL SELECT * FROM batch),
last AS (SELECT article_id, max(seq) AS seq FROM every GROUP BY article_id)
SELECT {_WIDE} FROM every JOIN last USING (article_id, seq)""",
    "catalog_checked": f"{_WITH} SELECT count(*) AS filas, count(detail_desc) AS con_texto, 0 AS repetidas FROM articles",
    "vectors_stored": """
SELECT vec_id AS product_code, len(embedding) AS dim,
  round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS norma FROM embeddings""",
    "tables_ready": f"{_WITH} SELECT count(*) AS filas, true AS listas, false AS listas_sin_filas FROM articles",
    "catalog_totals": f"""
{_WITH} SELECT count(*) AS filas, count(DISTINCT product_code) AS productos,
  count(*) - count(DISTINCT product_code) AS variantes_extra FROM articles""",
    "facet_distribution": f"""
{_WITH} SELECT 'publico' AS campo, index_group_name AS valor, count(*) AS n FROM articles GROUP BY 2
UNION ALL SELECT 'categoria', product_group_name, count(*) FROM articles GROUP BY 2""",
    "load_report": f"""
{_WITH}, flagged AS (
  SELECT product_group_name IN ({', '.join(repr(w) for w in t.WHITELIST)}) AS known,
    detail_desc IS NOT NULL AS described FROM articles)
SELECT count(*) AS leidas, count(*) FILTER (NOT known) AS fuera_de_lista,
  count(*) FILTER (known AND NOT described) AS sin_descripcion,
  count(*) FILTER (NOT (known AND described)) AS descartadas,
  count(*) FILTER (known AND described) AS insertadas FROM flagged""",
    "column_profile": f"""
{_WITH}, pairs AS ({_LONG_FORM})
SELECT columna, count(*) AS filas, count(*) - count(valor) AS nulos, count(DISTINCT valor) AS distintos
FROM pairs GROUP BY columna""",
    "profile_sketched": f"""
WITH first AS ({t.sql_text(t.FIRST_LOAD)}), second AS ({t.sql_text(t.SECOND_LOAD)}),
articles AS (SELECT * FROM first UNION ALL SELECT * EXCLUDE (seq) FROM second), pairs AS ({_EVERY_COLUMN})
SELECT columna, count(*) AS filas, count(*) - count(valor) AS nulos, count(DISTINCT valor) AS distintos, true AS dentro
FROM pairs GROUP BY columna""",
    "value_counts": f"""
{_WITH}, pairs AS ({_LONG_FORM}),
counted AS (SELECT columna, valor, count(*) AS n FROM pairs WHERE valor IS NOT NULL GROUP BY columna, valor),
facets AS (SELECT columna FROM counted GROUP BY columna HAVING count(*) <= 60)
SELECT columna, valor, n FROM counted JOIN facets USING (columna)""",
    "text_nulls": f"{_WITH} SELECT count(*) - count(detail_desc) AS nulos FROM articles",
    "text_sample": f"""
{_WITH} SELECT article_id, detail_desc FROM articles WHERE detail_desc IS NOT NULL ORDER BY article_id LIMIT 3""",
    "masked_mean_pool": """
WITH words AS (SELECT doc_id AS text_id, unnest(string_split(text, ' ')) AS word,
  generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
counted AS (
  SELECT text_id, (text_id * 131 + length(word) * 31 + pos) % (SELECT count(*) FROM embeddings) AS vec_id, CASE WHEN length(word) = 1 THEN 0 ELSE 1 END AS mask, count(*) AS c
  FROM words GROUP BY 1, 2, 3),
parts AS (
  SELECT text_id, mask, c, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
  FROM counted JOIN embeddings USING (vec_id))
SELECT text_id, CAST(i - 1 AS INTEGER) AS pos,
  round(sum(CAST(x AS DOUBLE) * mask * c) / greatest(sum(mask * c), 1e-9), 4) + 0.0 AS valor
FROM parts GROUP BY text_id, i""",
    "l2_normalize": """
WITH scaled AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * label) AS s FROM embeddings),
normed AS (
  SELECT vec_id, e, s, greatest(sqrt(list_sum(list_transform(s, lambda x: x * x))), 1e-12) AS n FROM scaled),
unit AS (SELECT vec_id, e, list_transform(s, lambda x: x / n) AS u FROM normed)
SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 4) AS norma,
  round(u[1], 4) + 0.0 AS primero, round(list_distance(u, e), 4) AS distancia FROM unit""",
    "product_texts": f"""
{_WITH}, picked AS (SELECT min(article_id) AS article_id FROM articles GROUP BY product_code)
SELECT product_code, {_TEXTO} AS texto FROM articles JOIN picked USING (article_id)""",
    "pending_products": f"""
{_WITH} SELECT product_code, min(article_id) AS article_id FROM articles
WHERE product_code NOT IN (SELECT vec_id FROM embeddings WHERE label <> 0) GROUP BY product_code""",
    "index_build": f"""
{_WITH}, n AS (
  SELECT (SELECT count(*) FROM ({_INDEX_HALF})) AS primera, count(DISTINCT product_code) AS total FROM articles),
{_PRODUCT_TEXTS}, {_encoded("indexed", "texts", "texts")}
SELECT v.id AS product_code, 64 AS dim, 1.0 AS norma, n.primera, n.total - n.primera AS segunda,
  array_to_string(list_transform(v.embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT)), ',') AS valores,
  0 AS tercera, n.total FROM indexed v, n""",
    "index_in_commits": f"""
{_WITH}, n AS (
  SELECT (SELECT count(*) FROM ({_INDEX_HALF})) AS primera, count(DISTINCT product_code) AS total FROM articles),
{_PRODUCT_TEXTS}, {_encoded("indexed", "texts", "texts")}
SELECT v.id AS product_code, n.primera, n.total - n.primera AS segunda, n.total,
  array_to_string(list_transform(v.embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT)), ',') AS valores
FROM indexed v, n""",
    "groups_current": f"""
WITH stored AS ({t.sql_text(t.FIRST_LOAD)}), batch AS ({t.sql_text(t.SECOND_LOAD)}),
every AS (SELECT *, -1 AS seq FROM stored UNION ALL SELECT * FROM batch),
last AS (SELECT article_id, max(seq) AS seq FROM every GROUP BY article_id),
two AS (SELECT 1 AS n, * EXCLUDE (seq) FROM every WHERE seq = -1
  UNION ALL SELECT 2, * EXCLUDE (seq) FROM every JOIN last USING (article_id, seq)),
grouped AS (SELECT n, product_code, graphical_appearance_name, perceived_colour_value_name, perceived_colour_master_name,
  product_group_name, index_group_name, count(*) AS variantes FROM two GROUP BY ALL),
told AS (SELECT n, count(*) AS grupos, CAST(sum(variantes) AS BIGINT) AS articulos FROM grouped GROUP BY n)
SELECT a.n AS version, b.n AS catalogo, a.grupos, a.articulos, a.n = b.n OR NOT EXISTS (
  SELECT article_id, product_code, graphical_appearance_name FROM two WHERE n = a.n
  EXCEPT SELECT article_id, product_code, graphical_appearance_name FROM two WHERE n = b.n) AS vigente
FROM told a CROSS JOIN told b""",
    "groups_refreshed": f"""
WITH stored AS ({t.sql_text(t.FIRST_LOAD)}), batch AS ({t.sql_text(t.SECOND_LOAD)}),
every AS (SELECT *, -1 AS seq FROM stored UNION ALL SELECT * FROM batch),
last AS (SELECT article_id, max(seq) AS seq FROM every GROUP BY article_id)
SELECT product_code, graphical_appearance_name, perceived_colour_value_name, perceived_colour_master_name,
  product_group_name, index_group_name, min(article_id) AS article_id, count(*) AS variantes
FROM every JOIN last USING (article_id, seq)
GROUP BY product_code, graphical_appearance_name, perceived_colour_value_name, perceived_colour_master_name,
  product_group_name, index_group_name""",
    "phrase_search": f"""{_ranked(_PHRASE_REQUESTS, _PHRASES)}
SELECT query_id, rank, product_code, article_id, variantes, distancia FROM results""",
    "phrase_envelopes": f"""{_ranked(_PHRASE_REQUESTS, _PHRASES)}, lists AS (
  SELECT query_id, count(*) AS total, string_agg(CAST(product_code AS VARCHAR), ',' ORDER BY rank) AS productos
  FROM results GROUP BY query_id)
SELECT query_id, frase, coalesce(total, 0) AS total, array_to_string(dropped, ', ') AS filtros_relajados,
  coalesce(productos, '') AS productos
FROM relaxed LEFT JOIN lists USING (query_id)""",
    "validate_answers": f"""
WITH {_VALIDATED}
SELECT query_id, frase, publico, categoria, array_to_string(colores, '|') AS colores,
  array_to_string(colores_excluidos, '|') AS colores_excluidos, tono, estampado, consulta_semantica, intento,
  intentos_fallidos, array_to_string(list_sort(list_filter([bad_publico, bad_categoria, bad_colores,
    bad_colores_excluidos, bad_tono, bad_estampado, bad_consulta_semantica], lambda x: x IS NOT NULL)), '|')
    AS campos_descartados,
  {_COMPACT} AS filtros_json
FROM fields""",
    "answers_to_search": f"""{_ranked(f"WITH {_VALIDATED} {_ASKED_BY_ANSWERS}")}
SELECT query_id, rank, product_code, article_id, variantes, distancia FROM results""",
}
