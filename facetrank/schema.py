"""Tables, facets and closed vocabularies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Column names, vocabularies, relaxation order and limits are part of the API.
TEXT_COLUMNS = (
    "prod_name",
    "product_type_name",
    "product_group_name",
    "index_group_name",
    "perceived_colour_master_name",
    "perceived_colour_value_name",
    "graphical_appearance_name",
    "detail_desc",
)
CATALOG_COLUMNS = ("article_id", "product_code", *TEXT_COLUMNS)
RESULT_COLUMNS = ("product_code", *TEXT_COLUMNS)

FACET_COLUMN = {
    "publico": "index_group_name",
    "categoria": "product_group_name",
    "colores": "perceived_colour_master_name",
    "tono": "perceived_colour_value_name",
    "estampado": "graphical_appearance_name",
}
HARD_FIELDS = ("publico", "categoria", "colores", "colores_excluidos", "tono", "estampado")
LIST_FIELDS = ("colores", "colores_excluidos")
RELAX_ORDER = ("estampado", "tono", "colores", "categoria", "publico")

DEFAULT_LIMIT = 24
MAX_LIMIT = 100

PUBLICO = ("Ladieswear", "Menswear", "Divided", "Baby/Children", "Sport")
CATEGORIA = (
    "Garment Upper body", "Garment Lower body", "Garment Full body", "Accessories", "Underwear",
    "Shoes", "Swimwear", "Socks & Tights", "Nightwear",
)
COLOR = (
    "Black", "White", "Grey", "Beige", "Brown", "Mole", "Blue", "Turquoise", "Green", "Khaki green",
    "Yellowish Green", "Bluish Green", "Yellow", "Orange", "Red", "Pink", "Lilac Purple", "Metal",
)
TONO = ("Dark", "Light", "Bright", "Dusty Light", "Medium", "Medium Dusty")
ESTAMPADO = (
    "Solid", "All over pattern", "Stripe", "Check", "Dot", "Denim", "Melange", "Lace", "Embroidery",
    "Sequin", "Glittering/Metallic", "Front print", "Transparent", "Mesh",
)

# Values a caller may ask for, per facet. Any catalog can bring its own mapping of this shape.
Vocabulary = Mapping[str, Sequence[str]]
CLOTHING: Vocabulary = {
    "publico": PUBLICO,
    "categoria": CATEGORIA,
    "colores": COLOR,
    "tono": TONO,
    "estampado": ESTAMPADO,
}


def vocabulary_of(vocab: Vocabulary, field_name: str) -> list[str]:
    """Both colour lists draw on the same vocabulary."""
    return list(vocab["colores" if field_name in LIST_FIELDS else field_name])


CATALOG_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType(), False) for c in ("article_id", "product_code")]
    + [T.StructField("prod_name", T.StringType(), False)]
    + [T.StructField(c, T.StringType(), True) for c in TEXT_COLUMNS[1:]]
)

VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("product_code", T.LongType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    ]
)

FILTER_SCHEMA = T.StructType(
    [
        T.StructField("publico", T.StringType()),
        T.StructField("categoria", T.StringType()),
        T.StructField("colores", T.ArrayType(T.StringType())),
        T.StructField("colores_excluidos", T.ArrayType(T.StringType())),
        T.StructField("tono", T.StringType()),
        T.StructField("estampado", T.StringType()),
        T.StructField("consulta_semantica", T.StringType()),
    ]
)
FILTER_FIELDS = tuple(FILTER_SCHEMA.fieldNames())


@dataclass(frozen=True)
class Filters:
    """Filters of one request. Batches carry the same fields as columns."""

    publico: str | None = None
    categoria: str | None = None
    colores: Sequence[str] = field(default_factory=tuple)
    colores_excluidos: Sequence[str] = field(default_factory=tuple)
    tono: str | None = None
    estampado: str | None = None
    consulta_semantica: str = ""


def check_limit(limit: int) -> int:
    """A limit outside the allowed range is refused, not clamped."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}, got {limit}")
    return limit
