"""Validation of model answers."""

import json

import pytest
from facetrank.operators.answers import validate_answers
from facetrank.schema import CLOTHING, FILTER_FIELDS, HARD_FIELDS, LIST_FIELDS, vocabulary_of


EMPTY = dict.fromkeys(HARD_FIELDS) | {field: [] for field in LIST_FIELDS}
SAID = "algo de abrigo"


def answer(**fields):
    """A complete answer that asks for nothing but what is given."""
    return json.dumps(EMPTY | {"consulta_semantica": SAID} | fields)


@pytest.fixture(scope="module")
def validate(spark):
    def run(*pairs):
        rows = [(i, f"frase {i}", *pair) for i, pair in enumerate(pairs)]
        table = spark.createDataFrame(rows, "query_id long, frase string, response_1 string, response_2 string")
        return sorted(validate_answers(table, CLOTHING).collect(), key=lambda r: r["query_id"])

    return run


def filters(row):
    return {f: row[f] for f in FILTER_FIELDS}


# Every value of every vocabulary by itself, and all fields at once.
EXAMPLES = [
    {field: [value] if field in LIST_FIELDS else value}
    for field in HARD_FIELDS for value in vocabulary_of(CLOTHING, field)
]
EXAMPLES.append({"consulta_semantica": "algo para la lluvia, ¿quizá de paño?"} | {
    field: vocabulary_of(CLOTHING, field)[-3:] if field in LIST_FIELDS else vocabulary_of(CLOTHING, field)[-1]
    for field in HARD_FIELDS
})


def test_complete_answers(validate):
    for row, fields in zip(validate(*[(answer(**e), None) for e in EXAMPLES]), EXAMPLES):
        assert filters(row) == {**EMPTY, "consulta_semantica": SAID, **fields}
        assert (row["intento"], row["intentos_fallidos"], row["campos_descartados"]) == (1, 0, [])
        assert json.loads(row["filtros_json"]) == {"consulta_semantica": SAID, **fields}


# (answer, fields kept, fields dropped); the semantic text falls back to the phrase where not given.
DEGRADED = [
    *[(answer(**{"estampado": "Solid", field: ["granito"] if field in LIST_FIELDS else "granito"}),
       {"consulta_semantica": SAID} | ({} if field == "estampado" else {"estampado": "Solid"}), [field])
      for field in HARD_FIELDS],
    (answer(**{field: "granito" for field in HARD_FIELDS}), {"consulta_semantica": SAID}, sorted(HARD_FIELDS)),
    (answer(colores=["Red", "granito"], colores_excluidos=["Blue", None]), {"consulta_semantica": SAID},
     ["colores", "colores_excluidos"]),
    (answer(colores="Red", publico=5, tono=["Dark"], estampado={"a": 1}), {"consulta_semantica": SAID},
     ["colores", "estampado", "publico", "tono"]),
    (answer(colores=None), {"consulta_semantica": SAID}, ["colores"]),
    (answer(publico="menswear"), {"consulta_semantica": SAID}, ["publico"]),
    (answer(colores=["Red", "Red"]), {"colores": ["Red", "Red"], "consulta_semantica": SAID}, []),
    ('{"publico":"Menswear","consulta_semantica":null}', {"publico": "Menswear"}, []),
    (answer(consulta_semantica="   "), {}, []),
    (answer(consulta_semantica="  \x1c\t\n"), {}, []),
    (answer(consulta_semantica="  un abrigo "), {"consulta_semantica": "  un abrigo "}, []),
    ('{"consulta_semantica":{"no":"es texto"},"publico":"Menswear"}', {"publico": "Menswear"}, ["consulta_semantica"]),
    ('{"consulta_semantica":7}', {}, ["consulta_semantica"]),
    ('{"consulta_semantica":0}', {}, []),
    ('{"consulta_semantica":0.0}', {}, []),
    ('{"consulta_semantica":false}', {}, []),
    ('{"consulta_semantica":true}', {}, ["consulta_semantica"]),
    ('{"consulta_semantica":[]}', {}, []),
    ('{"consulta_semantica":{}}', {}, []),
    ('{"consulta_semantica":"0"}', {"consulta_semantica": "0"}, []),
    ("{}", {}, []),
    ('{"talla":"M","precio":{"min":3}}', {}, []),
    ('  \n{"publico":"Sport"}\t ', {"publico": "Sport"}, []),
    # Accepted by a lenient reader only.
    ("[]", {}, []),
    ('""', {}, []),
    ('{"publico":"Menswear","publico":"Ladieswear"}', {"publico": "Ladieswear"}, []),
    ('{"a":{"b":NaN},"tono":"Dark"}', {"tono": "Dark"}, []),
    ('{"tono":NaN,"publico":"Sport"}', {"publico": "Sport"}, ["tono"]),
    ('[["publico","Menswear"],["colores",["Red"]]]', {"publico": "Menswear", "colores": ["Red"]}, []),
]


def test_invalid_fields_are_dropped_whole(validate):
    for i, (row, (text, kept, dropped)) in enumerate(zip(validate(*[(d[0], None) for d in DEGRADED]), DEGRADED)):
        assert filters(row) == {**EMPTY, "consulta_semantica": f"frase {i}", **kept}, text
        assert (row["intento"], row["campos_descartados"]) == (1, dropped), text


UNUSABLE = [
    None, "", '{"tono":', "null", "5", "true", '"texto"', "[1]", '{"tono":"Dark"} junk', '{"tono":"Dark"}{}',
    '{"tono":"Dark"},{"a":1}', '{"tono":"Dark"}]', '{"tono":"Dark"}}', '{"tono":"Dark"}] {}', '{"tono":"Dark"}, null',
    '{"tono":"Dark"},', "{'tono':'Dark'}", '{"tono":"Dark"', '{tono:"Dark"}', "NaN",
]


def test_second_answer_replaces_an_unusable_one(validate):
    for row, text in zip(validate(*[(u, answer(publico="Menswear")) for u in UNUSABLE]), UNUSABLE):
        assert (row["intento"], row["intentos_fallidos"], row["publico"], row["tono"]) == (2, 1, "Menswear", None), text


def test_phrase_alone_if_no_answer_is_usable(validate):
    for i, (row, text) in enumerate(zip(validate(*[(u, u) for u in UNUSABLE]), UNUSABLE)):
        assert filters(row) == {**EMPTY, "consulta_semantica": f"frase {i}"}, text
        assert (row["intento"], row["intentos_fallidos"]) == (0, 2), text


def test_first_usable_answer_wins(validate):
    [row] = validate((answer(tono="Dark"), answer(tono="Light")))
    assert (row["tono"], row["intento"]) == ("Dark", 1)


def test_json_keeps_accents(validate):
    [row] = validate((answer(consulta_semantica="bañador"), None))
    assert row["filtros_json"] == '{"consulta_semantica":"bañador"}'
