"""Relaxation, against a loop that counts again after each dropped filter."""

import random

import pytest
from facetrank.operators.relax import relax
from facetrank.schema import FACET_COLUMN, FILTER_FIELDS, RELAX_ORDER

ALL = {
    "estampado": "Transparent", "tono": "Dusty Light", "colores": ["Mole", "Beige"], "categoria": "Underwear",
    "publico": "Ladieswear",
}


def relaxed(catalog, requests, *asked):
    return sorted(relax(requests(*asked), catalog).collect(), key=lambda r: r["query_id"])


def test_drops_in_order_until_something_is_found(four, requests):
    rows = relaxed(
        four, requests,
        {"categoria": "Shoes"},
        {"categoria": "Shoes", "estampado": "Dot"},
        {"categoria": "Shoes", "estampado": "Dot", "tono": "Bright"},
        {"publico": "Ladieswear"},
        ALL,
    )
    assert [r["filtros_relajados"] for r in rows] == [
        [], ["estampado"], ["estampado", "tono"], ["publico"], list(RELAX_ORDER),
    ]
    assert rows[0]["aplicado_categoria"] == "Shoes"
    assert (rows[1]["aplicado_categoria"], rows[1]["aplicado_estampado"]) == ("Shoes", None)
    assert rows[4]["aplicado_colores"] == []


def test_excluded_colours_stay(four, requests):
    [row] = relaxed(four, requests, {"colores_excluidos": ["Grey"], "estampado": "Melange"})
    assert row["aplicado_colores_excluidos"] == ["Grey"]
    assert row["filtros_relajados"] == ["estampado"]


def test_nothing_left_even_after_relaxing(four, requests):
    [row] = relaxed(four, requests, {"colores_excluidos": ["Pink", "Grey", "Yellow", "Green"], "publico": "Menswear"})
    assert row["filtros_relajados"] == ["publico"]


def test_contradictory_colours_are_relaxed(four, requests):
    [row] = relaxed(four, requests, {"colores": ["Grey"], "colores_excluidos": ["Grey"]})
    assert row["filtros_relajados"] == ["colores"]


def test_empty_text_and_null_lists_count_as_unset(four, requests):
    [row] = relaxed(four, requests, {"publico": "", "colores": None, "colores_excluidos": None})
    assert row["filtros_relajados"] == []


def test_other_fields_pass_through(four, requests):
    [row] = relaxed(four, requests, {"consulta_semantica": "warm coat"})
    assert row["aplicado_consulta_semantica"] == "warm coat"
    assert {f"aplicado_{f}" for f in FILTER_FIELDS} < set(row.asDict())


def by_counting(rows, request):
    def passes(row, active):
        colour = row[FACET_COLUMN["colores"]]
        if request["colores_excluidos"] and (colour is None or colour in request["colores_excluidos"]):
            return False
        return all(
            row[FACET_COLUMN[f]] in (request[f] if f == "colores" else [request[f]])
            and row[FACET_COLUMN[f]] is not None
            for f in active
        )

    active = [f for f in RELAX_ORDER if request[f]]
    dropped = []
    for name in list(active):
        if any(passes(r, active) for r in rows):
            break
        active.remove(name)
        dropped.append(name)
    return dropped


@pytest.mark.parametrize("seed", [1, 2])
def test_random_requests(articles, requests, seed):
    rng = random.Random(seed)
    values = {f: ["a", "b", "c", None] for f in RELAX_ORDER}
    catalog = [
        {"article_id": i, "product_code": i // 3, **{FACET_COLUMN[f]: rng.choice(values[f]) for f in RELAX_ORDER}}
        for i in range(40)
    ]
    wishes = ["a", "b", "c", "d", None]
    asked = [
        {
            **{f: rng.choice(wishes) for f in RELAX_ORDER if f != "colores"},
            "colores": rng.sample(["a", "b", "c", "d"], rng.randint(0, 2)),
            "colores_excluidos": rng.sample(["a", "b", "c", "d"], rng.choice([0, 0, 1, 3])),
        }
        for _ in range(150)
    ]
    rows = relaxed(articles(*catalog), requests, *asked)
    assert [r["filtros_relajados"] for r in rows] == [by_counting(catalog, a) for a in asked]


def test_no_request_is_compared_with_every_article(spark, requests, plan_of):
    from conftest import SF
    from workload import tables as t

    plan = plan_of(relax(t.requests(spark, SF), t.catalog(spark, SF)))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
