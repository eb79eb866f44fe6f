import random

import pytest
from rows import sales, values

from tillview.operators import running
from tillview.plans.pareto import pareto_customers
from tillview.schema import ParetoParams
from tillview.sources.staging import stage

BASE = ("gross", "net", "doc_no", "phone", "store")


def table(spark, rows):
    return sales(spark, [(g, n, f"d{i}", p, s) for i, (g, n, p, s) in enumerate(rows)], *BASE)


SMALL = [
    (10, 10, "a", "one"),
    *((10, n, f"b{n}", "four") for n in (1, 2, 3, 4)),
    *((10, n, f"c{n}", "five") for n in (1, 2, 3, 4, 5)),
    (5, 5, "x", "zero"), (5, -5, "y", "zero"), (0, 0, "z", "zero"),
    (1, 1, None, "one"), (1, 1, "a", None),
]


@pytest.mark.parametrize("blocks", [None, 1, 3, 40])
def test_small_stores(spark, blocks):
    top = pareto_customers(table(spark, SMALL), ParetoParams(), blocks)
    assert values(top, "store", "phone", "contribution_pct", "cum_pct") == [
        ("five", "c5", 33.33, 33.33),
        ("four", "b4", 40, 40),
        ("one", "a", 100, 100),
        ("zero", "x", 0, 0),
    ]
    bottom = pareto_customers(table(spark, SMALL), ParetoParams(percent=40, top=False), blocks)
    assert values(bottom, "store", "phone", "contribution_pct", "cum_pct") == [
        ("five", "c2", 13.33, 93.33),
        ("five", "c1", 6.67, 100),
        ("four", "b1", 10, 100),
        ("one", "a", 100, 100),
        ("zero", "y", 0, 0),
    ]


def test_discount_without_gross_is_null(spark):
    got = pareto_customers(table(spark, [(0, 0, "p", "s")])).first()
    assert got.discount_pct is None and got.orders == 1


def test_chosen_stores_and_empty_input(spark):
    df = table(spark, SMALL)
    assert set(values(pareto_customers(df, ParetoParams(stores=("one", "four"))), "store")) == {"one", "four"}
    assert pareto_customers(df.filter("false")).collect() == []


def brute_force(rows, percent, top):
    """The definition, by plain loops."""
    out = []
    for store in sorted({s for *_, s in rows}):
        net = {}
        for _, n, p, s in rows:
            if s == store:
                net[p] = net.get(p, 0) + n
        order = sorted(net, key=lambda p: (-net[p], p))
        total = sum(net.values())
        reached, ranked = 0, []
        for p in order:
            points = round(net[p] / total * 100 * 100) if total else 0
            reached += points
            ranked.append((store, p, points / 100, reached / 100))
        n = max(1, len(ranked) * percent // 100)
        out += ranked[:n] if top else ranked[-n:]
    return out


@pytest.mark.parametrize("percent, top", [(20, True), (5, False), (50, True), (33, False)])
def test_hot_store_with_ties_equals_brute_force(spark, percent, top):
    rng = random.Random(percent)
    rows = [(5, rng.choice([0, 1, 1, 2, 7, -3]), f"p{rng.randrange(900):03}", rng.choice("hhhhab")) for _ in range(3000)]
    df, params = table(spark, rows).cache(), ParetoParams(percent=percent, top=top)
    want = brute_force(rows, percent, top)
    for blocks in (None, 1, 7):
        got = pareto_customers(df, params, blocks)
        assert values(got, "store", "phone", "contribution_pct", "cum_pct") == want


def test_floating_point_amounts(spark):
    df = table(spark, SMALL)
    floats = df.withColumns({c: df[c].cast("double") for c in ("gross", "net")})
    for blocks in (None, 3):
        assert pareto_customers(floats, blocks=blocks).collect() == pareto_customers(df).collect()


def test_customers_are_ranged_without_a_join(spark, monkeypatch):
    """Finding block bounds runs the plan below twice, so it holds no join; totals come from blocks."""
    written = {}

    def noted(df, label):
        written[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label)

    monkeypatch.setattr(running, "stage", noted)
    rows = [("s1", "a", 60, 60, "1"), ("s1", "b", 30, 30, "2"), ("s1", "c", 10, 10, "3"), ("s2", "a", 5, 5, "4")]
    got = pareto_customers(sales(spark, rows, "store", "phone", "gross", "net", "doc_no"), ParetoParams(percent=100), 3)
    assert [(r.store, r.contribution_pct, r.cum_pct) for r in got.collect()] == [
        ("s1", 60.0, 60.0), ("s1", 30.0, 90.0), ("s1", 10.0, 100.0), ("s2", 100.0, 100.0),
    ]
    assert "Join" not in written["blocks-store"]
