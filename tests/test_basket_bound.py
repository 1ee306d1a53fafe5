"""Cross-sell with a support bound: the same rows, fewer pairs."""

import random

import pytest

from tests.frames import D, line, tx
from tillroll.functions.windows import Window
from tillroll.operators import basket as bsk

YEAR = Window(D(2000, 1, 1), D(2000, 12, 31))


@pytest.fixture(scope="module")
def lines(spark):
    """Orders of ten products whose sales fall off, and one order with all products."""
    rng = random.Random(3)
    weights = [1 / (p + 1) ** 1.5 for p in range(300)]
    rows = []
    for o in range(400):
        for p in set(rng.choices(range(300), weights, k=10)):
            rows.append(line(o % 50, o, D(2000, 1 + o % 12, 3), brand=1 + p % 5, product=p, unit=["CORE", "CULT"][o % 2]))
    rows += [line(9, 9999, D(2000, 5, 5), brand=1 + p % 5, product=p) for p in range(300)]
    return tx(spark, rows)


def products(spark):
    return spark.createDataFrame([(p, f"t{p}") for p in range(300)], "product_id bigint, product_title string")


@pytest.mark.parametrize("per_unit", [False, True])
@pytest.mark.parametrize("heavy", [1, 20, 10_000])
def test_same_rows(spark, lines, heavy, per_unit):
    args = (lines, products(spark), YEAR, [1, 3])
    got = bsk.basket_cross_sell_bounded(*args, k=3, per_business_unit=per_unit, heavy=heavy)
    want = bsk.basket_cross_sell(*args, k=3, per_business_unit=per_unit)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 100


def test_fewer_pairs(lines):
    basket = bsk.basket_lines(lines, YEAR, [1, 3])
    seed, rest = bsk.bounded_pairs(basket, 3, 20)
    every = bsk._pairs(bsk._targets(basket), bsk._others(basket)).count()
    assert seed.count() + rest.count() < 0.75 * every
