"""op7 against brute force."""

import math
import random
from fractions import Fraction

import pytest

from graphloom.llm import pivot_search as p

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, every, k):
    good = [(i, [math.floor(256 * Fraction(float(c))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for q, x in {(i, tuple(v)) for i, v in good if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in good if i != q and len(v) == len(x))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("block", [p.BLOCK, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(p, "BLOCK", block)
    monkeypatch.setattr(p, "SLICE", 64)
    r = random.Random(4)
    quarter = lambda: r.choice([-0.5, 0.25, 0.125, 1.0, -0.0078125])
    rows = [(i, [quarter() for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)]
    rows += [(2000, None), (2010, []), (2020, [None] * 8), (2030, [float("nan")] * 8), (2040, [float("inf")] * 8), (None, rows[1][1]), (2050, [1.0, 2.0]), (2060, [3.0, 4.0]), (2070, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    assert {tuple(x) for x in p.top_k(df, 10, 5).collect()} == brute(rows, 10, 5)


def test_components_of_any_size(spark):
    """Beyond what floating point multiplies exactly, and beyond a long: ranks are exact, such a score is null."""
    r = random.Random(5)
    kinds = [lambda: r.uniform(-1, 1), lambda: r.uniform(-1, 1) * 2.0 ** r.randint(20, 44), lambda: r.choice([-1, 1]) * 2.0 ** r.randint(45, 1023), lambda: r.choice([5e-324, -5e-324, 0.0])]
    rows = [(i, [r.choice(kinds if i % 4 == 0 else kinds[:1])() for _ in range(3)]) for i in range(120)]
    rows += [(200 + i, [r.uniform(-1, 1) * 2.0 ** r.randint(0, 20) for _ in range(4)]) for i in range(30)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (10, rows[10][1]), (10, rows[10][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(3)
    wanted = {(q, n, i, s if -(1 << 63) <= s < 1 << 63 else None) for q, n, i, s in brute(rows, 10, 5)}
    got = [tuple(x) for x in p.top_k(df, 10, 5).collect()]
    assert len(got) == 75 and set(got) == wanted and any(x[3] is None for x in got) and any(x[3] is not None for x in got)


def test_place_keeps_the_order():
    values = sorted([0, 1, -1, 255, 256, -255, -256, 1 << 70, -(1 << 70), (1 << 70) + 1, -(1 << 2080), 1 << 2080])
    assert sorted(values, key=p.place) == values


def test_empty(spark):
    assert p.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
