import random

import pytest

from coterie.llm.match_groups import connected_groups, star_pairs
from tests.conftest import rows


def _groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((x, find(x)) for x in list(parent))


@pytest.mark.parametrize("seed", range(4))
def test_groups_equal_union_find(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"r{rng.randrange(120):03d}"
    pairs = [(name(), name()) for _ in range(90)] + [(None, "r001"), ("r002", None), ("r003", "r003")]
    pairs += pairs[:10] + [(b, a) for a, b in pairs[:10]]
    df = spark.createDataFrame([(*p, "x") for p in pairs], "a string, b string, root string")
    assert rows(connected_groups(df)) == _groups(pairs)


def test_long_chain_against_the_order(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    pairs = [(f"n{a:04d}", f"n{b:04d}") for a, b in zip(order, order[1:])]
    assert {g for _, g in rows(connected_groups(spark.createDataFrame(pairs, "a string, b string")))} == {"n0000"}


def test_no_pairs(spark):
    assert rows(connected_groups(spark.createDataFrame([], "a string, b string"))) == []


def test_star_pairs_leave_out_busy_values(spark):
    uses = [("k", "v1", f"c{i:02d}", 0) for i in range(20)] + [("k", "v2", f"c{i:02d}", 0) for i in range(21)] + [("k", "v3", "z", 0), ("k", "v3", "z", 0), ("k", None, "y", 0), ("k", "v4", None, 0), ("j", "v1", "q1", 0), ("j", "v1", "q2", 0)]
    df = spark.createDataFrame(uses * 2, "kind string, value string, record string, users int")
    assert rows(star_pairs(df)) == sorted([("c00", f"c{i:02d}") for i in range(1, 20)] + [("q1", "q2")], key=repr)


def test_only_few_records_of_a_value_leave_a_partition(spark):
    df = spark.createDataFrame([("k", "v", "r")], "kind string, value string, record string")
    plan = star_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1
