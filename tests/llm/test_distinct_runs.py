import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.llm import distinct_runs as d
from tests.conftest import rows

SCHEMA = "field tinyint, id string, day int, method string, city string, bucket int, run binary"


def test_runs_survive_coding():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        run = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64))
        assert (d.decode_run(d.encode_run(run)) == run).all()
    edge = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    assert (d.decode_run(d.encode_run(edge)) == edge).all()


def test_union_of_runs():
    a, b = np.array([1, 5, 9], np.uint64), np.array([1, 2, 9, 2**64 - 1], np.uint64)
    assert d.union_runs([a, b, a]).tolist() == [1, 2, 5, 9, 2**64 - 1]


def _data(n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(2), rng.choice(["hot"] * 20 + [None, ""] + [f"id{i}" for i in range(40)]), rng.choice([0, 1, 2, None]), rng.choice(["x", "y", None]), rng.choice(["p", None]), 3, b"") for _ in range(n)]


def _brute(data):
    from itertools import combinations

    sets = {}
    for f, i, *dims in ((r[0], r[1], *r[2:5]) for r in data if r[1] is not None):
        of = dict(zip(d.DIMS, dims, strict=True))
        for n in range(4):
            for c in combinations(d.DIMS, n):
                sets.setdefault((f, "+".join(c) or "all", *(of[x] if x in c else None for x in d.DIMS)), set()).add(i)
    return sorted(((*k, len(v)) for k, v in sets.items()), key=repr)


def test_counts_equal_exact_ones_and_stores_merge(spark):
    one, two = _data(400, 1), _data(300, 2)
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    a, b = d.build_runs(df(one), 2), d.build_runs(df(two), 2)
    cols = ("field", "grouping", *d.DIMS, "n")
    assert rows(d.distinct_counts(a), *cols) == _brute(one)
    assert rows(d.distinct_counts(d.merge_stores(a, b)), *cols) == _brute(one + two)
    assert rows(d.distinct_counts(d.build_runs(df(one), 5)), *cols) == _brute(one)


@pytest.mark.parametrize(("first", "second"), [(2, 4), (5, 2), (3, 3)])
def test_stores_of_different_bits_merge(spark, first, second):
    one, two = _data(400, 3), _data(300, 4)
    a, b = d.build_runs(spark.createDataFrame(one, SCHEMA), first), d.build_runs(spark.createDataFrame(two, SCHEMA), second)
    merged = d.merge_stores(a, b)
    assert {r.bits for r in merged.collect()} == {max(first, second)}
    assert rows(d.distinct_counts(merged), "field", "grouping", *d.DIMS, "n") == _brute(one + two)
    if first != second:
        with pytest.raises(Exception, match="different bits"):
            d.distinct_counts(a.unionByName(b)).collect()
    with pytest.raises(Exception, match="cannot be put"):
        d.with_bits(a, 1).collect()


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(d.merge_stores(d.build_runs(empty, 2), d.build_runs(empty, 3))) == []
    assert rows(d.distinct_counts(d.build_runs(empty, 2))) == []


def test_error_bound_and_bits(spark):
    df = spark.createDataFrame([(10**9,)], "n bigint")
    assert abs(d.with_error(df).head().error_bound - 10**9 * (10**9 - 1) / 2**65) < 1e-6
    assert d.hash_bits(0) == 2 and d.hash_bits(10**9) == 13
    assert df.select(F.lit(1)).count() == 1
