"""Connected components of each as-of day's graph, by the smallest member.

All days are solved at once: an edge carries its day, so labels of different
days never meet. Edges are first ranged by day into partitions of even size,
and each partition contracts its own edges to stars: most components lie in
one partition and are done then. Rounds over what is left hook each node to
the smallest label it can see (large star) and flatten the result (small
star); both keep the components and shorten paths geometrically. Rounds are
written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.runtime import discard, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("o")), F.struct(F.col("v").alias("c"), F.col("u").alias("o")))
    return edges.select("as_of_day", F.inline(ends))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood."""
    seen = _both_ways(edges)
    low = seen.groupBy("as_of_day", "c").agg(F.least(F.min("o"), F.col("c")).alias("low"))
    return seen.where("o > c").join(low, ["as_of_day", "c"]).select("as_of_day", F.col("o").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select("as_of_day", F.greatest("u", "v").alias("c"), F.least("u", "v").alias("o"))
    low = down.groupBy("as_of_day", "c").agg(F.min("o").alias("low"))
    moved = down.join(low, ["as_of_day", "c"]).select("as_of_day", F.inline(F.array(F.struct(F.col("o").alias("u"), F.col("low").alias("v")), F.struct(F.col("c").alias("u"), F.col("low").alias("v")))))
    return moved.where("u <> v").distinct()


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stars of one partition's edges: every node with the smallest node it is tied to."""
    parts = list(batches)
    if not parts:
        return
    pdf = pd.concat(parts, ignore_index=True)
    # numbers in the order of (day, name), so that a smaller number is a smaller node of the same day
    day = np.concatenate([pdf["as_of_day"], pdf["as_of_day"]])
    name = pd.factorize(np.concatenate([pdf["u"], pdf["v"]]), sort=True)
    nodes, number = np.unique(day.astype(np.int64) * len(name[1]) + name[0], return_inverse=True)
    a, b = number[: len(pdf)], number[len(pdf) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], low)
        while (up := new[new]).tobytes() != new.tobytes():
            new = up
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    of = lambda x: name[1][nodes[x] % len(name[1])]
    part = TaskContext.get().partitionId()
    yield pd.DataFrame({"as_of_day": (nodes[moved] // len(name[1])).astype(np.int32), "u": of(moved), "v": of(label[moved]), "part": part})


def connected_components(edges: DataFrame, rows: int | None = None, part_rows: int = 500_000) -> DataFrame:
    """(as_of_day, customer_id, component) of nodes with an edge; the component is its smallest member.

    Edges have as_of_day, src and dst; those with a null or of a node with
    itself are left out. No edges give no rows. ``rows`` is a bound of their
    number where one is known; a partition, which one worker contracts, holds
    about ``part_rows`` of them.
    """
    spark = edges.sparkSession
    # few partitions split few days, and a day that is not split needs no further rounds
    parts = max(1, -(-(edges.count() if rows is None else rows) // part_rows))
    ends = edges.where("src is not null and dst is not null and src <> dst").select(F.col("as_of_day").cast("int").alias("as_of_day"), F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    stars, _ = materialise(ends.repartitionByRange(parts, "as_of_day", "v").mapInPandas(_contract, "as_of_day int, u string, v string, part int"), "stars")
    # a day that lies in one partition is done; a row per other day is broadcast
    split = F.broadcast(stars.groupBy("as_of_day").agg((F.min("part") < F.max("part")).alias("split")).where("split").select("as_of_day"))
    done = stars.join(split, "as_of_day", "left_anti").select("as_of_day", "u", "v")
    now, path = materialise(stars.join(split, "as_of_day", "left_semi").select("as_of_day", "u", "v").distinct(), "stars")
    h = F.xxhash64("as_of_day", "u", "v")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(0xFFFFFF)))).head())
    mark = state(now)
    while True:
        nxt, new_path = materialise(_small_star(_large_star(now)), "stars")
        # count and hash of the edges tell when a round changed nothing
        new_mark = state(nxt)
        discard(spark, path)
        now, path = nxt, new_path
        if new_mark == mark:
            break
        mark = new_mark
    now = now.unionByName(done)
    roots = now.select("as_of_day", F.col("v").alias("customer_id"), F.col("v").alias("component")).distinct()
    return now.select("as_of_day", F.col("u").alias("customer_id"), F.col("v").alias("component")).unionByName(roots)
