"""Splitting loose components into communities.

Small or dense components stay whole. The others are split by Louvain on the
weighted edges, in one way at every size: the nodes move by halves, all of a
half at once, so the same moves can be made in a task or in DataFrames.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.config import GraphConfig
from coterie.runtime import materialise


def component_density(components: DataFrame, edges: DataFrame, cfg: GraphConfig) -> DataFrame:
    """(as_of_day, component, size, edges, density, whole) of each component of two or more."""
    size = components.groupBy("as_of_day", "component").agg(F.count(F.lit(1)).alias("size"))
    of = components.select("as_of_day", F.col("customer_id").alias("src"), "component")
    n = edges.join(of, ["as_of_day", "src"]).groupBy("as_of_day", "component").agg(F.count(F.lit(1)).alias("edges"))
    out = size.where("size >= 2").join(n, ["as_of_day", "component"])
    out = out.withColumn("density", F.col("edges") / (F.col("size") * (F.col("size") - 1) / 2))
    return out.withColumn("whole", (F.col("size") < cfg.whole_below) | (F.col("density") >= cfg.whole_density))


#: Gains and modularities are compared to so many digits, so that sums in any order give one result.
DIGITS = 9


def _turn(sweep: int) -> int:
    """Which bit of a node's checksum says whether it may move in a sweep; two sweeps in a row let every node move once."""
    return sweep // 2 % 32


def louvain(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, resolution: float = 0.92, names: list[str] | None = None) -> np.ndarray:
    """Community of each of ``n`` nodes by modularity, as the number of its first node.

    In each sweep one half of the nodes, by a checksum of their names, moves at
    once to the community of greatest gain, ties to the smaller; the next sweep
    moves the other half. When a pair of sweeps no longer raises the
    modularity, communities become nodes, until none merge. The result depends
    on the graph only, and is the same as that of ``louvain_tables``.
    """
    label = np.arange(n)
    two_m = 2 * float(weight.sum())
    if not two_m:
        return label
    sums = np.array([zlib.crc32(str(x).encode()) for x in (names if names is not None else range(n))], np.int64)
    ids = np.arange(n)  # the nodes of this level, by their first member
    while True:
        loop = src == dst
        a, b = np.concatenate([src[~loop], dst[~loop]]), np.concatenate([dst[~loop], src[~loop]])
        w = np.concatenate([weight[~loop], weight[~loop]])
        degree = np.bincount(a, w, n) + 2 * np.bincount(src[loop], weight[loop], n)

        def modularity(home: np.ndarray) -> float:
            inside = w[home[a] == home[b]].sum() + 2 * weight[loop].sum()
            return round(float(inside / two_m - resolution * ((np.bincount(home, degree, n) / two_m) ** 2).sum()), DIGITS)

        home = np.arange(n)
        best, best_q, sweep = home, modularity(home), 0
        while True:
            now = best.copy()
            for half in (0, 1):
                may = ((sums[ids] >> _turn(sweep)) & 1) == half
                total = np.bincount(now, degree, n)
                # weight of each node to each community near it, and 0 to its own
                v, c = np.concatenate([a, ids]), np.concatenate([now[b], now[ids]])
                pair, at = np.unique(v * n + c, return_inverse=True)
                near = np.bincount(at, np.concatenate([w, np.zeros(len(ids))]))
                v, c = pair // n, pair % n
                gain = np.round(near - resolution * (total[c] - np.where(c == now[v], degree[v], 0.0)) * degree[v] / two_m, DIGITS)
                own = np.full(n, -np.inf)
                own[v[c == now[v]]] = gain[c == now[v]]
                order = np.lexsort((c, -gain, v))
                first = order[np.concatenate([[True], v[order][1:] != v[order][:-1]])]
                go = may[np.searchsorted(ids, v[first])] & (gain[first] > own[v[first]])
                moved = now.copy()
                moved[v[first][go]] = c[first][go]
                now = moved
                sweep += 1
            q = modularity(now)
            if q <= best_q:
                break
            best, best_q = now, q
        # a community is named by its first node
        least = np.full(n, n)
        np.minimum.at(least, best[ids], ids)
        up = least[best]
        if (up[ids] == ids).all():
            return label
        label = up[label]
        src, dst = up[src], up[dst]
        lo, hi = np.minimum(src, dst), np.maximum(src, dst)
        pair, at = np.unique(lo * n + hi, return_inverse=True)
        weight, src, dst = np.bincount(at, weight), pair // n, pair % n
        ids = np.unique(up[ids])


def _split(resolution: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf["src"].to_numpy(object), pdf["dst"].to_numpy(object)]).astype(str))
        pdf = pdf.sort_values(["src", "dst"])
        part = louvain(np.searchsorted(names, pdf["src"].to_numpy(str)), np.searchsorted(names, pdf["dst"].to_numpy(str)), pdf["weight"].to_numpy(float), len(names), resolution, list(names))
        return pd.DataFrame({"as_of_day": pdf["as_of_day"].iloc[0], "component": pdf["component"].iloc[0], "customer_id": names, "part": names[part]})

    return run


def louvain_tables(edges: DataFrame, resolution: float = 0.92) -> DataFrame:
    """(as_of_day, component, customer_id, part): ``louvain`` in DataFrames, for components of any size.

    ``edges`` has as_of_day, component, src, dst, weight. Every sweep is a
    written table; no node, community or component is gathered in one place.
    """
    g = ["as_of_day", "component"]
    least, most = F.least("src", "dst"), F.greatest("src", "dst")
    level, _ = materialise(edges.select(*g, least.alias("a"), most.alias("b"), "weight").groupBy(*g, "a", "b").agg(F.sum("weight").alias("weight")), "level")
    size, _ = materialise(level.groupBy(*g).agg((2 * F.sum("weight")).alias("two_m")), "sizes")
    both = lambda x: F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u"), x), F.struct(F.col("b").alias("v"), F.col("a").alias("u"), x))
    label, _ = materialise(level.select(*g, F.inline(both(F.col("weight")))).select(*g, F.col("v").alias("customer_id"), F.col("v").alias("part")).distinct(), "labels")
    while True:
        near, _ = materialise(level.where("a <> b").select(*g, F.inline(both(F.col("weight")))), "near")
        loops = level.where("a = b").select(*g, F.col("a").alias("v"), (2 * F.col("weight")).alias("weight"))
        degree, _ = materialise(near.select(*g, "v", "weight").unionByName(loops).groupBy(*g, "v").agg(F.sum("weight").alias("k")), "degrees")

        def modularity(home: DataFrame) -> DataFrame:
            of = lambda end: home.select(*g, F.col("v").alias(end), F.col("c").alias(f"c_{end}"))
            inside = near.join(of("v"), [*g, "v"]).join(of("u"), [*g, "u"]).where("c_v = c_u").select(*g, "weight").unionByName(loops.select(*g, "weight")).groupBy(*g).agg(F.sum("weight").alias("inside"))
            total = home.join(degree, [*g, "v"]).groupBy(*g, "c").agg(F.sum("k").alias("t")).join(size, g).groupBy(*g).agg(F.sum((F.col("t") / F.col("two_m")) ** 2).alias("square"))
            q = F.coalesce(F.col("inside"), F.lit(0.0)) / F.col("two_m") - resolution * F.col("square")
            return total.join(inside, g, "left").join(size, g).select(*g, F.round(q, DIGITS).alias("q"))

        def moved(home: DataFrame, sweep: int, half: int) -> DataFrame:
            total = home.join(degree, [*g, "v"]).groupBy(*g, "c").agg(F.sum("k").alias("t"))
            seen = near.join(home.select(*g, F.col("v").alias("u"), "c"), [*g, "u"]).select(*g, "v", "c", "weight").unionByName(home.select(*g, "v", "c", F.lit(0.0).alias("weight")))
            votes = seen.groupBy(*g, "v", "c").agg(F.sum("weight").alias("near")).join(total, [*g, "c"]).join(degree, [*g, "v"]).join(home.withColumnRenamed("c", "own"), [*g, "v"]).join(size, g)
            here = F.col("c") == F.col("own")
            gain = F.round(F.col("near") - resolution * (F.col("t") - F.when(here, F.col("k")).otherwise(0.0)) * F.col("k") / F.col("two_m"), DIGITS)
            votes = votes.withColumn("gain", gain)
            best = votes.groupBy(*g, "v").agg(F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("best"), F.max(F.when(here, F.col("gain"))).alias("own_gain"), F.max("own").alias("own"))
            may = F.shiftright(F.crc32("v"), _turn(sweep)).bitwiseAND(F.lit(1)) == half
            return best.select(*g, "v", F.when(may & (-F.col("best.g") > F.col("own_gain")), F.col("best.c")).otherwise(F.col("own")).alias("c"))

        best, _ = materialise(degree.select(*g, "v", F.col("v").alias("c")), "homes")
        best_q, _ = materialise(modularity(best), "modularity")
        active, sweep = size.select(*g), 0
        while True:
            now, _ = materialise(moved(best, sweep, 0), "homes")
            now, _ = materialise(moved(now, sweep + 1, 1), "homes")
            sweep += 2
            q, _ = materialise(modularity(now), "modularity")
            better, _ = materialise(q.withColumnRenamed("q", "new").join(best_q, g).join(active, g, "left_semi").where("new > q").select(*g, F.col("new").alias("q")), "modularity")
            if not better.limit(1).count():
                break
            # a component whose modularity rose goes on, the others are done with this level
            best, _ = materialise(now.join(better, g, "left_semi").unionByName(best.join(better, g, "left_anti")), "homes")
            best_q, _ = materialise(better.unionByName(best_q.join(better, g, "left_anti")), "modularity")
            active = better.select(*g)
        first = best.groupBy(*g, "c").agg(F.min("v").alias("up"))
        up, _ = materialise(best.join(first, [*g, "c"]).select(*g, "v", "up"), "up")
        if not up.where("v <> up").limit(1).count():
            return label
        label, _ = materialise(label.join(up.withColumnRenamed("v", "part"), [*g, "part"]).select(*g, "customer_id", F.col("up").alias("part")), "labels")
        of = lambda end: up.select(*g, F.col("v").alias(end), F.col("up").alias(f"up_{end}"))
        merged = level.join(of("a"), [*g, "a"]).join(of("b"), [*g, "b"])
        level, _ = materialise(merged.select(*g, F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"), "weight").groupBy(*g, "a", "b").agg(F.sum("weight").alias("weight")), "level")


def communities(components: DataFrame, edges: DataFrame, cfg: GraphConfig, task_edges: int = 200_000) -> DataFrame:
    """(as_of_day, customer_id, cluster) with cluster = cl_<day>_<smallest member>.

    Components of at most ``task_edges`` edges are split in a task, larger
    ones in DataFrames, by the same moves and with the same result. Parts of a
    single node have no cluster.
    """
    density, _ = materialise(component_density(components, edges, cfg), "density")
    name = lambda least: F.concat(F.lit("cl_"), F.col("as_of_day"), F.lit("_"), least)
    kept = components.join(density.where("whole").select("as_of_day", "component"), ["as_of_day", "component"])
    whole = kept.select("as_of_day", "customer_id", name(F.col("component")).alias("cluster"))
    loose = density.where("not whole").select("as_of_day", "component", (F.col("edges") <= task_edges).alias("fits"))
    of = components.select("as_of_day", F.col("customer_id").alias("src"), "component").join(loose, ["as_of_day", "component"])
    inner = edges.join(of, ["as_of_day", "src"]).select("as_of_day", "component", "src", "dst", "weight", "fits")
    labelled = inner.where("fits").drop("fits").groupBy("as_of_day", "component").applyInPandas(_split(cfg.resolution), "as_of_day int, component string, customer_id string, part string")
    if loose.where("not fits").limit(1).count():
        labelled = labelled.unionByName(louvain_tables(inner.where("not fits").drop("fits"), cfg.resolution))
    # a part is named by its smallest member
    sized = labelled.groupBy("as_of_day", "component", "part").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    split = labelled.join(sized, ["as_of_day", "component", "part"]).select("as_of_day", "customer_id", name(F.col("part")).alias("cluster"))
    return whole.unionByName(split)
