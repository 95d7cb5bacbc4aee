"""The identity graph of each as-of day, as plain tables keyed by the day.

Customers who used one identifier in the trailing window are tied. A value's
users change only when someone enters or leaves the window, so presence is
kept as runs of as-of days per (value, customer), and a value's number of
users as segments of days. Values with too few or too many users are pruned on
the segments, before any row is expanded to days: a hub costs a row per
customer and change, not per day, and never meets itself in the self-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coterie.config import GraphConfig


def identifier_pairs(payments: DataFrame, links) -> DataFrame:
    """Distinct (customer_id, day, link_type, value) of the link columns; null and empty values and keys are left out."""
    each = F.array(*(F.struct(F.lit(k.column).alias("link_type"), F.col(k.column).alias("value")) for k in links))
    long = payments.where("customer_id is not null and day is not null").select("customer_id", "day", F.inline(each))
    return long.where("value is not null and value <> ''").distinct()


def _runs(rows: DataFrame, keys: list[str], cfg: GraphConfig) -> DataFrame:
    """Runs (keys, from_day, to_day) of as-of days on which some row's day lies in the window before."""
    w = Window.partitionBy(*keys).orderBy("day")
    starts = rows.withColumn("new", F.coalesce((F.col("day") - F.lag("day").over(w) > cfg.window_days).cast("int"), F.lit(1)))
    island = starts.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(*keys, "island").agg(F.greatest(F.min("day") + 1, F.lit(cfg.first_as_of)).alias("from_day"), F.least(F.max("day") + cfg.window_days, F.lit(cfg.last_as_of)).alias("to_day"))
    return out.where("from_day <= to_day").drop("island")


def presence(pairs: DataFrame, cfg: GraphConfig) -> DataFrame:
    """Runs (link_type, value, customer_id, from_day, to_day).

    A customer's days with a value are bounded by the span of time, so no
    window group grows with the data.
    """
    return _runs(pairs, ["link_type", "value", "customer_id"], cfg)


def user_segments(runs: DataFrame, cfg: GraphConfig) -> DataFrame:
    """Segments (link_type, value, from_day, to_day, df) of as-of days with the same number of users, where it is not 0."""
    ends = F.array(F.struct(F.col("from_day").alias("day"), F.lit(1).alias("d")), F.struct((F.col("to_day") + 1).alias("day"), F.lit(-1).alias("d")))
    steps = runs.select("link_type", "value", F.inline(ends)).groupBy("link_type", "value", "day").agg(F.sum("d").alias("d")).where("d <> 0")
    w = Window.partitionBy("link_type", "value").orderBy("day")
    out = steps.select("link_type", "value", F.col("day").alias("from_day"), (F.lead("day").over(w) - 1).alias("to_day"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("df"))
    return out.where("df > 0").withColumn("to_day", F.coalesce("to_day", F.lit(cfg.last_as_of)))


def window_nodes(payments: DataFrame, cfg: GraphConfig) -> DataFrame:
    """(as_of_day, customer_id) of the customers with a payment in the window."""
    days = payments.where("customer_id is not null and day is not null").select("customer_id", "day").distinct()
    return _runs(days, ["customer_id"], cfg).select(F.explode(F.sequence("from_day", "to_day")).alias("as_of_day"), "customer_id")


def window_sizes(payments: DataFrame, cfg: GraphConfig) -> DataFrame:
    """(as_of_day, n_customers): customers with a payment in the window, from the days they enter and leave.

    Combined to a row per day before the running sum.
    """
    days = payments.where("customer_id is not null and day is not null").select("customer_id", "day").distinct()
    ends = F.array(F.struct(F.col("from_day").alias("day"), F.lit(1).alias("d")), F.struct((F.col("to_day") + 1).alias("day"), F.lit(-1).alias("d")))
    steps = _runs(days, ["customer_id"], cfg).select(F.inline(ends)).groupBy("day").agg(F.sum("d").alias("d"))
    every = payments.sparkSession.range(cfg.first_as_of, cfg.last_as_of + 1).select(F.col("id").cast("int").alias("day")).join(F.broadcast(steps), "day", "left")
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return every.select(F.col("day").alias("as_of_day"), F.coalesce(F.sum("d").over(so_far), F.lit(0)).alias("n_customers"))


def cap(cfg: GraphConfig) -> Column:
    """The most users of a value, by its link type."""
    return _by_type(cfg, lambda k: min(k.max_df, cfg.max_degree))


def _by_type(cfg: GraphConfig, of) -> Column:
    return reduce(lambda out, k: out.when(F.col("link_type") == k.column, of(k)), cfg.links[1:], F.when(F.col("link_type") == cfg.links[0].column, of(cfg.links[0])))


def identifier_weights(segments: DataFrame, sizes: DataFrame, cfg: GraphConfig) -> DataFrame:
    """(as_of_day, link_type, value, df, weight) of the values that tie: rare ones weigh more.

    The weight is ln(N / df) / ln(N), not below 0, times the prior of the link
    type, where N counts the day's customers; weights under the floor are
    dropped. The table of N has a row per day and is broadcast.
    """
    kept = segments.where((F.col("df") >= 2) & (F.col("df") <= cap(cfg)))
    days = kept.select("link_type", "value", "df", F.explode(F.sequence("from_day", "to_day")).alias("as_of_day"))
    idf = F.greatest(F.ln(F.col("n_customers") / F.col("df")) / F.nullif(F.ln("n_customers"), F.lit(0.0)), F.lit(0.0))
    weighted = days.join(F.broadcast(sizes), "as_of_day").withColumn("weight", idf * _by_type(cfg, lambda k: F.lit(k.prior)))
    return weighted.where(F.col("weight") >= cfg.min_weight).select("as_of_day", "link_type", "value", "df", "weight")


def tying_runs(runs: DataFrame, segments: DataFrame, cfg: GraphConfig) -> DataFrame:
    """(link_type, value, customer_id, from_day, to_day): the runs cut to the days on which the number of users lets the value tie."""
    w = Window.partitionBy("link_type", "value").orderBy("from_day")
    kept = segments.where((F.col("df") >= 2) & (F.col("df") <= cap(cfg)))
    apart = F.coalesce((F.col("from_day") > F.lag("to_day").over(w) + 1).cast("int"), F.lit(1))
    stretch = kept.withColumn("apart", apart).withColumn("stretch", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = stretch.groupBy("link_type", "value", "stretch").agg(F.min("from_day").alias("lo"), F.max("to_day").alias("hi"))
    cut = runs.join(spans, ["link_type", "value"]).select("link_type", "value", "customer_id", F.greatest("from_day", "lo").alias("from_day"), F.least("to_day", "hi").alias("to_day"))
    return cut.where("from_day <= to_day")


def memberships(tying: DataFrame, weights: DataFrame) -> DataFrame:
    """(as_of_day, link_type, value, customer_id, weight) of the weighted values, a row per day of each run."""
    days = tying.select("link_type", "value", "customer_id", F.explode(F.sequence("from_day", "to_day")).alias("as_of_day"))
    return days.join(weights.select("as_of_day", "link_type", "value", "weight"), ["as_of_day", "link_type", "value"])


def edges_of_runs(tying: DataFrame, weights: DataFrame, cfg: GraphConfig) -> DataFrame:
    """(as_of_day, src, dst, weight) with src < dst: shared weights added up, sums under the floor dropped.

    Runs, not days, meet in the self-join: two users of a value are paired once
    for all the days on which both use it. A value's weights travel as one list
    with an entry per day, of which a pair takes its days. Days are expanded
    after the pairs are placed by (src, dst), so the sum needs no other shuffle.
    """
    keys = ["link_type", "value"]
    by_day = weights.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("as_of_day", "weight"))).alias("days"))
    a = tying.select(*keys, F.col("customer_id").alias("src"), F.col("from_day").alias("f1"), F.col("to_day").alias("t1"))
    b = tying.select(*keys, F.col("customer_id").alias("dst"), F.col("from_day").alias("f2"), F.col("to_day").alias("t2"))
    met = a.join(b, keys).where((F.col("src") < F.col("dst")) & (F.col("f1") <= F.col("t2")) & (F.col("f2") <= F.col("t1")))
    first, last = F.greatest("f1", "f2"), F.least("t1", "t2")
    pairs = met.select(*keys, "src", "dst", first.alias("f"), last.alias("t")).join(by_day, keys)
    both = pairs.select("src", "dst", F.filter("days", lambda d: d["as_of_day"].between(F.col("f"), F.col("t"))).alias("days"))
    placed = both.where(F.size("days") > 0).repartition("src", "dst").select("src", "dst", F.inline("days"))
    return placed.groupBy("as_of_day", "src", "dst").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= cfg.min_weight)


def identity_edges(members: DataFrame, cfg: GraphConfig) -> DataFrame:
    """The same as ``edges_of_runs``, from the memberships of each day.

    A value has at most its cap of users, so it gives at most cap² / 2 pairs.
    """
    keys = ["as_of_day", "link_type", "value"]
    a = members.select(*keys, F.col("customer_id").alias("src"), "weight")
    b = members.select(*keys, F.col("customer_id").alias("dst"))
    both = a.join(b, keys).where("src < dst")
    return both.groupBy("as_of_day", "src", "dst").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= cfg.min_weight)


def tie_stars(members: DataFrame) -> DataFrame:
    """(as_of_day, src, dst): the users of each value tied to the smallest of them.

    They connect the same customers as the edges, since every weight that is
    kept reaches the floor on its own, with df - 1 rows per value.
    """
    first = members.groupBy("as_of_day", "link_type", "value").agg(F.min("customer_id").alias("src"))
    return members.join(first, ["as_of_day", "link_type", "value"]).where("src <> customer_id").select("as_of_day", "src", F.col("customer_id").alias("dst"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree, weighted degree, and greatest and mean edge weight of each node; 0 for isolated ones."""
    ends = F.array(F.struct(F.col("src").alias("customer_id"), "weight"), F.struct(F.col("dst").alias("customer_id"), "weight"))
    per = edges.select("as_of_day", F.inline(ends)).groupBy("as_of_day", "customer_id").agg(
        F.count(F.lit(1)).alias("g_degree"), F.sum("weight").alias("g_weighted_degree"), F.max("weight").alias("g_max_edge_weight"), F.avg("weight").alias("g_mean_edge_weight")
    )
    zero = {"g_degree": F.lit(0).cast("bigint"), "g_weighted_degree": F.lit(0.0), "g_max_edge_weight": F.lit(0.0), "g_mean_edge_weight": F.lit(0.0)}
    return nodes.join(per, ["as_of_day", "customer_id"], "left").withColumns({c: F.coalesce(c, z) for c, z in zero.items()})
