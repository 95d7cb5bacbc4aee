"""Each payment joined to the graph that existed before its day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.config import GraphConfig


def identifier_votes(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """(as_of_day, link_type, value, cluster): the cluster most users of a weighted value belong to.

    Ties go to the cluster that sorts first.
    """
    counted = members.join(clusters, ["as_of_day", "customer_id"]).groupBy("as_of_day", "link_type", "value", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("as_of_day", "link_type", "value").agg(F.min_by("cluster", F.struct(-F.col("n"), "cluster")).alias("cluster"))


def resolve(payments: DataFrame, clusters: DataFrame, votes: DataFrame, cfg: GraphConfig) -> DataFrame:
    """(payment_id, as_of_day, cluster, g_match): of the customer itself (1), else by identifier (2), else none (0).

    Identifiers are asked from the strongest link type to the weakest. The
    as-of day is the payment's own day, whose graph ends the day before, so
    the join is an equality. A payment sends a row per identifier it carries;
    values in no cluster have no vote, so the busiest values find no partner.
    """
    p = payments.where("payment_id is not null").select("payment_id", F.col("day").alias("as_of_day"), "customer_id", *(k.column for k in cfg.links))
    own = p.select("payment_id", "as_of_day", "customer_id").join(clusters, ["as_of_day", "customer_id"]).select("payment_id", F.lit(0).alias("rank"), "cluster")
    order = reduce(lambda out, ik: out.when(F.col("link_type") == ik[1].column, ik[0] + 1), enumerate(cfg.links), F.when(F.lit(False), 0))
    each = F.array(*(F.struct(F.lit(k.column).alias("link_type"), F.col(k.column).alias("value")) for k in cfg.links))
    long = p.select("payment_id", "as_of_day", F.inline(each)).where("value is not null and value <> ''")
    inherited = long.join(votes, ["as_of_day", "link_type", "value"]).select("payment_id", order.alias("rank"), "cluster")
    best = own.unionByName(inherited).groupBy("payment_id").agg(F.min(F.struct("rank", "cluster")).alias("best"))
    out = p.select("payment_id", "as_of_day").join(best, "payment_id", "left")
    match = F.when(F.col("best").isNull(), 0).when(F.col("best.rank") == 0, 1).otherwise(2)
    return out.select("payment_id", "as_of_day", F.col("best.cluster").alias("cluster"), match.alias("g_match"))


def graph_block(payments: DataFrame, resolved: DataFrame, degrees: DataFrame, stats: DataFrame) -> DataFrame:
    """The graph features of each payment.

    The degree columns are those of the customer's node, null where the
    customer was not in the window; the cluster columns follow the resolved
    cluster.
    """
    p = payments.select("payment_id", "customer_id").join(resolved, "payment_id")
    out = p.join(degrees, ["as_of_day", "customer_id"], "left").join(stats, ["as_of_day", "cluster"], "left")
    return out.withColumn("g_in_cluster", F.col("cluster").isNotNull().cast("int")).withColumn("g_snapshot_lag", F.lit(0)).drop("customer_id")
