"""Checks of the data and features that must hold before results are published."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.config import GraphConfig
from coterie.operators.clusters import cluster_behaviour

#: Columns that tell the outcome or are known only afterwards; no model may read them.
FORBIDDEN = frozenset(
    "is_fraud refunded disputed refund_day dispute_day dispute_lag_days error_code error_reason ring_id ring_type benign_cluster split label_available_day label_matured payment_id customer_id order_id entity card_fingerprint device_fingerprint shipping_address_hash contact email email_root ip card_last4 currency created_at day signup_day status y".split()
)


def assert_allowed(columns: list[str]) -> None:
    """Raise an error that names the forbidden columns among those of a model."""
    if leaks := sorted(FORBIDDEN & set(columns)):
        raise ValueError(f"forbidden model columns: {', '.join(leaks)}")


def _check(name: str, df: DataFrame, bad: Column) -> DataFrame:
    return df.agg(F.count_if(bad).alias("violations"), F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("check"), "violations", "rows")


def _in_window(rows: DataFrame, seen: DataFrame, keys: list[str], window_days: int) -> DataFrame:
    """``rows`` with whether one of the days in ``seen`` (keys, day) lies in the window before the as-of day.

    A key has a day per day of the span at most, so its list is bounded by time.
    """
    days = seen.groupBy(*keys).agg(F.collect_set("day").alias("days"))
    inside = F.exists("days", lambda d: (d < F.col("as_of_day")) & (d >= F.col("as_of_day") - window_days))
    return rows.join(days, keys, "left").withColumn("inside", F.coalesce(inside, F.lit(False)))


def violations(payments: DataFrame, pairs: DataFrame, members: DataFrame, clusters: DataFrame, window_days: int, splits_of: Column, as_of: int) -> DataFrame:
    """(check, violations, rows) of each data-level check.

    Every user of a value and every account of a cluster of some day's graph is
    joined back to the payments: one of the window before that day must be
    there. Besides what must be 0, the number of payments is told whose clock
    shows a later day than their ``day``: for those a graph by day may hold
    events that are later by the clock.
    """
    users = _in_window(members, pairs, ["link_type", "value", "customer_id"], window_days)
    accounts = _in_window(clusters.select("as_of_day", "customer_id"), payments.select("customer_id", "day").where("day is not null"), ["customer_id"], window_days)
    labelled = payments.withColumn("part", splits_of)
    parts = [
        _check("tie without a payment in its window", users, ~F.col("inside")),
        _check("clustered account without a payment in its window", accounts, ~F.col("inside")),
        _check("immature label in training", labelled.where(F.col("part").isin("train", "val") & F.coalesce("label_matured", F.lit(False))), F.col("label_available_day") > as_of),
        _check("clock after day", payments.where("day is not null"), F.floor(F.col("created_at") / 86400) > F.col("day")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Columns that tell how a payment ended.
OUTCOMES = ("is_fraud", "refunded", "disputed", "refund_day", "dispute_day", "ring_id", "ring_type", "benign_cluster", "label_available_day", "label_matured")


def outcome_free(payments: DataFrame, clusters: DataFrame, cfg: GraphConfig) -> DataFrame:
    """(check, violations, rows): whether cluster statistics can be made from payments without any outcome column.

    A plan that named one would not resolve, and that is a violation.
    """
    spark, bad = payments.sparkSession, 0
    try:
        cluster_behaviour(payments.drop(*OUTCOMES), clusters, cfg)
    except AnalysisException:
        bad = 1
    return spark.createDataFrame([("outcome in cluster statistics", bad, len(OUTCOMES))], "`check` string, violations bigint, rows bigint")
