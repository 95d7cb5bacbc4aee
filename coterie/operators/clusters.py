"""Statistics of clusters: cohesion, behaviour in the window, and a risk prior."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.config import GraphConfig, Link
from coterie.operators import identity


def cluster_cohesion(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges inside each cluster: number, weights, size and density.

    ``clusters`` has as_of_day, customer_id, cluster.
    """
    of = lambda end: clusters.select("as_of_day", F.col("customer_id").alias(end), F.col("cluster").alias(f"c_{end}"))
    inside = edges.join(of("src"), ["as_of_day", "src"]).join(of("dst"), ["as_of_day", "dst"]).where("c_src = c_dst")
    per = inside.groupBy("as_of_day", F.col("c_src").alias("cluster")).agg(
        F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("mean_edge_weight"), F.max("weight").alias("max_edge_weight"), F.sum("weight").alias("total_weight")
    )
    size = clusters.groupBy("as_of_day", "cluster").agg(F.count(F.lit(1)).alias("size"))
    pairs = F.nullif(F.col("size") * (F.col("size") - 1) / 2, F.lit(0.0))
    return per.join(size, ["as_of_day", "cluster"]).withColumn("density", F.coalesce(F.col("edges") / pairs, F.lit(0.0)))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))


def window_rows(payments: DataFrame, clusters: DataFrame, window_days: int) -> DataFrame:
    """Payments with each as-of day and cluster in whose window they lie.

    Only customers that are ever in a cluster are expanded, and only over the
    days on which they are.
    """
    spans = clusters.groupBy("customer_id").agg(F.min("as_of_day").alias("lo"), F.max("as_of_day").alias("hi"))
    near = payments.where("day is not null").join(spans, "customer_id")
    first, last = F.greatest(F.col("day") + 1, "lo"), F.least(F.col("day") + window_days, "hi")
    days = near.where(first <= last).withColumn("as_of_day", F.explode(F.sequence(first, last))).drop("lo", "hi")
    return days.join(clusters, ["as_of_day", "customer_id"])


#: Identifiers of which a cluster's distinct values are counted, with the names of the counts.
COUNTED = {"card_fingerprint": "cl_distinct_cards", "device_fingerprint": "cl_distinct_devices", "shipping_address_hash": "cl_distinct_addresses", "ip": "cl_distinct_ips"}


def distinct_identifiers(runs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(as_of_day, cluster, a count per identifier): distinct values that a cluster's customers used in the window.

    ``runs`` say on which as-of days a customer's use of a value lies in the
    window, so no payment is repeated for the days after it. A value is first
    reduced to a row per cluster and day.
    """
    held = runs.where(F.col("link_type").isin(*COUNTED)).select("customer_id", "link_type", "value", "from_day", "to_day")
    used = clusters.join(held, "customer_id").where(F.col("as_of_day").between(F.col("from_day"), F.col("to_day")))
    once = used.select("as_of_day", "cluster", "link_type", "value").distinct()
    return once.groupBy("as_of_day", "cluster").agg(*(F.count_if(F.col("link_type") == c).alias(n) for c, n in COUNTED.items()))


def cluster_behaviour(payments: DataFrame, clusters: DataFrame, cfg: GraphConfig, runs: DataFrame | None = None) -> DataFrame:
    """Statistics of the payments that a cluster's customers made in the window before the as-of day.

    Nothing here reads a label. Nulls are not counted among distinct values.
    The last-seen lag counts from the last day of any cluster's payments.
    ``runs`` are those of ``identity.presence``, where they exist already.
    """
    if runs is None:
        runs = identity.presence(identity.identifier_pairs(payments, [Link(c, 1.0, 0) for c in COUNTED]), cfg)
    each = payments.select("payment_id", "customer_id", "day", "created_at", "amount", "status", "account_age_days", "card_issuer", "signup_day")
    rows = window_rows(each, clusters, cfg.window_days)
    keys = ["as_of_day", "cluster"]
    amount_mean = F.avg("amount")
    # the days of the window fit the bits of a number; longer windows are counted by their values
    day = F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(as_of_day - 1 - day as int))"))) if cfg.window_days < 64 else F.count_distinct("day")
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cl_payments"),
        F.avg((F.coalesce(F.col("status"), F.lit("")) != "captured").cast("double")).alias("cl_failure_rate"),
        amount_mean.alias("cl_amount_mean"),
        F.median("amount").alias("cl_amount_median"),
        (F.stddev_samp("amount") / F.nullif(amount_mean, F.lit(0.0))).alias("cl_amount_cv"),
        F.avg("account_age_days").alias("cl_account_age_mean"),
        F.min("account_age_days").cast("double").alias("cl_account_age_min"),
        day.cast("bigint").alias("cl_active_days"),
        (F.max("day") - F.min("day") + 1).cast("bigint").alias("cl_day_span"),
        F.max("day").alias("last_day"),
        F.avg(F.coalesce((F.col("account_age_days") < 30).cast("double"), F.lit(0.0))).alias("cl_new_account_share"),
    )
    issuers = rows.where("card_issuer is not null").select(*keys, "card_issuer").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("cl_distinct_issuers"))
    base = base.join(distinct_identifiers(runs, clusters), keys, "left").join(issuers, keys, "left")
    base = base.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in (*COUNTED.values(), "cl_distinct_issuers")})
    # an account's sign-up day may differ between payments: that of its first one in the window counts
    firsts = rows.groupBy("as_of_day", "cluster", "customer_id").agg(F.min("day").alias("first_day"), F.min_by("signup_day", F.struct("created_at", "payment_id")).alias("signup"))
    cohort = firsts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cl_customers"),
        F.stddev_samp("signup").alias("cl_signup_std"),
        (F.max("signup") - F.min("signup")).cast("double").alias("cl_signup_span"),
        F.stddev_samp("first_day").alias("cl_first_seen_std"),
        (F.max("first_day") - F.min("first_day")).cast("double").alias("cl_first_seen_span"),
    )
    last = base.groupBy("as_of_day").agg(F.max("last_day").alias("last_of_all"))  # a row per day
    out = base.join(F.broadcast(last), "as_of_day").join(cohort, ["as_of_day", "cluster"])
    return out.withColumns(
        {
            "cl_last_seen_lag": (F.col("last_of_all") - F.col("last_day")).cast("bigint"),
            "cl_cards_per_device": _ratio("cl_distinct_cards", "cl_distinct_devices"),
            "cl_customers_per_address": _ratio("cl_customers", "cl_distinct_addresses"),
            "cl_payments_per_active_day": _ratio("cl_payments", "cl_active_days"),
            "cl_burstiness": _ratio("cl_active_days", "cl_day_span"),
            "cl_signup_synchrony": 1 / (1 + F.coalesce("cl_signup_std", F.lit(400.0))),
            "cl_first_seen_synchrony": 1 / (1 + F.coalesce("cl_first_seen_std", F.lit(60.0))),
            "cl_signup_span_per_customer": _ratio("cl_signup_span", "cl_customers"),
            "cl_issuers_per_customer": _ratio("cl_distinct_issuers", "cl_customers"),
        }
    ).drop("last_of_all", "last_day")


def unit(x: Column, lo: float, hi: float) -> Column:
    """``x`` scaled so that lo..hi becomes 0..1, clipped; null gives 0."""
    return F.coalesce(F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def signals() -> dict[str, tuple[float, Column]]:
    """Weight and definition of each risk signal."""
    c = F.col
    people = F.log1p("cl_customers")
    ln = math.log1p
    return {
        "cohesion": (0.17, unit(c("mean_edge_weight"), 0.05, 0.6) * unit(c("density"), 0.2, 1.0)),
        "scale": (0.07, unit(people, ln(3), ln(40))),
        "card_fanout": (0.15, unit(c("cl_cards_per_device"), 3, 60)),
        "decline": (0.13, unit(c("cl_failure_rate"), 0.25, 0.9)),
        "fresh": (0.09, unit(30 - c("cl_account_age_mean"), 5, 30)),
        "address_concentration": (0.10, unit(c("cl_customers_per_address"), 4, 30)),
        "burst": (0.06, unit(c("cl_payments_per_active_day"), 3, 40)),
        "cohort_synchrony": (0.14, unit(c("cl_signup_synchrony"), 0.002, 0.05) * unit(people, ln(4), ln(25))),
        "new_accounts": (0.09, unit(c("cl_new_account_share"), 0.25, 0.9)),
    }


def cluster_stats(cohesion: DataFrame, behaviour: DataFrame) -> DataFrame:
    """Cohesion and behaviour of each cluster with its signals and their weighted sum, the risk."""
    s = signals()
    out = cohesion.drop("total_weight").join(behaviour, ["as_of_day", "cluster"]).withColumns({f"clsig_{n}": x for n, (_, x) in s.items()})
    total = sum((F.col(f"clsig_{n}") * w for n, (w, _) in s.items()), F.lit(0.0))
    return out.withColumn("cl_ring_risk", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))
