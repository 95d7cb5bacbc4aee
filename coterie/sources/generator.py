"""A synthetic corpus: honest traffic with harmless sharing, and three kinds of rings.

Every value is a hash of the seed and the row's own number, so the corpus is
the same for any partitioning, needs no joins to draw customers, and grows
with ``scale`` by more rows, not by larger groups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """Parameters of the corpus."""

    seed: int = 20260905
    customers: int = 9_000
    payments: int = 25_000
    days: int = 150
    amount_mu: float = 7.1
    amount_sigma: float = 0.95
    micro_share: float = 0.085
    failure: float = 0.11
    refund: float = 0.045
    dispute: float = 0.0009
    legacy: float = 0.42
    alias: float = 0.09
    rings: int = 12
    scale: int = 1


#: Payment methods of honest traffic with their shares.
METHODS = (("instant", 0.52), ("card", 0.26), ("netbank", 0.10), ("wallet", 0.07), ("instalment", 0.03), ("paylater", 0.02))
#: Harmless sharing: column, tag, smallest and largest group, share of customers.
SHARING = (("card_fingerprint", "family_card", 2, 4, 0.048), ("ip", "nat_ip", 40, 400, 0.5), ("device_fingerprint", "kiosk_device", 5, 25, 0.06), ("shipping_address_hash", "building_addr", 6, 30, 0.23))
#: Kinds of rings: accounts, payments per ring, days, what is shared, failure, refund and dispute shares.
RINGS = {
    "card_testing": {"accounts": (1, 5), "payments": (30, 140), "span": (1, 3), "devices": (1, 3), "addresses": (1, 1), "failed": 0.86, "refunded": 0.0, "disputed": 0.05},
    "refund_abuse": {"accounts": (6, 26), "payments": (12, 50), "span": (5, 30), "devices": (1, 4), "addresses": (1, 3), "failed": 0.0, "refunded": 0.72, "disputed": 0.0},
    "bust_out": {"accounts": (8, 30), "payments": (10, 60), "span": (2, 12), "devices": (10**9, 10**9), "addresses": (1, 2), "failed": 0.0, "refunded": 0.0, "disputed": 0.55},
}


def unit(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / float(1 << 52)


def between(lo: int | Column, hi: int | Column, u: Column) -> Column:
    """A whole number from ``lo`` to ``hi``."""
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (lo, hi))
    return (lo + F.floor(u * (hi - lo + 1))).cast("bigint")


def normal(seed: int, name: str, row: Column) -> Column:
    """A standard normal number, by Box and Muller."""
    return F.sqrt(-2 * F.ln(1 - unit(seed, name + "a", row))) * F.cos(2 * math.pi * unit(seed, name + "b", row))


def token(prefix: str, seed: int, *parts: Column | str) -> Column:
    """An identifier of 14 characters."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("/", F.lit(seed), *cols), 256), 1, 14))


def choice(u: Column, options: tuple[tuple[str, float], ...]) -> Column:
    """One of the options by their shares."""
    out, top = F.lit(options[-1][0]), 1.0
    for name, share in reversed(options):
        out = F.when(u < top, name).otherwise(out)
        top -= share
    return out


def population(spark: SparkSession, shape: Shape = Shape()) -> DataFrame:
    """One row per honest account, with tags of the harmless groups it belongs to.

    Groups are stretches of a permutation of the customers; all members take
    the value of the group's number. Two groups that follow each other have
    sizes that add up to the least and the greatest of their kind, and the
    place of the cut between them is drawn, so all sizes of the range occur.
    """
    s, n = shape.seed, shape.customers * shape.scale
    i = F.col("id")
    legacy = unit(s, "legacy", i) < shape.legacy
    pop = spark.range(n).select(
        "id",
        token("cust_", s, "cust", i).alias("customer_id"),
        token("cfp_", s, "card", i).alias("card_fingerprint"),
        token("dev_", s, "dev", i).alias("device_fingerprint"),
        token("addr_", s, "addr", i).alias("shipping_address_hash"),
        token("+", s, "contact", i).alias("contact"),
        F.concat(token("", s, "mail", i), F.when(unit(s, "alias", i) < shape.alias, F.concat(F.lit("+"), between(1, 999, unit(s, "tag", i)))).otherwise(""), F.lit("@mailbox.example")).alias("email"),
        F.concat(token("", s, "mail", i), F.lit("@mailbox.example")).alias("email_root"),
        token("ip_", s, "ip", i).alias("ip"),
        F.when(legacy, between(-400, -60, unit(s, "signup", i))).otherwise(between(-60, shape.days - 1, unit(s, "signup", i))).cast("int").alias("signup_day"),
        F.concat(F.lit("city_"), between(0, 14, unit(s, "city", i))).alias("city"),
        # most accounts buy once or twice, a minority often
        (-F.ln(1 - unit(s, "active", i)) * F.when(unit(s, "loyal", i) < 0.1, 6.0).when(unit(s, "loyal", i) < 0.4, 1.5).otherwise(0.6)).alias("activity_weight"),
        F.lit("").alias("benign_cluster"),
    )
    for column, tag, lo, hi, share in SHARING:
        both = lo + hi
        # an affine map of the number is a permutation when the factor shares no divisor with n
        factor = next(f for f in range(7919 + lo, 10**6) if math.gcd(f, n) == 1)
        place = (i * factor + hi) % n
        inside = place < int(n * share) // both * both
        pair = F.floor(place / both)
        group = 2 * pair + (place % both >= between(lo, hi, unit(s, tag + "cut", pair))).cast("int")
        pop = pop.withColumn(column, F.when(inside, token(column.split("_")[0][:4] + "_", s, tag, group)).otherwise(F.col(column)))
        pop = pop.withColumn("benign_cluster", F.when(inside, F.concat_ws(";", F.nullif("benign_cluster", F.lit("")), F.concat(F.lit(f"{tag}_"), group))).otherwise(F.col("benign_cluster")))
    return pop


def honest(spark: SparkSession, shape: Shape = Shape()) -> DataFrame:
    """Honest payments: each account has as many as its activity says, on days after its sign-up."""
    s = shape.seed
    mean = shape.payments / shape.customers
    pop = population(spark, shape)
    expected = F.col("activity_weight") / 1.29 * mean
    count = F.floor(expected + unit(s, "count", F.col("id"))).cast("int")
    rows = pop.where(count > 0).withColumn("k", F.explode(F.sequence(F.lit(1), count))).withColumn("row", F.xxhash64("id", "k"))
    r = F.col("row")
    start = F.greatest("signup_day", F.lit(0))
    day = F.least(start + F.floor(unit(s, "day", r) * (shape.days - start)), F.lit(shape.days - 1)).cast("int")
    hour = F.when(unit(s, "hump", r) < 0.42, 13.5 + 1.9 * normal(s, "hour", r)).otherwise(21.0 + 2.1 * normal(s, "hour", r))
    second = F.least(F.greatest(F.floor(hour * 3600) + between(0, 3599, unit(s, "second", r)), F.lit(0)), F.lit(86399))
    amount = F.when(unit(s, "micro", r) < shape.micro_share, between(200, 4900, unit(s, "amount", r)).cast("double")).otherwise(F.least(F.greatest(F.round(F.exp(shape.amount_mu + shape.amount_sigma * normal(s, "amount", r))) * 100, F.lit(4900.0)), F.lit(9_000_000.0)))
    method = choice(unit(s, "method", r), METHODS)
    failed = unit(s, "failed", r) < shape.failure
    out = rows.select(
        "row", "customer_id", "contact", "email_root", "shipping_address_hash", "signup_day", "city", "benign_cluster", day.alias("day"), (day.cast("bigint") * 86400 + second).alias("created_at"), amount.alias("amount"), method.alias("method"),
        F.when(failed, "failed").otherwise("captured").alias("status"), F.lit(False).alias("is_fraud"), F.lit("").alias("ring_id"), F.lit("none").alias("ring_type"),
        F.when(method == "card", F.col("card_fingerprint")).alias("card_fingerprint"),
        F.when(unit(s, "new_dev", r) < 0.05, token("dev_", s, "drift", r)).otherwise(F.col("device_fingerprint")).alias("device_fingerprint"),
        F.when(unit(s, "new_ip", r) < 0.18, token("ip_", s, "drift", r)).otherwise(F.col("ip")).alias("ip"),
        (~failed & (unit(s, "refund", r) < shape.refund)).alias("refunded"), (~failed & (unit(s, "dispute", r) < shape.dispute)).alias("disputed"),
    )
    return out


def ring(spark: SparkSession, kind: str, shape: Shape = Shape()) -> DataFrame:
    """Payments of the rings of one kind: few devices or addresses for many accounts or cards within days."""
    s, spec = shape.seed, RINGS[kind]
    g = F.col("id")
    pick = lambda name: between(*spec[name], unit(s, kind + name, g))
    rings = spark.range(shape.rings * shape.scale).select("id", pick("accounts").alias("accounts"), pick("payments").alias("n"), pick("span").alias("span"), pick("devices").alias("devices"), pick("addresses").alias("addresses"))
    rings = rings.withColumn("start", between(0, F.lit(shape.days - 1) - F.col("span"), unit(s, kind + "start", g)))
    rows = rings.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).withColumn("row", F.xxhash64(F.lit(kind), "id", "k"))
    r = F.col("row")
    of = lambda name, count: F.floor(unit(s, kind + name, r) * F.col(count)).cast("bigint")
    account = of("acct", "accounts")
    day = (F.col("start") + F.floor(unit(s, kind + "day", r) * F.col("span"))).cast("int")
    failed = unit(s, kind + "fail", r) < spec["failed"]
    small = kind == "card_testing"
    amount = between(200, 900, unit(s, kind + "amt", r)).cast("double") if small else F.round(F.exp(shape.amount_mu + 0.8 * normal(s, kind + "amt", r))) * (190 if kind == "bust_out" else 115)
    method = F.lit("card") if kind != "refund_abuse" else choice(unit(s, kind + "method", r), METHODS)
    aged = unit(s, kind + "aged", g, account) < 0.38
    signup = F.col("start") - F.when(aged, between(60, 400, unit(s, kind + "age", g, account))).otherwise(between(0, 20, unit(s, kind + "age", g, account)))
    second = between(0, 86399, unit(s, kind + "sec", r)) if not small else between(36000, 43200, unit(s, kind + "sec", r))
    device = token("dev_", s, kind, "dev", g, of("dev", "devices")) if kind != "bust_out" else token("dev_", s, kind, "dev", r)
    return rows.select(
        "row", token("cust_", s, kind, g, account).alias("customer_id"), token("+", s, kind, "contact", g, account).alias("contact"),
        F.concat(token("", s, kind, "mail", g, F.floor(account / 6) if kind == "refund_abuse" else account), F.lit("@post.example")).alias("email_root"),
        token("addr_", s, kind, "addr", g, of("addr", "addresses")).alias("shipping_address_hash"), signup.cast("int").alias("signup_day"), F.concat(F.lit("city_"), g % 15).alias("city"), F.lit("").alias("benign_cluster"),
        day.alias("day"), (day.cast("bigint") * 86400 + second).alias("created_at"), amount.alias("amount"), method.alias("method"), F.when(failed, "failed").otherwise("captured").alias("status"),
        F.lit(True).alias("is_fraud"), F.concat(F.lit(f"ring_{kind}_"), g).alias("ring_id"), F.lit(kind).alias("ring_type"), F.when(method == "card", token("cfp_", s, kind, "card", r)).alias("card_fingerprint"),
        device.alias("device_fingerprint"), token("ip_", s, kind, "ip", r if kind == "bust_out" else g).alias("ip"),
        (~failed & (unit(s, kind + "ref", r) < spec["refunded"])).alias("refunded"), (~failed & (unit(s, kind + "dis", r) < spec["disputed"])).alias("disputed"),
    )


def generate(spark: SparkSession, shape: Shape = Shape()) -> DataFrame:
    """All payments with ids, outcome days and the day their label is known."""
    s = shape.seed
    rows = honest(spark, shape)
    for kind in RINGS:
        rows = rows.unionByName(ring(spark, kind, shape))
    r = F.col("row")
    refund = F.col("day") + between(2, 24, unit(s, "refund_lag", r)).cast("int")
    dispute = F.col("day") + between(20, 69, unit(s, "dispute_lag", r)).cast("int")
    known = F.when(F.col("disputed"), dispute).when(F.col("refunded"), refund).when(F.col("status") == "failed", F.col("day")).otherwise(F.col("day") + 45)
    return rows.select(
        token("pay_", s, "pay", r, F.col("created_at")).alias("payment_id"), *(c for c in rows.columns if c != "row"), F.when(F.col("refunded"), refund).otherwise(-1).alias("refund_day"), F.when(F.col("disputed"), dispute).otherwise(-1).alias("dispute_day"),
        known.cast("int").alias("label_available_day"), (known <= shape.days).alias("label_matured"),
    )
