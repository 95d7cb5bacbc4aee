"""Sources that fill the canonical payment, chosen by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.sources import contract, generator
from coterie.sources.files import csv_variant, read_csv
from coterie.sources.payments import read_table

#: Columns of the public card transactions and identities, with their types.
TRANSACTION = {"TransactionID": "bigint", "isFraud": "int", "TransactionDT": "bigint", "TransactionAmt": "double", "ProductCD": "string", "card1": "double", "card2": "double", "card3": "double", "card4": "string", "card5": "double", "card6": "string", "addr1": "double", "addr2": "double", "dist1": "double", "P_emaildomain": "string", "R_emaildomain": "string", "C1": "double", "C2": "double", "C5": "double", "C13": "double", "C14": "double", "D1": "double", "D2": "double", "D10": "double", "D15": "double"}
IDENTITY = {"TransactionID": "bigint", "DeviceType": "string", "DeviceInfo": "string", "id_30": "string", "id_31": "string", "id_33": "string"}
PASSED_ON = ("C1", "C2", "C5", "C13", "C14", "D2", "D10", "D15", "dist1")


def key(col: str) -> Column:
    """A whole number as text; 'na' where it is missing."""
    return F.coalesce(F.when(~F.isnan(col), F.col(col)).cast("bigint").cast("string"), F.lit("na"))


def client_id(day: Column) -> Column:
    """The client as card, region and day first seen; a row without a card is a client of its own."""
    seen = F.coalesce((day - F.when(~F.isnan("D1"), F.col("D1"))).cast("bigint").cast("string"), F.lit("na"))
    no_card = F.col("card1").isNull() | F.isnan("card1")
    return F.when(no_card, F.concat(F.lit("uid_solo_"), F.col("TransactionID"))).otherwise(F.concat_ws("_", F.lit("uid"), key("card1"), key("addr1"), seen))


def device(columns: list[str]) -> Column:
    """The device's parts joined by bars, without bars at the ends; null where all are missing."""
    if not columns:
        return F.lit(None).cast("string")
    joined = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    return F.nullif(F.regexp_replace(joined, r"^\|+|\|+$", ""), F.lit(""))


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def card_payments(spark: SparkSession, base: str) -> DataFrame:
    """The public card transactions in ``base``, with their identities where there are some.

    Both sides are keyed by the transaction, so the join has no hot key. The
    first day is one row, broadcast.
    """
    path = csv_variant(spark, base, "train_transaction")
    if path is None:
        raise FileNotFoundError(f"no transactions under {base}; expected train_transaction.csv or a variant of it")
    tx = read_csv(spark, path, TRANSACTION)
    passed = [c for c in PASSED_ON if c in tx.columns]
    cards = [c for c in ("card1", "card2", "card3", "card5") if c in tx.columns]
    tx = with_missing(tx, TRANSACTION)
    parts: list[str] = []
    if identities := csv_variant(spark, base, "train_identity"):
        ident = read_csv(spark, identities, IDENTITY)
        parts = [c for c in ("DeviceInfo", "id_30", "id_31", "id_33") if c in ident.columns]
        tx = tx.join(ident.select("TransactionID", *parts), "TransactionID", "left")
    at = F.floor(F.col("TransactionDT") / 86400)
    first = tx.agg(F.min(at).alias("first_day"))
    tx = tx.crossJoin(F.broadcast(first)).withColumn("day", (at - F.col("first_day")).cast("int"))  # one row
    age = F.coalesce(F.greatest(F.when(~F.isnan("D1"), F.col("D1")), F.lit(0.0)), F.lit(0.0)).cast("int")
    has = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    out = tx.select(
        F.concat(F.lit("pay_"), F.col("TransactionID")).alias("payment_id"),
        client_id(F.col("day")).alias("customer_id"),
        "day",
        F.col("TransactionDT").alias("created_at"),
        F.round(F.col("TransactionAmt") * 100).alias("amount"),
        (F.col("isFraud") == 1).alias("is_fraud"),
        F.when(has("card1"), F.concat_ws("_", F.lit("card"), *map(key, cards))).alias("card_fingerprint"),
        device(parts).alias("device_fingerprint"),
        F.when(has("addr1"), F.concat_ws("_", F.lit("addr"), key("addr1"), key("addr2"))).alias("shipping_address_hash"),
        F.col("P_emaildomain").alias("email_root"),
        F.coalesce("ProductCD", F.lit("unknown")).alias("method"),
        F.col("card4").alias("card_network"),
        F.col("card6").alias("card_type"),
        key("card5").alias("card_issuer"),
        key("addr1").alias("city"),
        F.lit("captured").alias("status"),
        age.alias("account_age_days"),
        (F.col("day") - age).alias("signup_day"),
        *(F.col(c).alias(f"src_{c}") for c in passed),
    )
    return contract.conform(out)


def orders(spark: SparkSession, base: str) -> DataFrame:
    """Orders as payments; identifiers are the parts and suppliers of their lines. Labels are invented."""
    lines = read_table(spark, base, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_partkey").alias("card"), F.max("l_partkey").alias("dev"), F.min("l_suppkey").alias("addr"), F.max((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).alias("fraud")
    )
    nations = read_table(spark, base, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01"))
    rows = read_table(spark, base, "orders").join(lines, "o_orderkey", "left").join(nations, "o_custkey", "left").withColumn("day", day)
    first = rows.groupBy("o_custkey").agg((F.min("day") - F.max("o_custkey") % 400).cast("int").alias("signup_day"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c))
    fraud = F.coalesce("fraud", F.lit(False))
    out = rows.join(first, "o_custkey").select(
        text("pay_", "o_orderkey").alias("payment_id"), text("cust_", "o_custkey").alias("customer_id"), "day", (F.col("day").cast("bigint") * 86400 + (F.col("o_orderkey") * 7919) % 86400).alias("created_at"),
        F.round(F.col("o_totalprice") * 100).alias("amount"), fraud.alias("is_fraud"), text("card_", "card").alias("card_fingerprint"), text("dev_", "dev").alias("device_fingerprint"), text("addr_", "addr").alias("shipping_address_hash"),
        text("ip_", "c_nationkey").alias("ip"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("captured").alias("status"), F.col("o_orderpriority").alias("method"), "signup_day",
        F.when(fraud, F.element_at(F.array(F.lit("card_testing"), F.lit("refund_abuse"), F.lit("bust_out")), (F.col("o_orderkey") % 3 + 1).cast("int"))).otherwise("none").alias("ring_type"),
        F.when(F.col("c_nationkey") < 5, text("seg_", "c_nationkey")).otherwise("").alias("benign_cluster"),
    )
    return contract.conform(out)


def events(spark: SparkSession, base: str) -> DataFrame:
    """Events as payments; the device is the key in their properties. Labels are invented."""
    e = read_table(spark, base, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = e.withColumn("created_at", at).withColumn("day", F.floor(F.col("created_at") / 86400).cast("int"))
    first = rows.groupBy("user_id").agg((F.min("day") - F.max("user_id") % 400).cast("int").alias("signup_day"))
    out = rows.join(first, "user_id").select(
        F.concat(F.lit("evt_"), F.col("event_id")).alias("payment_id"), F.concat(F.lit("cust_"), F.col("user_id")).alias("customer_id"), "day", "created_at", F.round(F.col("value") * 100).alias("amount"), (F.col("value") >= 150).alias("is_fraud"),
        F.concat(F.lit("dev_"), F.get_json_object("props", "$.k")).alias("device_fingerprint"), F.when(F.col("event_type") == "error", "failed").otherwise("captured").alias("status"), F.col("event_type").alias("method"), "signup_day",
    )
    return contract.conform(out)


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "payments": lambda spark, base: contract.payments(spark, base),
    "cards": card_payments,
    "orders": orders,
    "events": events,
    "generated": lambda spark, base: contract.conform(generator.generate(spark)),
}


def load(spark: SparkSession, kind: str, base: str = "") -> DataFrame:
    """Payments of a source; an unknown name raises an error that lists the known ones."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind!r}; known are {', '.join(sorted(SOURCES))}")
    return SOURCES[kind](spark, base)


def write(spark: SparkSession, kind: str, base: str, out: str) -> int:
    """Write the payments of a source to ``out``; returns their last day, 0 where there are none."""
    from coterie.config import PROFILES, Profile
    from coterie.sources.files import write_named

    rows = load(spark, kind, base)
    rows = rows.withColumn("split", contract.split_of(F.col("day"), PROFILES.get(kind, Profile()).splits))
    path = write_named(rows, out, "payments")
    return spark.read.parquet(path).agg(F.max("day")).head()[0] or 0
