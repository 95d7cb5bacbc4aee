"""The canonical payment: its columns, their neutral values, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.config import Maturity, Splits
from coterie.functions.clean import PREFIX, account_age, code, identifier
from coterie.runtime import exists
from coterie.sources.payments import read_table, valid_payments

REQUIRED = {"payment_id": "string", "customer_id": "string", "day": "int", "created_at": "bigint", "amount": "double", "is_fraud": "boolean"}
LINK_COLUMNS = ("card_fingerprint", "device_fingerprint", "shipping_address_hash", "contact", "email_root", "ip")
CATEGORICAL = ("method", "card_network", "card_type", "card_issuer", "city")
#: Type and neutral value of the columns that a source may lack.
NEUTRAL = {
    "status": ("string", "captured"), "method": ("string", "unknown"), "card_network": ("string", None), "card_type": ("string", None), "card_issuer": ("string", None), "city": ("string", None),
    "refunded": ("boolean", False), "disputed": ("boolean", False), "refund_day": ("int", -1), "dispute_day": ("int", -1),
    "ring_id": ("string", ""), "ring_type": ("string", "none"), "benign_cluster": ("string", ""),
}


def split_of(day: Column, splits: Splits = Splits()) -> Column:
    """train, val or test by inclusive day intervals, the later winning; 'unassigned' outside, also for a null day."""
    out = F.lit("unassigned")
    for name in ("train", "val", "test"):
        out = F.when(day.between(*getattr(splits, name)), name).otherwise(out)
    return out


def label_day(maturity: Maturity = Maturity()) -> Column:
    """The day on which a payment's outcome is known: dispute before refund before failure, else after the dispute window."""
    return (
        F.when(F.col("disputed") & (F.col("dispute_day") >= 0), F.col("dispute_day"))
        .when(F.col("refunded") & (F.col("refund_day") >= 0), F.col("refund_day"))
        .when(F.col("status") == "failed", F.col("day"))
        .otherwise(F.col("day") + maturity.dispute_window)
    )


def conform(df: DataFrame, splits: Splits = Splits()) -> DataFrame:
    """Complete a source to the contract.

    Missing required columns raise an error that names them. Missing link
    columns become null, other columns their neutral value. Columns that exist
    keep their nulls. Columns named ``src_*`` pass through; others are dropped.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"the source lacks the required columns {', '.join(missing)}")
    has = lambda c: c in df.columns
    out = [F.col(c).cast(t).alias(c) for c, t in REQUIRED.items()]
    out += [(F.col(c) if has(c) else F.lit(None)).cast("string").alias(c) for c in LINK_COLUMNS]
    out += [(F.col(c) if has(c) else F.lit(v)).cast(t).alias(c) for c, (t, v) in NEUTRAL.items()]
    signup = F.col("signup_day") if has("signup_day") else F.col("day")
    age = F.col("account_age_days") if has("account_age_days") else F.greatest(F.col("day") - signup, F.lit(0))
    out += [signup.cast("int").alias("signup_day"), age.cast("int").alias("account_age_days"), split_of(F.col("day"), splits).alias("split")]
    out.append((F.col("label_available_day") if has("label_available_day") else F.col("day")).cast("int").alias("label_available_day"))
    out.append((F.col("label_matured") if has("label_matured") else F.lit(True)).alias("label_matured"))
    return df.select(*out, *(c for c in df.columns if c.startswith("src_")))


#: Columns of a payment after cleaning, in contract order.
COLUMNS = (*REQUIRED, *LINK_COLUMNS, *NEUTRAL, "signup_day", "account_age_days", "label_available_day", "label_matured")


def canonical(base: str) -> str:
    """Where the command ``data`` writes conformed payments."""
    return f"{base}/payments"


def source_of(spark: SparkSession, base: str) -> tuple[str, int | None]:
    """The kind of source and the last day of the payments in a folder, as ``data`` noted them."""
    if not exists(spark, f"{base}/source"):
        return "payments", None
    kind, last = spark.read.text(f"{base}/source").head()[0].split()
    return kind, int(last)


def payments(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Valid, cleaned and conformed payments; give names to read only those columns.

    A folder with a table ``payments`` that the command ``data`` wrote holds
    them already, with columns ``src_*`` where its source has some. Else they
    are taken from the deliveries in ``payments.parquet``: placeholders of
    identifiers become null, status and method lower case, the account age is
    taken from the sign-up day.
    """
    if exists(spark, canonical(sf_dir)):
        rows = spark.read.parquet(canonical(sf_dir))
        return rows.select(*(c for c in (*COLUMNS, *(c for c in rows.columns if c.startswith("src_"))) if c == "payment_id" or not names or c in names))
    source = read_table(spark, sf_dir, "payments")
    special = {c: identifier(c) for c in PREFIX} | {c: code(c) for c in ("status", "method")} | {"account_age_days": account_age()}
    special |= {c: F.nullif(F.trim(c), F.lit("")) for c in ("contact", "email_root", "ip")}
    chosen = [c for c in COLUMNS if not names or c in names]
    rows = valid_payments(source, {c: special.get(c, F.col(c)) for c in chosen if c != "payment_id"})
    return rows.select("payment_id", *(c for c in chosen if c != "payment_id"))
