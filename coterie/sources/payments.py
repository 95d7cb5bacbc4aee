"""The payments table: valid deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, by: str, columns: dict[str, Column]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``by``.

    ``columns`` name the expressions to keep; they are computed before the
    shuffle, so only they travel, and each partition sends one row per key.
    Rows without a key are no delivery of anything and are left out. A null
    ``by`` ranks below every value; ties go to the greatest row, so the result
    never depends on the order of the input.
    """
    packed = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.struct(F.col(by).alias("by"), *(c.alias(n) for n, c in columns.items())).alias("row")
    )
    best = packed.groupBy("key").agg(F.max("row").alias("row"))
    return best.select(F.col("key").alias(key), *(F.col("row")[n].alias(n) for n in columns))


def valid_payments(payments: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The valid delivery of each payment: the one received last."""
    return latest(payments, "payment_id", "src_received_at", columns)
