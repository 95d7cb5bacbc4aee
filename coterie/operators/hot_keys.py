"""Per-key results when a few keys hold most records: exact offset chunking.

Rows are ranged by time into input partitions of equal size, whatever their
keys. Each partition numbers and counts the rows of each key that it holds and
reduces them to one ordered state. Prefix sums of the counts over the
partitions give each (partition, key) the number of its first row in the key.
A key with more rows than a chunk is then cut at multiples of the chunk size
by the numbers of its rows, so all chunks but a key's last are equal. The
ordered states of a key's chunks are merged across their boundaries.

A task holds rows of one input partition at most, so no key, however large,
makes a task larger than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coterie.runtime import materialise

KEY = ("field", "key_value")


def input_partitions(rows: DataFrame) -> DataFrame:
    """``rows`` ranged by (at, tie) and written, each with the number ``part`` of its partition.

    Null times count as 0. Partitions rise in time; rows of one time are
    spread by ``tie``.
    """
    timed = rows.withColumn("at", F.coalesce(F.col("at").cast("bigint"), F.lit(0)))
    return materialise(timed.repartitionByRange("at", "tie").withColumn("part", F.spark_partition_id()), "timed")[0]


def _offsets(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """(part, field, key_value, offset): of the keys with more rows than a chunk the rows before each partition.

    There are at most as many such keys as there are chunks. Only their rows
    are counted per partition.
    """
    large = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_rows).select(*(F.col(c).alias(f"_{c}") for c in KEY))
    same = F.col("field").eqNullSafe(F.col("_field")) & F.col("key_value").eqNullSafe(F.col("_key_value"))
    counted = rows.join(large, same, "left_semi").groupBy("part", *KEY).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("part", *KEY, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def key_pieces(rows: DataFrame, chunk_rows: int = 50_000, ranged: bool = False) -> DataFrame:
    """One state per chunk of a key and input partition, with the number of its first row in the key.

    ``rows`` has field, key_value, at, tie, amount, and where it is ``ranged``
    the part from ``input_partitions``; other columns are ignored. A null key
    is a key like any other (callers that want none filter the result); null
    times count as 0 and null or NaN amounts as 0, ties in ``at`` are ordered
    by ``tie``. ``max_gap`` is the longest time between two consecutive rows
    of the piece, or between its first and the row before it in the partition.
    """
    if not ranged:
        rows = input_partitions(rows.select(*KEY, "at", "tie", "amount"))
    field = F.col("field").cast("tinyint").alias("field")
    clean = rows.select("part", field, "key_value", "at", "tie", F.coalesce(F.when(~F.isnan("amount"), F.col("amount").cast("double")), F.lit(0.0)).alias("amount"))
    # the offset of a key in a partition travels as a row at the head of its rows: no join, one shuffle
    none = lambda t: F.lit(None).cast(t)
    heads = _offsets(clean, chunk_rows).select("part", *KEY, none("bigint").alias("at"), none(clean.schema["tie"].dataType).alias("tie"), F.lit(0.0).alias("amount"), "offset")
    every = clean.withColumn("offset", none("bigint")).unionByName(heads)
    local = Window.partitionBy("part", *KEY).orderBy(F.col("offset").isNull(), "at", "tie")
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    numbered = every.select("part", *KEY, "at", "amount", F.col("offset").isNotNull().alias("head"), F.max("offset").over(upto).alias("offset"), F.row_number().over(local).alias("place"), (F.col("at") - F.lag("at").over(local)).alias("gap"))
    # the head took the first place; rows of other keys are all of one chunk
    row = F.col("offset") + F.col("place") - 2
    cut = numbered.where(~F.col("head")).withColumn("chunk", F.coalesce(F.floor(row / chunk_rows), F.lit(0)))
    pieces = cut.groupBy("part", *KEY, "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("gap").alias("max_gap")
    )
    before = Window.partitionBy(*KEY).orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("first_row", F.coalesce(F.sum("n").over(before), F.lit(0)))


def per_key(rows: DataFrame, chunk_rows: int = 50_000, ranged: bool = False) -> DataFrame:
    """(field, key_value, n, total, first_at, last_at, max_gap, chunks) for every key.

    ``max_gap`` is the longest time between two consecutive rows of the key,
    null for a single row. It shows the ordered merge: the gap across two
    pieces comes from the last row of one and the first row of the next.
    """
    pieces = key_pieces(rows, chunk_rows, ranged)
    order = Window.partitionBy(*KEY).orderBy("part", "chunk")
    across = F.col("first_at") - F.lag("last_at").over(order)
    return (
        pieces.withColumn("gap", F.greatest("max_gap", across))
        .groupBy(*KEY)
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            F.max("gap").alias("max_gap"),
            (F.max("chunk") + 1).alias("chunks"),
        )
    )
