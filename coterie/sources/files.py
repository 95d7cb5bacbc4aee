"""Reading and writing tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coterie.runtime import exists

#: File names of a CSV source, in the order in which they are looked for.
VARIANTS = ("{stem}.csv", "{stem}_slim.csv", "{stem}.csv.gz", "{stem}_slim.csv.gz", "{stem}.csv/{stem}.csv")


def read_named(spark: SparkSession, base: str, name: str, make: str = "data") -> DataFrame:
    """A table written by ``write_named``; the error names the step that makes it."""
    path = f"{base}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is not there; run the step '{make}' first")
    return spark.read.parquet(path)


def write_named(df: DataFrame, base: str, name: str, by: str | None = "day", kind: str = "parquet") -> str:
    """Write a table as Parquet, or as gzipped CSV with a header, partitioned by ``by`` where it has that column.

    Rows are clustered by the partition column first, so each folder gets few
    files; AQE splits a partition that is too large for one.
    """
    path = f"{base}/{name}"
    split = bool(by and by in df.columns)
    out = (df.hint("rebalance", by) if split else df).write.mode("overwrite")
    out = out.partitionBy(by) if split else out
    out.parquet(path) if kind == "parquet" else out.option("header", True).option("compression", "gzip").csv(path)
    return path


def write_source(spark: SparkSession, base: str, kind: str, last_day: int) -> None:
    """Note the kind of source and the last day of the payments in a folder."""
    spark.createDataFrame([(f"{kind} {last_day}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/source")


def write_bundle(tables: dict[str, DataFrame], base: str, name: str) -> str:
    """Small result tables as one script that sets ``window.VIEWS`` to an object with a list of rows for each.

    The tables are views of bounded length; their rows are put together by one
    task.
    """
    from functools import reduce

    from pyspark.sql import functions as F

    rows = lambda n, df: df.select(F.to_json(F.struct("*")).alias("row")).agg(F.concat(F.lit(f'"{n}": ['), F.array_join(F.collect_list("row"), ", "), F.lit("]")).alias("value"))
    every = reduce(DataFrame.unionByName, (rows(n, df) for n, df in tables.items()))
    text = every.agg(F.concat(F.lit("window.VIEWS = {"), F.array_join(F.array_sort(F.collect_list("value")), ", "), F.lit("};")).alias("value"))
    path = f"{base}/{name}"
    text.coalesce(1).write.mode("overwrite").text(path)
    return path


def write_report(df: DataFrame, base: str, name: str, kind: str = "csv") -> str:
    """A small result table as one CSV or JSON file in a folder of its own."""
    path = f"{base}/{name}"
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)
    return path


def write_markdown(df: DataFrame, base: str, name: str) -> str:
    """A small result table as a Markdown table, one line of text per row."""
    from pyspark.sql import functions as F

    spark = df.sparkSession
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    head = spark.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + " - |" * len(df.columns),)], "value string")
    path = f"{base}/{name}"
    head.coalesce(1).unionByName(df.select(cells.alias("value"))).coalesce(1).write.mode("overwrite").text(path)
    return path


def csv_variant(spark: SparkSession, base: str, stem: str) -> str | None:
    """The first file variant of a CSV source that is there."""
    return next((p for v in VARIANTS if exists(spark, p := f"{base}/{v.format(stem=stem)}")), None)


def read_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The wanted columns that the header has, with their types; values that do not parse are null."""
    from pyspark.sql import functions as F

    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.expr(f"try_cast(`{c}` as {t})").alias(c) for c, t in columns.items() if c in raw.columns))
