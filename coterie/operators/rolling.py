"""Totals over trailing periods for every entity and day, by contribution deltas.

An entity's daily amount adds to a trailing total on its day and is taken off
again after the length of the window. The running sum of these deltas is the
total; it changes only on days with a delta, so an entity's days form segments
of equal totals, which are expanded to days last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trailing_segments(rows: DataFrame, first_day: int, last_day: int, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Segments (field, entity, day_from, day_to, n_W, total_W for each window).

    ``rows`` has field, entity, day, amount. Rows without entity or day count
    nowhere; null and NaN amounts count as 0. Days after ``last_day`` are
    ignored, days before ``first_day`` count where a window reaches them. The
    segments of an entity cover each day from ``first_day`` to ``last_day``
    from its first activity on (before it, all totals are 0). Totals are
    exact for amounts that are whole numbers, as in minor units.

    The first aggregation combines before the shuffle and is keyed by day, so
    a busy entity is spread over its days; after it an entity has a row per
    active day at most, and the running sum sorts no more than that times
    the deltas of a day.
    """
    widest = max(windows)
    daily = (
        rows.where("entity is not null and day is not null")
        .where(F.col("day").between(first_day - widest + 1, last_day))
        .groupBy("field", "entity", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(~F.isnan("amount"), F.col("amount"))), F.lit(0.0)).alias("amount"))
        .repartition("field", "entity")
    )
    zero_n, zero = F.lit(0).cast("bigint"), F.lit(0.0)

    def delta(shift: int) -> F.Column:
        """Of the row's day plus ``shift``: what is added and taken off there."""
        parts = [(F.col("day") + shift).alias("day")]
        for w in windows:
            sign = 1 if shift == 0 else -1 if shift == w else 0
            parts += [(F.col("n") * sign if sign else zero_n).alias(f"n_{w}"), (F.col("amount") * sign if sign else zero).alias(f"total_{w}")]
        return F.struct(*parts)

    measures = [f"{kind}_{w}" for w in windows for kind in ("n", "total")]
    deltas = (
        daily.select("field", "entity", F.inline(F.array(*(delta(s) for s in (0, *sorted(set(windows)))))))
        .where(F.col("day") <= last_day)
        .withColumn("day", F.greatest("day", F.lit(first_day)))
        .groupBy("field", "entity", "day")
        .agg(*(F.sum(m).alias(m) for m in measures))
    )
    so_far = Window.partitionBy("field", "entity").orderBy("day")
    running = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select(
        "field",
        "entity",
        F.col("day").alias("day_from"),
        (F.lead("day").over(so_far) - 1).alias("day_to"),
        *(F.sum(m).over(running).alias(m) for m in measures),
    ).withColumn("day_to", F.coalesce("day_to", F.lit(last_day)))


def each_day(segments: DataFrame) -> DataFrame:
    """A row per entity and day of the segments."""
    return segments.withColumn("day", F.explode(F.sequence("day_from", "day_to"))).drop("day_from", "day_to")


def trailing_averages(days: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Adds avg_W, the total per day of the window."""
    return days.withColumns({f"avg_{w}": F.col(f"total_{w}") / w for w in windows})
