"""Attributes as known at event time: periodic snapshots plus change logs.

A change of an entity becomes visible to an event when both of its times have
come: ``x`` <= the event's day and ``y`` <= (or <) the event's second. Of the
visible changes the one with the greatest rank is the attribute.

Time is cut into epochs. For each epoch in which an entity has events, its
snapshot holds the best change that every event of the epoch can see; the
epoch's change log holds those that only some of them can see. Both are
written to the shared folder. Events, snapshots and logs meet partitioned by
(entity, epoch); each group is replayed once, in order of time.

A group of more than a bounded number of rows is cut into slices of equal size
along time. What a slice must know of those before it is, per feed and day,
the best change so far: a snapshot of its own, no longer than the days of its
changes. So an entity that holds a third of all rows is spread over as many
tasks as it has slices.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coterie.runtime import materialise

DAY = 86400
FOUND = "event_id string, feed string, ref_id string"


@dataclass(frozen=True)
class Feed:
    """Changes of entities: (entity, x, y, ref), where ``x`` is a day and ``y`` a second.

    ``strict`` feeds are visible only after ``y``. ``by_x`` ranks changes by
    (x, y, ref), else by (y, ref). Rows with a null entity, x, y or ref are
    never visible. ``x`` and ``y`` are integers.
    """

    name: str
    changes: DataFrame
    strict: bool
    by_x: bool


def _epoch_from(x: Column, y: Column, strict: bool, days: int) -> tuple[Column, Column]:
    """The first epochs in which a change is visible to every event by its x and by its y."""
    by_x = F.ceil(x / days).cast("int")
    by_y = (F.floor(y / (days * DAY)) + 1).cast("int") if strict else F.ceil(y / (days * DAY)).cast("int")
    return by_x, by_y


def _replay(feeds: list[tuple[str, bool]]):
    """Replay of rows sorted by entity, epoch, slice, y and order.

    ``feeds`` has the name and by_x of each. Per group and feed a front of
    changes is kept, sorted by x and rising in rank: a change that another
    beats both in x and in rank can never be an answer again.
    """
    schema = pa.schema([("event_id", pa.string()), ("feed", pa.string()), ("ref_id", pa.string())])

    def run(batches):
        group, fronts = None, []
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            cols = [batch.column(c).to_pylist() for c in ("entity", "epoch", "slice", "feed", "x", "y", "ref")]
            for entity, epoch, part, feed, x, y, ref in zip(*cols, strict=True):
                if (entity, epoch, part) != group:
                    group, fronts = (entity, epoch, part), [([], []) for _ in feeds]
                if feed >= 0:
                    xs, ranks = fronts[feed]
                    rank = (x, y, ref) if feeds[feed][1] else (y, ref)
                    at = bisect_right(xs, x)
                    if at and ranks[at - 1] >= rank:
                        continue
                    end = at
                    while end < len(xs) and ranks[end] <= rank:
                        end += 1
                    if at and xs[at - 1] == x:
                        at -= 1
                    xs[at:end], ranks[at:end] = [x], [rank]
                else:
                    for k, (xs, ranks) in enumerate(fronts):
                        at = bisect_right(xs, x)
                        if at:
                            out[0].append(ref)
                            out[1].append(feeds[k][0])
                            out[2].append(ranks[at - 1][-1])
            if out[0]:
                yield pa.record_batch([pa.array(c, pa.string()) for c in out], schema=schema)

    return run


def _best(feeds: list[Feed]) -> Column:
    """The greatest change by the order of its feed, as a struct with x, y, ref."""
    by_x = F.col("feed").isin([k for k, f in enumerate(feeds) if f.by_x])
    order = F.struct(F.when(by_x, F.col("x")).otherwise(0), "y", "ref")
    return F.max_by(F.struct("x", "y", "ref"), order)


def _slices(rows: DataFrame, feeds: list[Feed]) -> DataFrame:
    """``rows`` of large groups cut along time into slices, each with the best changes of those before it.

    The rows are ranged by group and time and written, so a slice is what a
    group has in one partition. Changes are first reduced to the best one per
    slice and day; only these go to the later slices of the group.
    """
    group = ("entity", "epoch")
    cut, _ = materialise(rows.drop("slice").repartitionByRange(*group, "at", "ord").withColumn("slice", F.spark_partition_id() + 1), "slices")
    slices = cut.select(*group, "slice").distinct()
    # per group, feed and day the best change of each slice, then of all slices before
    best = cut.where("feed >= 0").groupBy(*group, "feed", "x", "slice").agg(_best(feeds).alias("best"))
    later = best.select(*group, "feed", "x", F.col("slice").alias("made"), "best").join(slices, [*group]).where("made < slice")
    carried = later.select(*group, "slice", "feed", F.col("best.x").alias("x"), F.col("best.y").alias("y"), F.col("best.ref").alias("ref"))
    carried = carried.groupBy(*group, "slice", "feed", F.col("x").alias("day")).agg(_best(feeds).alias("best"))
    start = carried.select(*group, "slice", "feed", F.col("best.x").alias("x"), F.col("best.y").alias("y"), F.lit(-2).alias("ord"), F.col("best.ref").alias("ref"), F.lit(-(2**62)).alias("at"))
    return cut.unionByName(start)


def attributes_as_known(events: DataFrame, feeds: list[Feed], epoch_days: int = 15, group_rows: int = 200_000) -> DataFrame:
    """(event_id, feed, ref_id): of each event and feed the attribute known then.

    ``events`` has event_id, entity, x (day) and y (second); it is read
    several times, so give a written table. Events that see no change of a
    feed have no row for it; events without entity, day or second see nothing.
    Groups of more than ``group_rows`` rows are replayed in slices.
    """
    span = epoch_days * DAY
    ev = events.where("event_id is not null and entity is not null and x is not null and y is not null").select(
        "event_id", "entity", F.col("x").cast("int").alias("x"), F.col("y").cast("bigint").alias("y")
    )
    ex, ey = F.floor(F.col("x") / epoch_days).cast("int"), F.floor(F.col("y") / span).cast("int")
    ev = ev.withColumn("epoch", F.least(ex, ey)).withColumn("wide", ex != ey)
    wanted, _ = materialise(ev.groupBy("entity", "epoch").agg(F.count(F.lit(1)).alias("rows")), "asked")
    straddling = ev.where("wide").select("entity", "epoch").distinct()

    parts = []
    for k, feed in enumerate(feeds):
        ch = feed.changes.where("entity is not null and x is not null and y is not null and ref is not null").select(
            "entity", F.col("x").cast("int").alias("x"), F.col("y").cast("bigint").alias("y"), "ref"
        )
        vx, vy = _epoch_from(F.col("x"), F.col("y"), feed.strict, epoch_days)
        ch = ch.withColumn("vx", vx).withColumn("vy", vy).withColumn("seen_by_all", F.greatest("vx", "vy"))
        rank = F.struct("x", "y", "ref") if feed.by_x else F.struct("y", "ref", "x")
        # the best change of each epoch, then the best so far: at most two rows per entity and epoch
        best = ch.groupBy("entity", F.col("seen_by_all").alias("epoch")).agg(F.max(rank).alias("best"))
        steps = best.withColumn("asked", F.lit(False)).unionByName(wanted.select("entity", "epoch", F.lit(None).cast(best.schema["best"].dataType).alias("best"), F.lit(True).alias("asked")))
        so_far = Window.partitionBy("entity").orderBy("epoch").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        base = steps.withColumn("best", F.max("best").over(so_far)).where("asked and best is not null")
        parts.append(base.select("entity", "epoch", F.lit(k).alias("feed"), F.col("best.x").alias("x"), F.col("best.y").alias("y"), F.lit(0).alias("ord"), F.col("best.ref").alias("ref"), F.lit(True).alias("snapshot")))
        log = ch.withColumn("epoch", F.col("seen_by_all") - 1)
        # events whose day and second lie in different epochs can see changes of later logs
        lag = ch.where(F.least("vx", "vy") < F.col("seen_by_all")).withColumn("epoch", F.explode(F.sequence(F.least("vx", "vy") - 1, F.col("seen_by_all") - 2)))
        log = log.unionByName(lag.join(straddling, ["entity", "epoch"], "left_semi").select(log.columns))
        parts.append(log.select("entity", "epoch", F.lit(k).alias("feed"), "x", "y", F.lit(2 if feed.strict else 0).alias("ord"), "ref", F.lit(False).alias("snapshot")))
    known, _ = materialise(reduce(DataFrame.unionByName, parts), "as-known")
    # the snapshot comes first in its group, whatever its time
    changes = known.select("entity", "epoch", "feed", "x", "y", F.when(F.col("snapshot"), -1).otherwise(F.col("ord")).alias("ord"), "ref", F.when(F.col("snapshot"), F.lit(-(2**62))).otherwise(F.col("y")).alias("at"))
    asked = ev.select("entity", "epoch", F.lit(-1).alias("feed"), "x", "y", F.lit(1).alias("ord"), F.col("event_id").alias("ref"), F.col("y").alias("at"))
    rows = asked.unionByName(changes).withColumn("slice", F.lit(0))
    large = known.groupBy("entity", "epoch").agg(F.count(F.lit(1)).alias("rows")).unionByName(wanted).groupBy("entity", "epoch").agg(F.sum("rows").alias("rows"))
    large, _ = materialise(large.where(F.col("rows") > group_rows).select("entity", "epoch"), "large")
    if large.limit(1).count():
        # at most one group per ``group_rows`` rows: Spark broadcasts them if they are few
        rows = rows.join(large, ["entity", "epoch"], "left_anti").unionByName(_slices(rows.join(large, ["entity", "epoch"], "left_semi"), feeds))
    rows = rows.repartition("entity", "epoch", "slice").sortWithinPartitions("entity", "epoch", "slice", "at", "ord")
    return rows.select("entity", "epoch", "slice", "feed", "x", "y", "ref").mapInArrow(_replay([(f.name, f.by_x) for f in feeds]), FOUND)
