"""Per-period totals by event time, corrected as late records arrive.

Events carry the day they happened and the day they became known. They are
first aggregated to cells of (key, period, known day), whose number is bounded
by time and not by the number of events, so a key that holds a third of all
events is no larger than any other. Each key's cells are then played in the
order they became known: totals are kept in period order with a snapshot every
few periods, and a late cell restores the snapshot before its period, replays
the periods after it and replaces their outputs.

The verdict on a cell is what the ledger did with it. As time goes on, the
ledger issues the outputs of periods that have ended and releases snapshots
that lie beyond the cut-off: a cell of a period that is not issued yet is on
time, one of an issued period corrects it, and one whose period has been
released finds nothing to restore and comes too late.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ON_TIME, CORRECTS, TOO_LATE = "on_time", "corrects", "too_late"

CELLS = "key string, period int, known int, n bigint, total double, verdict string"
PERIODS = "key string, period int, n bigint, total double, running_n bigint, running_total double, corrections bigint, late_n bigint, too_late_n bigint"


class ReplayLedger:
    """Totals per period of one key, in period order, with snapshots.

    ``outputs`` maps a period to [count, total, running count, running total,
    times corrected]. ``snapshots`` maps a block of ``every`` periods to the
    running count and total before it.
    """

    def __init__(self, period_days: int = 7, lateness: int = 28, every: int = 4, disorder: int = 90):
        self.period_days, self.lateness, self.every, self.disorder = period_days, lateness, every, disorder
        self.order: list[int] = []
        self.outputs: dict[int, list] = {}
        self.snapshots: dict[int, tuple] = {}
        self.too_late: dict[int, int] = {}
        self.late: dict[int, int] = {}
        self.replayed = 0
        self.clock: int | None = None  # the latest day heard of
        self.issued = self.released = 0  # the last period whose output is out, and whose snapshot is gone
        self.first_block: int | None = None  # the earliest block that can still be restored

    def _last_ended(self, day: int) -> int:
        """The last period that ended before ``day``."""
        return (day - self.period_days) // self.period_days

    def advance(self, known: int) -> None:
        """Move to the day ``known``: issue what has ended, release what is beyond the cut-off.

        A stream may bring days in disorder; snapshots therefore stay
        ``disorder`` days longer. One before them stays as the base.
        """
        self.clock = known if self.clock is None else max(self.clock, known)
        self.issued, self.released = self._last_ended(known), self._last_ended(known - self.lateness)
        needed = (self._last_ended(self.clock - self.lateness - self.disorder) + 1) // self.every
        old = sorted(b for b in self.snapshots if b <= needed)
        for b in old[:-1]:
            del self.snapshots[b]
            self.first_block = old[-1]

    def verdict(self, period: int) -> str:
        """What becomes of a cell of this period now."""
        if period > self.issued:
            return ON_TIME
        lost = self.first_block is not None and period // self.every < self.first_block
        return TOO_LATE if period <= self.released or lost else CORRECTS

    def ingest(self, cells: list[tuple[int, int, int, float]]) -> list[str]:
        """Take cells (period, known day, count, total) that became known together; returns their verdicts."""
        if cells:
            self.advance(cells[0][1])
        verdicts, earliest, corrected = [], None, set()
        for period, _, n, total in cells:
            v = self.verdict(period)
            verdicts.append(v)
            if v == TOO_LATE:
                self.too_late[period] = self.too_late.get(period, 0) + n
                continue
            if period not in self.outputs:
                insort(self.order, period)
                self.outputs[period] = [0, 0.0, 0, 0.0, 0]
            out = self.outputs[period]
            out[0] += n
            out[1] += total
            if v == CORRECTS:
                self.late[period] = self.late.get(period, 0) + n
                corrected.add(period)
            earliest = period if earliest is None else min(earliest, period)
        for period in corrected:
            self.outputs[period][4] += 1
        if earliest is not None:
            self._replay(earliest)
        return verdicts

    def _replay(self, earliest: int) -> None:
        """Restore the snapshot before ``earliest`` and replay the suffix from there."""
        block = earliest // self.every
        while block not in self.snapshots and self.snapshots and block > min(self.snapshots):
            block -= 1
        n, total = self.snapshots.get(block, (0, 0.0))
        at = bisect_left(self.order, block * self.every) if block in self.snapshots else 0
        for period in self.order[at:]:
            b = period // self.every
            if b > block or b not in self.snapshots:
                # the first period of its block: what lies before it is the block's snapshot
                if b != block or b not in self.snapshots:
                    self.snapshots[b] = (n, total)
                block = b
            out = self.outputs[period]
            n, total = n + out[0], total + out[1]
            out[2], out[3] = n, total
            self.replayed += 1


def _play(pdf: pd.DataFrame, period_days: int, lateness: int, every: int) -> tuple[ReplayLedger, pd.DataFrame]:
    ledger = ReplayLedger(period_days, lateness, every)
    pdf = pdf.sort_values(["known", "period"], kind="stable")
    verdicts: list[str] = []
    for known, batch in pdf.groupby("known", sort=True):
        verdicts += ledger.ingest(list(zip(batch["period"].tolist(), [known] * len(batch), batch["n"].tolist(), batch["total"].tolist(), strict=True)))
    return ledger, pdf.assign(verdict=verdicts)


def cells_of(events: DataFrame, period_days: int = 7) -> DataFrame:
    """(key, period, known, n, total) from events (key, event_day, known_day, amount).

    Events without key, event day or known day belong to no cell: what is not
    known on some day cannot have arrived. Null and NaN amounts count as 0.
    """
    return (
        events.where("key is not null and event_day is not null and known_day is not null")
        .groupBy("key", F.floor(F.col("event_day") / period_days).cast("int").alias("period"), F.col("known_day").cast("int").alias("known"))
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(~F.isnan("amount"), F.col("amount"))), F.lit(0.0)).alias("total"))
    )


def judged_cells(cells: DataFrame, period_days: int = 7, lateness: int = 28, every: int = 4) -> DataFrame:
    """The cells with the verdict their key's ledger gave them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _play(pdf, period_days, lateness, every)[1][["key", "period", "known", "n", "total", "verdict"]]

    return cells.groupBy("key").applyInPandas(run, CELLS)


def period_totals(cells: DataFrame, period_days: int = 7, lateness: int = 28, every: int = 4) -> DataFrame:
    """Corrected totals per key and period after everything arrived.

    ``n`` and ``total`` hold what arrived in time, ``running_*`` add up the
    periods so far, ``corrections`` counts how often a closed period was
    replaced, ``late_n`` the events that did so and ``too_late_n`` those beyond
    the cut-off, which change nothing. A period that only got too late events
    has a row of zeros, with the running values of the period before.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ledger, _ = _play(pdf, period_days, lateness, every)
        rows, n, total = [], 0, 0.0
        for period in sorted({*ledger.order, *ledger.too_late}):
            out = ledger.outputs.get(period, [0, 0.0, n, total, 0])
            n, total = out[2], out[3]
            rows.append((pdf["key"].iloc[0], period, *out, ledger.late.get(period, 0), ledger.too_late.get(period, 0)))
        return pd.DataFrame(rows, columns=["key", "period", "n", "total", "running_n", "running_total", "corrections", "late_n", "too_late_n"])

    return cells.groupBy("key").applyInPandas(run, PERIODS)


def judged_events(events: DataFrame, period_days: int = 7, lateness: int = 28, every: int = 4) -> DataFrame:
    """Every event with its period and the verdict of its cell.

    Read twice: give a written table. All events of a cell share one verdict,
    and there are at most keys x periods x days cells, whose size Spark knows
    at run time and uses to choose the join.
    """
    verdicts = judged_cells(cells_of(events, period_days), period_days, lateness, every).select("key", "period", "known", "verdict")
    rows = events.withColumn("period", F.floor(F.col("event_day") / period_days).cast("int")).withColumn("known", F.col("known_day").cast("int"))
    return rows.join(verdicts, ["key", "period", "known"])
