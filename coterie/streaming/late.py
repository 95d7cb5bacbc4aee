"""The late-event ledger as a stream: outputs are replaced as late records arrive.

Within each micro-batch events are first added up to cells of (key, period,
known day) where they are read, so a key that holds most events sends few rows;
the cells then update a per-key state that holds the ledger. An output row with a higher revision replaces the one before.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from coterie.operators.late_events import CORRECTS, ON_TIME, TOO_LATE, ReplayLedger

OUT = "key string, period int, n bigint, total double, running_n bigint, running_total double, revision bigint, verdict string"


def dump(ledger: ReplayLedger, revision: int) -> str:
    return json.dumps({"order": ledger.order, "outputs": ledger.outputs, "snapshots": ledger.snapshots, "late": ledger.late, "too_late": ledger.too_late, "clock": ledger.clock, "first_block": ledger.first_block, "revision": revision})


def load(text: str, period_days: int, lateness: int, every: int) -> tuple[ReplayLedger, int]:
    d, ledger = json.loads(text), ReplayLedger(period_days, lateness, every)
    ints = lambda m: {int(k): v for k, v in m.items()}
    ledger.order, ledger.outputs, ledger.snapshots = d["order"], ints(d["outputs"]), {int(k): tuple(v) for k, v in d["snapshots"].items()}
    ledger.late, ledger.too_late = ints(d["late"]), ints(d["too_late"])
    ledger.clock, ledger.first_block = d["clock"], d["first_block"]
    return ledger, d["revision"]


def _add_up(batches):
    """Cells of the rows of each Arrow batch."""
    for pdf in batches:
        yield pdf.groupby(["key", "period", "known"], as_index=False).agg(n=("amount", "size"), total=("amount", "sum"))


def corrected_totals(events: DataFrame, period_days: int = 7, lateness: int = 28, every: int = 4) -> DataFrame:
    """Changed outputs of each micro-batch from a stream of (key, event_day, known_day, amount).

    Rows without key, event day or known day are left out, null amounts are 0.
    Within a micro-batch a key's cells come to one task as Arrow batches; the
    state has a few numbers per period, whatever the number of events. Events
    beyond the cut-off change nothing; a row with verdict 'too_late' tells how
    many there were. All other rows are the new outputs of their period.
    """

    def update(key, batches, state: GroupState):
        ledger, revision = load(state.get[0], period_days, lateness, every) if state.exists else (ReplayLedger(period_days, lateness, every), 0)
        cells: dict[tuple[int, int], list] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                c = cells.setdefault((int(r.known), int(r.period)), [0, 0.0])
                c[0] += int(r.n)
                c[1] += float(r.total)
        before = {p: list(v) for p, v in ledger.outputs.items()}
        how: dict[int, set[str]] = {}
        refused: dict[int, int] = {}
        for known in sorted({k for k, _ in cells}):
            batch = [(p, k, n, total) for (k, p), (n, total) in sorted(cells.items()) if k == known]
            for (p, _, n, _), v in zip(batch, ledger.ingest(batch), strict=True):
                if v == TOO_LATE:
                    refused[p] = refused.get(p, 0) + n
                else:
                    how.setdefault(p, set()).add(v)
        revision += 1
        name = lambda p: CORRECTS if CORRECTS in how.get(p, ()) else ON_TIME if p in how else "replayed"
        rows = [(key[0], p, *out[:4], revision, name(p)) for p, out in sorted(ledger.outputs.items()) if before.get(p) != out]
        rows += [(key[0], p, n, 0.0, 0, 0.0, revision, TOO_LATE) for p, n in sorted(refused.items())]
        state.update((dump(ledger, revision),))
        yield pd.DataFrame(rows, columns=["key", "period", "n", "total", "running_n", "running_total", "revision", "verdict"])

    rows = events.where("key is not null and event_day is not null and known_day is not null").select(
        "key", F.floor(F.col("event_day") / period_days).cast("int").alias("period"), F.col("known_day").cast("int").alias("known"), F.coalesce(F.when(~F.isnan("amount"), F.col("amount")), F.lit(0.0)).alias("amount")
    )
    cells = rows.mapInPandas(_add_up, "key string, period int, known int, n bigint, total double")
    return cells.groupBy("key").applyInPandasWithState(update, OUT, "ledger string", "update", GroupStateTimeout.NoTimeout)
