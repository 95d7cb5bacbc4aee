"""Per-entity features from events, by incremental time-bucketed partials.

Partial aggregates per (entity, event type) are stored for each bucket of
days. A refresh compares a fingerprint of each bucket's deliveries with the
stored one and recomputes the changed buckets only. Features over any range of
days merge the stored buckets that lie inside it with the events of the days
at its two ends.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.runtime import state

EVENTS = ("event_id", "entity", "event_type", "day", "amount", "received_at")
CELL = "entity string, event_type string, n bigint, last_day int, total double, bucket int"


def _partials(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("day").alias("last_day"),
        F.sum(F.when(~F.isnan("amount"), F.col("amount"))).alias("total"),
    )


def merge_cells(cells: DataFrame) -> DataFrame:
    """Merge partial aggregates into one row per (entity, event type)."""
    return cells.groupBy("entity", "event_type").agg(
        F.sum("n").alias("n"), F.max("last_day").alias("last_day"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total")
    )


def one_row_per_entity(cells: DataFrame) -> DataFrame:
    """One row per entity; ``features`` maps each event type to its count, last day and total.

    A group holds one entry per event type, so it is bounded by the number of
    types, however many events an entity has.
    """
    cell = F.struct("event_type", F.struct("n", "last_day", "total").alias("cell"))
    return cells.groupBy("entity").agg(
        F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("features"),
        F.sum("n").alias("n"),
        F.max("last_day").alias("last_day"),
        F.sum("total").alias("total"),
    )


class FeatureStore:
    """Partial aggregates in a folder, one parquet partition per bucket.

    Events are deliveries with the columns of ``EVENTS``; other columns are
    ignored. The same ``event_id`` may come several times: the delivery
    received last counts, once. Rows without event id, entity, type or day
    belong to no cell and are left out. Null and NaN amounts count as an event
    of amount 0. No events give no rows.

    A manifest names the run that wrote each bucket. Runs are never changed in
    place and each refresh writes a new manifest under the next number, so a
    failed refresh leaves the stored state as it was, and of two at once the
    one that ends later starts over from the other's result. Runs that neither
    the latest manifest nor the one before it names are removed; what was read
    from the store stays readable until the second refresh after it.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_days: int = 30):
        self.spark, self.path, self.bucket_days = spark, path, bucket_days
        self._fs = spark._jvm.org.apache.hadoop.fs
        where = self._fs.Path(path)
        self._io = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self._done: set[str] = set()  # runs that this store's refreshes have superseded

    def _bucket(self):
        return F.floor(F.col("day") / self.bucket_days).cast("int")

    def _names(self, start: str) -> list[str]:
        """Names in the store's folder that begin so, the latest last."""
        where = self._fs.Path(self.path)
        found = self._io.listStatus(where) if self._io.exists(where) else []
        return sorted(n for s in found if (n := s.getPath().getName()).startswith(start))

    def _inputs(self, events: DataFrame) -> str:
        """What the events are made from: their plan and the state of their files; empty where they come from no files."""
        files = events.inputFiles()
        if not files:
            return ""
        # of very many files the folders stand for them
        at = files if len(files) <= 1000 else {f.rsplit("/", 1)[0] for f in files}
        return hashlib.sha1(repr([events.semanticHash(), *((f, state(self.spark, f)) for f in sorted(at))]).encode()).hexdigest()

    def _read(self, name: str) -> dict | None:
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).head(1)
        try:
            return json.loads(rows[0][0]) if rows else None
        except json.JSONDecodeError:
            return None  # still being written

    def _manifest(self) -> tuple[int, str, dict[str, dict]]:
        """The number of the latest manifest, the inputs it was made from, and its buckets."""
        for name in reversed(self._names("manifest-")):
            if (found := self._read(name)) is not None:
                return int(name.split("-")[1]), found["inputs"], found["buckets"]
        return 0, "", {}

    def _save(self, number: int, inputs: str, buckets: dict[str, dict]) -> bool:
        """Write the manifest under a number, if no other refresh has taken it."""
        try:
            out = self._io.create(self._fs.Path(f"{self.path}/manifest-{number:08d}"), False)
        except Py4JJavaError:
            return False
        out.write(bytearray(json.dumps({"inputs": inputs, "buckets": buckets}).encode()))
        out.close()
        return True

    def _clean(self) -> None:
        kept = self._names("manifest-")[-2:]
        runs = {e["run"] for name in kept for e in (self._read(name) or {"buckets": {}})["buckets"].values()}
        for name in (*self._names("manifest-")[:-2], *(n for n in self._done if n not in runs)):
            self._io.delete(self._fs.Path(f"{self.path}/{name}"), True)
        self._done &= runs

    def _prepared(self, events: DataFrame) -> DataFrame:
        return events.select(*EVENTS).where("event_id is not null and entity is not null and event_type is not null and day is not null").withColumn("bucket", self._bucket())

    def _valid(self, prepared: DataFrame) -> DataFrame:
        row = F.struct("received_at", "entity", "event_type", "day", "amount", "bucket")
        return prepared.groupBy("event_id").agg(F.max(row).alias("row")).select("row.*")

    def fingerprints(self, prepared: DataFrame) -> dict[str, list]:
        """Per bucket a count and two sums of hashes over its deliveries.

        One row per bucket comes to the driver, which the span of days bounds.
        """
        h = F.xxhash64(*EVENTS)
        rows = prepared.groupBy("bucket").agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(0xFFFFFF)))).collect()
        return {str(r[0]): [r[1], r[2], r[3]] for r in rows}

    def refresh(self, events: DataFrame) -> list[int]:
        """Bring the store up to date with all deliveries; returns the recomputed buckets.

        Where neither the files of the events nor what is made of them have
        changed since the last refresh, nothing is read.
        """
        inputs = self._inputs(events)
        if inputs and self._manifest()[1] == inputs:
            return []
        prepared = self._prepared(events)
        now = self.fingerprints(prepared)
        while True:
            number, before, buckets = self._manifest()
            changed = self._update(prepared, now, buckets)
            if not changed and before == inputs:
                return []
            if self._save(number + 1, inputs, buckets):
                self._clean()
                return sorted(changed)

    def _update(self, prepared: DataFrame, now: dict[str, list], manifest: dict[str, dict]) -> set[int]:
        """Recompute the changed buckets in a new run and enter them into ``manifest``."""
        changed = {int(b) for b in now.keys() | manifest.keys() if manifest.get(b, {}).get("print") != now.get(b)}
        if not changed:
            return changed
        source = prepared
        if manifest:
            # a new delivery may take its event out of another bucket: recompute that one as well
            ids = prepared.where(F.col("bucket").isin(*changed)).select("event_id").distinct()
            moved = prepared.join(ids, "event_id", "left_semi").select("bucket").distinct().collect()
            changed |= {r[0] for r in moved}
            ids = prepared.where(F.col("bucket").isin(*changed)).select("event_id").distinct()
            source = prepared.join(ids, "event_id", "left_semi")
        run = f"run-{uuid.uuid4().hex[:12]}"
        cells = _partials(self._valid(source).where(F.col("bucket").isin(*changed)), "entity", "event_type", "bucket")
        cells.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{run}")
        for b in changed:
            old = manifest.pop(str(b), None)
            if old:
                self._done.add(old["run"])
            if str(b) in now:
                manifest[str(b)] = {"print": now[str(b)], "run": run}
        return changed

    def cells(self, buckets: set[int] | None = None) -> DataFrame:
        """Stored partials of the given buckets, or of all."""
        by_run: dict[str, list[str]] = {}
        for b, entry in self._manifest()[2].items():
            where = f"{self.path}/{entry['run']}/bucket={b}"
            # a bucket may hold no valid delivery: then it has no folder
            if (buckets is None or int(b) in buckets) and self._io.exists(self._fs.Path(where)):
                by_run.setdefault(entry["run"], []).append(where)
        parts = [self.spark.read.schema(CELL).option("basePath", f"{self.path}/{run}").parquet(*paths) for run, paths in by_run.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], CELL)

    def features(self, lo: int | None = None, hi: int | None = None, events: DataFrame | None = None) -> DataFrame:
        """(entity, event_type, n, last_day, total) over days ``lo`` <= day < ``hi``.

        Without bounds all buckets are merged. With bounds the buckets inside
        are merged, and the days at the ends come from ``events``.
        """
        if lo is None or hi is None:
            return merge_cells(self.cells())
        first, last = -(-lo // self.bucket_days), hi // self.bucket_days
        inside = set(range(first, last)) if first < last else set()
        cells = self.cells(inside).drop("bucket")
        ends = F.col("day").between(lo, hi - 1) & ~F.col("bucket").isin(*inside) if inside else F.col("day").between(lo, hi - 1)
        if events is not None and not (inside and lo == first * self.bucket_days and hi == last * self.bucket_days):
            # only deliveries of events with some delivery in the end days can matter
            prepared = self._prepared(events)
            edge = prepared.where(ends).select("event_id").distinct()
            valid = self._valid(prepared.join(edge, "event_id", "left_semi")).where(ends)
            cells = cells.unionByName(_partials(valid, "entity", "event_type"))
        return merge_cells(cells)
