"""Distinct counts over huge identifier sets, from delta-coded sorted hash runs.

Identifiers are hashed to 64 bits. The hash space is cut into 2**bits buckets,
so a set of any size is a list of bounded runs, and a popular day, city or
identifier never lands in one task. A run holds the sorted distinct hashes of
one group and bucket, delta-coded. Runs of the finest groups are the stored,
mergeable form: the run of a coarser group, or of two stores together, is the
k-way union of runs. A store of fewer buckets is cut to those of the finer one
first: a bucket is a range of hashes, so a run falls apart into runs.

Two identifiers count as one only if their 64-bit hashes agree. Among n
identifiers the expected number of such pairs, and with it both the
probability of any error and the expected shortfall of a count, is at most
n (n - 1) / 2**65.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = ("day", "method", "city")
RUNS = "field tinyint, bits tinyint, bucket int, day int, method string, city string, n bigint, run binary"
COUNTS = "field tinyint, grouping string, day int, method string, city string, n bigint"


def encode_run(hashes: np.ndarray) -> bytes:
    """Delta-code sorted distinct unsigned 64-bit hashes: the width of a delta in bytes, then the deltas."""
    if not len(hashes):
        return b"\x00"
    deltas = np.diff(hashes, prepend=np.uint64(0))
    width = max(1, (int(deltas.max()).bit_length() + 7) // 8)
    return bytes([width]) + deltas.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode_run(run: bytes) -> np.ndarray:
    width = run[0]
    if not width:
        return np.empty(0, np.uint64)
    packed = np.frombuffer(run, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :width] = packed
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def union_runs(runs: list[np.ndarray]) -> np.ndarray:
    """k-way union of sorted runs: their merged order without repeats."""
    if len(runs) == 1:
        return runs[0]
    merged = np.concatenate(runs)
    merged.sort(kind="stable")
    keep = np.ones(len(merged), bool)
    keep[1:] = merged[1:] != merged[:-1]
    return merged[keep]


def hash_bits(rows: int, run_limit: int = 200_000) -> int:
    """Bits of the bucket number that keep a field's hashes of one bucket below ``run_limit``."""
    return max(2, math.ceil(math.log2(max(1, rows / run_limit))))


def build_runs(ids: DataFrame, bits: int) -> DataFrame:
    """Runs of the finest groups from rows (field, id, day, method, city).

    Null ids are no identifiers and are left out; a null day, method or city
    is a group of its own. Repeated rows change nothing. The distinct step
    combines before its shuffle, so an identifier that stands on a third of
    all rows sends a row per group and partition at most.
    """
    h = F.xxhash64("id")
    pairs = ids.where("id is not null").select(F.col("field").cast("tinyint").alias("field"), F.col("day").cast("int").alias("day"), "method", "city", h.alias("h")).distinct()

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        field, bucket = pdf["field"].iloc[0], pdf["bucket"].iloc[0]
        cells = pdf.groupby(list(DIMS), dropna=False, sort=False)["h"]
        rows = []
        for (day, method, city), h in cells:
            run = np.sort(h.to_numpy().view(np.uint64))
            rows.append((field, bits, bucket, None if pd.isna(day) else int(day), None if pd.isna(method) else method, None if pd.isna(city) else city, len(run), encode_run(run)))
        return pd.DataFrame(rows, columns=["field", "bits", "bucket", *DIMS, "n", "run"]).astype({"day": "Int32"})

    bucket = F.shiftrightunsigned("h", 64 - bits).cast("int")
    return pairs.withColumn("bucket", bucket).groupBy("field", "bucket").applyInPandas(encode, RUNS)


def with_bits(runs: DataFrame, bits: int) -> DataFrame:
    """The runs of a store in 2**bits buckets, which must not be fewer than it has."""

    def cut(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.bits > bits:
                    raise ValueError(f"a run of {r.bits} bits cannot be put into buckets of {bits}")
                h = decode_run(r.run)
                bucket = h >> np.uint64(64 - bits)
                names, starts = np.unique(bucket, return_index=True)
                for name, part in zip(names.tolist(), np.split(h, starts[1:]), strict=True):
                    rows.append((r.field, bits, name, r.day, r.method, r.city, len(part), encode_run(part)))
            yield pd.DataFrame(rows, columns=["field", "bits", "bucket", *DIMS, "n", "run"]).astype({"day": "Int32"})

    return runs.select("field", "bits", "bucket", *DIMS, "n", "run").mapInPandas(cut, RUNS)


def merge_stores(a: DataFrame, b: DataFrame) -> DataFrame:
    """The runs of two stores, united in as many buckets as the finer one has; read twice.

    A task holds one bucket of a field, which ``hash_bits`` bounds.
    """

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        field, bits, bucket = pdf["field"].iloc[0], pdf["bits"].iloc[0], pdf["bucket"].iloc[0]
        cells: dict[tuple, list[bytes]] = {}
        for day, method, city, run in zip(pdf["day"].astype("Int32"), pdf["method"], pdf["city"], pdf["run"], strict=True):
            cells.setdefault(tuple(None if pd.isna(x) else x for x in (day, method, city)), []).append(run)
        rows = []
        for of, runs in cells.items():
            run = union_runs([decode_run(r) for r in runs])
            rows.append((field, bits, bucket, *of, len(run), encode_run(run) if len(runs) > 1 else runs[0]))
        return pd.DataFrame(rows, columns=["field", "bits", "bucket", *DIMS, "n", "run"]).astype({"day": "Int32"})

    both = a.unionByName(b)
    bits = both.agg(F.max("bits")).head()[0]
    return both if bits is None else with_bits(both, bits).groupBy("field", "bits", "bucket").applyInPandas(unite, RUNS)


def _lattice() -> list[tuple[tuple[str, ...], tuple[str, ...] | None]]:
    """Each combination of dimensions with the finer one that it is united from."""
    sets = [c for n in range(len(DIMS), -1, -1) for c in combinations(DIMS, n)]
    return [(s, next((p for p in reversed(sets) if len(p) == len(s) + 1 and set(s) < set(p)), None)) for s in sets]


def distinct_counts(runs: DataFrame) -> DataFrame:
    """(field, grouping, day, method, city, n) for every combination of the dimensions.

    ``grouping`` names the dimensions that are set, joined by '+', or is
    'all'. The counts of a group's buckets add up, since buckets share no hash.
    """

    def cube(pdf: pd.DataFrame) -> pd.DataFrame:
        field = pdf["field"].iloc[0]
        if pdf["bits"].nunique() > 1:
            raise ValueError("runs of different bits; unite the stores by merge_stores")
        day = pdf["day"].astype("Int32")
        cells = list(zip((None if pd.isna(d) else int(d) for d in day), pdf["method"], pdf["city"], strict=True))
        level = {DIMS: {c: decode_run(r) for c, r in zip(cells, pdf["run"], strict=True)}}
        rows = []
        for dims, finer in _lattice():
            if finer is not None:
                at, parts = [finer.index(d) for d in dims], {}
                for key, run in level[finer].items():
                    parts.setdefault(tuple(key[i] for i in at), []).append(run)
                level[dims] = {k: union_runs(v) for k, v in parts.items()}
            name = "+".join(dims) or "all"
            for key, run in level[dims].items():
                of = dict(zip(dims, key, strict=True))
                rows.append((field, name, of.get("day"), of.get("method"), of.get("city"), len(run)))
        return pd.DataFrame(rows, columns=["field", "grouping", *DIMS, "n"]).astype({"day": "Int32"})

    per_bucket = runs.groupBy("field", "bucket").applyInPandas(cube, COUNTS)
    return per_bucket.groupBy("field", "grouping", *DIMS).agg(F.sum("n").alias("n"))


def with_error(counts: DataFrame) -> DataFrame:
    """Adds ``error_bound``, the birthday bound on the expected shortfall of ``n``."""
    n = F.col("n").cast("double")
    return counts.withColumn("error_bound", n * (n - 1) / F.lit(2.0**65))
