"""Edge cases of the core data operators, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from coterie.operators import as_known, entity_features, hot_keys, late_events, rolling
from coterie.sources.payments import latest
from tests.conftest import rows


def test_latest_takes_last_delivery_and_ignores_order(spark):
    df = spark.createDataFrame([("a", 1.0, "old"), ("a", 2.0, "new"), ("a", 2.0, "new"), ("b", None, "only"), (None, 9.0, "x"), ("c", None, "n"), ("c", 0.0, "z")], "id string, at double, v string")
    assert rows(latest(df, "id", "at", {"v": F.col("v")})) == [("a", "new"), ("b", "only"), ("c", "z")]
    assert rows(latest(df.limit(0), "id", "at", {"v": F.col("v")})) == []


# ---- features ----

EVENTS = "event_id string, entity string, event_type string, day int, amount double, received_at double, bucket string, n int"


def _brute(events, lo=None, hi=None):
    best = {}
    for e in events:
        if e[0] is None or None in e[1:4]:
            continue
        k = (e[5] is not None, e[5] or 0.0, e[1], e[2], e[3], e[4] or 0)
        if e[0] not in best or k > best[e[0]][0]:
            best[e[0]] = (k, e)
    out = {}
    for _, e in best.values():
        if lo is None or lo <= e[3] < hi:
            c = out.setdefault((e[1], e[2]), [0, -999, 0.0])
            c[0], c[1], c[2] = c[0] + 1, max(c[1], e[3]), c[2] + (e[4] if e[4] is not None and e[4] == e[4] else 0)
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


def test_feature_store_recomputes_changed_buckets_only(spark, tmp_path):
    rng = random.Random(1)
    ev = [(f"e{i}", rng.choice("abc"), rng.choice("xy"), rng.randrange(0, 95), float(rng.randrange(1, 50)), float(i), "clash", 7) for i in range(200)]
    ev += [("n1", None, "x", 3, 1.0, 1.0, "", 0), ("n2", "a", "x", 3, None, 1.0, "", 0), ("n3", "a", "x", 4, float("nan"), 1.0, "", 0), (None, "a", "x", 4, 1.0, 1.0, "", 0), ("n4", "a", None, 4, 1.0, 1.0, "", 0), ("n5", "a", "x", None, 1.0, 1.0, "", 0)]
    store = entity_features.FeatureStore(spark, f"file://{tmp_path}/s", bucket_days=10)
    df = spark.createDataFrame(ev, EVENTS)
    assert store.refresh(df) == list(range(10))
    assert rows(store.features(), "entity", "event_type", "n", "last_day", "total") == _brute(ev)
    assert store.refresh(df) == []
    # a newer version moves an event from one bucket to another: both are recomputed, no other
    moved = next(e for e in ev if e[0] == "e5")
    day = (moved[3] + 30) % 95
    ev2 = [*ev, ("e5", "a", "x", day, 5.0, 999.0, "", 0)]
    df2 = spark.createDataFrame(ev2, EVENTS)
    assert store.refresh(df2) == sorted({moved[3] // 10, day // 10})
    assert rows(store.features(), "entity", "event_type", "n", "last_day", "total") == _brute(ev2)
    for lo, hi in ((7, 63), (10, 30), (12, 18), (0, 95)):
        assert rows(store.features(lo, hi, df2), "entity", "event_type", "n", "last_day", "total") == _brute(ev2, lo, hi)
    wide = {r.entity: r for r in entity_features.one_row_per_entity(store.features()).collect()}
    assert {(e, t): v.n for e, r in wide.items() for t, v in r.features.items()} == {(a, b): n for a, b, n, *_ in _brute(ev2)}


def test_refreshes_at_once_and_superseded_runs(spark, tmp_path):
    import os

    ev = lambda n: spark.createDataFrame([(f"e{i}", "a", "x", i % 20, 1.0, float(n), "", 0) for i in range(n)], EVENTS)
    one, two = (entity_features.FeatureStore(spark, f"file://{tmp_path}/s", bucket_days=10) for _ in range(2))
    one.refresh(ev(10))
    # the other store read its manifest before this refresh ends: it starts over
    save, raced = two._save, []
    two._save = lambda *x: save(*x) if raced or raced.append(one.refresh(ev(20))) else save(*x)
    two.refresh(ev(30))
    assert rows(two.features()) == rows(one.features()) == [("a", "x", 30, 19, 30.0)]
    for n in (31, 32, 33):
        before = one.features()
        one.refresh(ev(n))
        assert rows(before, "n") == [(n - 1,)] and rows(one.features(), "n") == [(n,)]
    left = os.listdir(tmp_path / "s")
    assert len([n for n in left if n.startswith("manifest-")]) == 2


def test_unchanged_files_are_not_read_again(spark, tmp_path, monkeypatch):
    where = f"file://{tmp_path}/in"
    spark.createDataFrame([(f"e{i}", "a", "x", i % 20, 1.0, 1.0, "", 0) for i in range(50)], EVENTS).write.parquet(where)
    store, read = entity_features.FeatureStore(spark, f"file://{tmp_path}/s", bucket_days=10), []
    prints = store.fingerprints
    monkeypatch.setattr(store, "fingerprints", lambda p: read.append(1) or prints(p))
    assert store.refresh(spark.read.parquet(where)) == [0, 1] and store.refresh(spark.read.parquet(where)) == [] and len(read) == 1
    assert store.refresh(spark.read.parquet(where).withColumn("event_type", F.lit("y"))) == [0, 1]
    spark.createDataFrame([("new", "a", "x", 3, 1.0, 1.0, "", 0)], EVENTS).write.mode("append").parquet(where)
    assert store.refresh(spark.read.parquet(where).withColumn("event_type", F.lit("y"))) == [0] and len(read) == 3
    assert rows(store.features(), "n") == [(51,)]


def test_feature_store_of_nothing(spark, tmp_path):
    store = entity_features.FeatureStore(spark, f"file://{tmp_path}/s")
    empty = spark.createDataFrame([], EVENTS)
    assert store.refresh(empty) == []
    assert rows(store.features()) == []
    assert rows(store.features(3, 9, empty)) == []


# ---- late events ----


def test_ledger_equals_sums_after_any_order_of_arrival():
    rng = random.Random(2)
    for _ in range(50):
        ledger, want = late_events.ReplayLedger(7, 28, every=3), {}
        known = 0
        for _ in range(40):
            known += rng.randrange(0, 4)
            batch = [(rng.randrange(0, 20), known, rng.randrange(1, 5), float(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4))]
            verdicts = ledger.ingest(batch)
            for (p, k, n, t), v in zip(batch, verdicts, strict=True):
                over = k - (7 * p + 6)
                assert v == ("on_time" if over <= 0 else "corrects" if over <= 28 else "too_late")
                if v != "too_late":
                    w = want.setdefault(p, [0, 0.0])
                    w[0], w[1] = w[0] + n, w[1] + t
            run = [0, 0.0]
            for p in sorted(want):
                run = [run[0] + want[p][0], run[1] + want[p][1]]
                assert ledger.outputs[p][:4] == [*want[p], *run]


def test_late_replays_only_the_suffix():
    ledger = late_events.ReplayLedger(7, 28, every=2)
    for p in range(10):
        ledger.ingest([(p, 7 * p, 1, 1.0)])
    before = ledger.replayed
    ledger.ingest([(8, 75, 1, 1.0)])
    assert ledger.replayed - before == 2  # periods 8 and 9, from the snapshot before 8


def test_a_ledger_releases_what_no_cell_can_ask_for():
    ledger = late_events.ReplayLedger(7, 28, every=2, disorder=0)
    for p in range(40):
        ledger.ingest([(p, 7 * p, 1, 1.0)])
    assert len(ledger.snapshots) <= 5 and ledger.outputs[39][2] == 40
    assert ledger.ingest([(36, 274, 1, 1.0)]) == ["corrects"] and ledger.outputs[39][2] == 41
    assert ledger.ingest([(3, 274, 1, 1.0)]) == ["too_late"]
    # a day that comes in disorder finds its snapshot gone
    assert ledger.ingest([(3, 40, 1, 1.0)]) == ["too_late"] and ledger.too_late == {3: 2}


def test_late_events_with_nulls_ties_and_clashing_columns(spark):
    schema = "payment_id string, key string, event_day int, known_day int, amount double, verdict string, n int"
    data = [("a", "refund", 3, 3, 5.0, "", 0), ("b", "refund", 3, 7, None, "", 0), ("b", "refund", 3, 7, None, "", 0), ("c", "refund", 6, 34, float("nan"), "", 0), ("d", "refund", 0, 35, 2.0, "", 0), ("e", None, 1, 1, 1.0, "", 0), ("f", "refund", None, 1, 1.0, "", 0), ("g", "refund", 1, None, 1.0, "", 0), ("h", "other", -1, -1, 1.0, "", 0)]
    df = spark.createDataFrame(data, schema).select("payment_id", "key", "event_day", "known_day", "amount")
    assert rows(late_events.judged_events(df), "payment_id", "period", "verdict") == [("a", 0, "on_time"), ("b", 0, "corrects"), ("b", 0, "corrects"), ("c", 0, "corrects"), ("d", 0, "too_late"), ("h", -1, "on_time")]
    clash = late_events.period_totals(late_events.cells_of(spark.createDataFrame(data, schema)))
    assert rows(clash) == [("other", -1, 1, 1.0, 1, 1.0, 0, 0, 0), ("refund", 0, 4, 5.0, 4, 5.0, 2, 3, 1)]
    assert rows(late_events.period_totals(late_events.cells_of(df.limit(0)))) == []


# ---- hot keys ----

KEYED = "field tinyint, key_value string, at bigint, tie bigint, amount double, part string, n int"


def _per_key(data):
    groups = {}
    for f, k, at, tie, amount, *_ in data:
        groups.setdefault((f, k), []).append((at or 0, tie, amount if amount is not None and amount == amount else 0.0))
    out = []
    for (f, k), g in groups.items():
        t = sorted(x[0] for x in g)
        out.append((f, k, len(g), sum(x[2] for x in g), t[0], t[-1], max((b - a for a, b in zip(t, t[1:])), default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_hot_keys_equal_brute_force(spark, chunk):
    rng = random.Random(3)
    data = [(rng.randrange(2), rng.choice(["hot"] * 8 + ["a", "b", None, ""]), rng.choice([rng.randrange(500), 5, None]), i, rng.choice([1.0, 2.5, None, float("nan")]), "x", 1) for i in range(900)]
    df = spark.createDataFrame(data, KEYED).repartition(5)
    got = hot_keys.per_key(df, chunk_rows=chunk)
    assert rows(got, "field", "key_value", "n", "total", "first_at", "last_at", "max_gap") == _per_key(data)


def test_key_pieces_are_numbered_without_gaps_and_bounded(spark):
    df = spark.range(5000).select(F.lit(0).cast("tinyint").alias("field"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key_value"), F.col("id").alias("at"), F.col("id").alias("tie"), F.lit(1.0).alias("amount"))
    pieces = hot_keys.key_pieces(df, chunk_rows=100).collect()
    assert max(p.n for p in pieces) <= 100
    for key in {p.key_value for p in pieces}:
        nxt = 0
        for p in sorted((p for p in pieces if p.key_value == key), key=lambda p: p.first_row):
            assert p.first_row == nxt
            nxt += p.n
    assert sum(p.n for p in pieces) == 5000


def test_chunks_of_a_hot_key_are_equal(spark):
    df = spark.range(2000).select(F.lit(1).cast("tinyint").alias("field"), F.when(F.col("id") % 4 > 0, "hot").alias("key_value"), (F.col("id") % 7).alias("at"), F.col("id").alias("tie"), F.lit(1.0).alias("amount"))
    chunks = hot_keys.key_pieces(df, chunk_rows=70).groupBy("key_value", "chunk").agg(F.sum("n").alias("n"), F.min("first_row").alias("first"))
    for key, n in (("hot", 1500), (None, 500)):
        got = sorted((r.chunk, r.first, r.n) for r in chunks.collect() if r.key_value == key)
        assert got == [(i, i * 70, min(70, n - i * 70)) for i in range(-(-n // 70))]


def test_hot_keys_of_nothing(spark):
    assert rows(hot_keys.per_key(spark.createDataFrame([], KEYED))) == []


# ---- as known ----


def _as_known(events, changes, strict, by_x):
    out = []
    for e, ent, x, y in events:
        seen = [c for c in changes if None not in c and ent is not None and x is not None and y is not None and c[0] == ent and c[1] <= x and (c[2] < y if strict else c[2] <= y)]
        if seen and e is not None:
            out.append((e, max(seen, key=lambda c: (c[1], c[2], c[3]) if by_x else (c[2], c[3], c[1]))[3]))
    return sorted(out)


@pytest.mark.parametrize(("seed", "group_rows"), [*((s, 200_000) for s in range(4)), (4, 20), (5, 1)])
def test_as_known_equals_brute_force(spark, seed, group_rows):
    rng = random.Random(seed)
    day = 86400
    # days and seconds disagree by up to 40 days, so events see changes of several logs
    events = [(f"e{i}", rng.choice(["a", "a", "b", None]), rng.choice([rng.randrange(90), None]) if i % 20 == 0 else rng.randrange(90), 0) for i in range(150)]
    events = [(e, k, x, (x or 0) * day + rng.choice([0, 5, day - 1, day + 9, -day, 40 * day])) for e, k, x, _ in events]
    made = lambda: [(rng.choice(["a", "b", None]), x, (x + rng.choice([0, 0, 1, 33])) * day + rng.choice([0, 5, 7]), f"r{rng.randrange(60)}") for x in (rng.randrange(90) for _ in range(80))]
    one, two = made(), [*made(), ("a", None, 3, "n"), ("a", 3, None, "n"), ("a", 3, 3, None)]
    one += one[:10]  # repeated rows
    ev = spark.createDataFrame([(*e, "clash") for e in events], "event_id string, entity string, x int, y bigint, ref string")
    ch = lambda c: spark.createDataFrame([(*r, 1) for r in c], "entity string, x int, y bigint, ref string, epoch int")
    got = as_known.attributes_as_known(ev, [as_known.Feed("one", ch(one), False, True), as_known.Feed("two", ch(two), True, False)], 10, group_rows)
    assert sorted((r.event_id, r.ref_id) for r in got.where("feed = 'one'").collect()) == _as_known(events, one, False, True)
    assert sorted((r.event_id, r.ref_id) for r in got.where("feed = 'two'").collect()) == _as_known(events, two, True, False)


def test_as_known_of_nothing(spark):
    ev = spark.createDataFrame([], "event_id string, entity string, x int, y bigint")
    ch = spark.createDataFrame([], "entity string, x int, y bigint, ref string")
    assert rows(as_known.attributes_as_known(ev, [as_known.Feed("f", ch, False, True)])) == []
    one = spark.createDataFrame([("e", "a", 1, 90000)], ev.schema)
    assert rows(as_known.attributes_as_known(one, [as_known.Feed("f", ch, False, True)])) == []


# ---- rolling ----


def test_rolling_equals_brute_force_on_all_days(spark):
    rng = random.Random(5)
    data = [(0, rng.choice(["a", "a", "a", "b", None, ""]), rng.choice([rng.randrange(-40, 60), None]), rng.choice([1.0, 7.0, None, float("nan")]), 1, 2) for _ in range(300)]
    df = spark.createDataFrame(data, "field tinyint, entity string, day int, amount double, n int, day_from int")
    days = rolling.each_day(rolling.trailing_segments(df, 0, 49, (7, 30)))
    got = {(r.entity, r.day): (r.n_7, r.total_7, r.n_30, r.total_30) for r in days.collect()}
    value = lambda a: a if a is not None and a == a else 0.0
    for ent in ("a", "b", ""):
        for d in range(50):
            of = lambda w: [value(r[3]) for r in data if r[1] == ent and r[2] is not None and d - w < r[2] <= d]
            want = (len(of(7)), sum(of(7)), len(of(30)), sum(of(30)))
            assert got.get((ent, d), (0, 0.0, 0, 0.0)) == want
    assert len(got) == len(days.collect())  # no day twice
    assert rows(rolling.trailing_segments(df.limit(0), 0, 49)) == []
    avg = rolling.trailing_averages(days).where("entity = 'a' and day = 20").head()
    assert avg.avg_7 == avg.total_7 / 7


def test_segments_of_totals_cover_every_day(spark):
    from coterie.plans import problems

    data = "/root/testdata/sf0.001"
    seg = problems.p6_totals(spark, data)
    days = problems.p6_day_totals(spark, data)
    assert days.where("n_30 = 0 and avg_30 = 0").count() > 0
    per = seg.groupBy("entity_type", "entity").agg(F.min("day_from").alias("lo"), F.max("day_to").alias("hi"), F.sum(F.col("day_to") - F.col("day_from") + 1).alias("n"))
    assert per.where(f"hi <> {problems.DAYS - 1} or n <> hi - lo + 1").count() == 0
    assert days.count() == per.agg(F.sum("n")).head()[0]
