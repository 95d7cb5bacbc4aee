"""Sources, contract, files, command line and stream."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from coterie import cli
from coterie.functions.clean import code, identifier
from coterie.plans import views
from coterie.sources import adapters, contract, files, generator
from coterie.streaming.late import corrected_totals
from tests.conftest import DATA, rows


def test_identifiers_and_codes(spark):
    good = "cfp_AbCdEfGh012345"
    data = [good, "CFP_AbCdEfGh012345", '"  cfp_AbCdEfGh012345\t"', "cfp_short", "cfp_AbCdEfGh0123456", "n/a", "", None, " " + good + "\n", "x" + good]
    df = spark.createDataFrame([(x,) for x in data], "card_fingerprint string")
    assert [r[0] for r in df.select(identifier("card_fingerprint")).collect()] == [good, good, good, None, None, None, None, None, good, None]
    df = spark.createDataFrame([(" Failed\n",), (" CARD\t",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(code("s")).collect()] == ["failed", "card", None, ""]


def test_conform_fills_and_complains(spark):
    df = spark.createDataFrame([("p", "c", 95, 95 * 86400, 5.0, True, 1.5, "x")], "payment_id string, customer_id string, day int, created_at bigint, amount double, is_fraud boolean, src_C1 double, other string")
    r = contract.conform(df).head()
    assert (r.status, r.method, r.signup_day, r.account_age_days, r.split, r.label_matured, r.refund_day, r.src_C1, r.ip) == ("captured", "unknown", 95, 0, "val", True, -1, 1.5, None)
    assert "other" not in r
    with pytest.raises(ValueError, match="amount, is_fraud"):
        contract.conform(df.drop("amount", "is_fraud"))
    assert contract.conform(df.limit(0)).count() == 0


def test_splits(spark):
    df = spark.createDataFrame([(0,), (89,), (90,), (110,), (149,), (150,), (-1,), (None,)], "day int")
    assert [r[0] for r in df.select(contract.split_of(F.col("day"))).collect()] == ["train", "train", "val", "test", "test", "unassigned", "unassigned", "unassigned"]


def test_card_data(spark, tmp_path):
    head = "TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD,card1,card4,card5,addr1,addr2,D1,C1,P_emaildomain,V1"
    lines = ["10,0,86400,12.5,W,1000,visa,226,300,87,5,1,mail.example,9", "11,1,172800,1,C,,,,,,,2,,9", "12,0,172801,3,C,1000,visa,226,300,87,6,2,,9"]
    with gzip.open(tmp_path / "train_transaction_slim.csv.gz", "wt") as f:
        f.write("\n".join([head, *lines]))
    (tmp_path / "train_identity.csv").write_text("TransactionID,DeviceInfo,id_30,id_31\n10,phone,,chrome\n12,,,\n")
    got = {r.payment_id: r for r in adapters.load(spark, "cards", f"file://{tmp_path}").collect()}
    a, b, c = got["pay_10"], got["pay_11"], got["pay_12"]
    assert (a.customer_id, a.day, a.amount, a.card_fingerprint, a.shipping_address_hash) == ("uid_1000_300_-5", 0, 1250.0, "card_1000_226", "addr_300_87")
    assert (a.device_fingerprint, c.device_fingerprint, b.device_fingerprint) == ("phone||chrome", None, None)
    assert a.customer_id == c.customer_id and b.customer_id == "uid_solo_11"
    assert (b.card_fingerprint, b.shipping_address_hash, b.is_fraud, b.src_C1) == (None, None, True, 2.0)
    with pytest.raises(FileNotFoundError):
        adapters.load(spark, "cards", f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="known are"):
        adapters.load(spark, "nothing")


@pytest.mark.parametrize("kind", ["orders", "events"])
def test_other_tables_as_payments(spark, kind):
    p = adapters.load(spark, kind, DATA)
    n = spark.read.parquet(f"{DATA}/{kind}.parquet").count()
    assert p.count() == n == p.select("payment_id").distinct().count()
    assert p.where("account_age_days < 0 or day is null or created_at is null").count() == 0


def test_generated_corpus(spark):
    p = adapters.load(spark, "generated").cache()
    assert p.select("payment_id").distinct().count() == p.count() > 20_000
    assert {r.ring_type for r in p.select("ring_type").distinct().collect()} == {"none", "card_testing", "refund_abuse", "bust_out"}
    assert p.where("floor(created_at / 86400) <> day or day < 0 or day > 149").count() == 0
    assert p.where("method <> 'card' and card_fingerprint is not null").count() == 0
    failed = p.where("ring_type = 'none'").agg(F.avg((F.col("status") == "failed").cast("int"))).head()[0]
    assert 0.09 < failed < 0.13
    again = generator.generate(spark).agg(F.bit_xor(F.xxhash64("payment_id", "amount"))).head()
    assert again == p.agg(F.bit_xor(F.xxhash64("payment_id", "amount"))).head()
    p.unpersist()


def test_population_has_aliases_and_groups_of_all_sizes(spark):
    pop = generator.population(spark, generator.Shape(customers=20_000))
    assert pop.where("regexp_replace(email, '[+][0-9]+', '') <> email_root").count() == 0
    assert 1_500 < pop.where("email <> email_root").count() < 2_100
    for column, tag, lo, hi, _ in generator.SHARING:
        sizes = {r["count"] for r in pop.where(F.col("benign_cluster").contains(tag)).groupBy(column).count().collect()}
        assert lo <= min(sizes) < max(sizes) <= hi


def test_files(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "day int, v string")
    files.write_named(df, base, "t")
    assert rows(files.read_named(spark, base, "t"), "day", "v") == [(1, "a"), (2, "b")]
    with pytest.raises(FileNotFoundError, match="step 'make'"):
        files.read_named(spark, base, "none", "make")
    files.write_named(df, base, "z", kind="csv")
    assert spark.read.option("header", True).csv(f"{base}/z").count() == 2 and list(tmp_path.rglob("*.csv.gz"))
    files.write_report(df, base, "r")
    assert spark.read.option("header", True).csv(f"{base}/r").count() == 2
    files.write_markdown(df, base, "m")
    assert [r.value for r in spark.read.text(f"{base}/m").collect()][:2] == ["| day | v |", "| - | - |"]


def test_command_line(spark, tmp_path):
    out = f"file://{tmp_path}"
    for step in ("data", "features", "evaluate", "verify", "narrative", "views"):
        assert cli.run(spark, step, DATA, out) == 0
    assert files.read_named(spark, out, "payments").count() > 900
    with pytest.raises(ValueError):
        cli.run(spark, "nothing", DATA, out)


def _card_folder(path, n=500):
    rng = random.Random(4)
    lines, ids = ["TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD,card1,card2,card3,card4,card5,card6,addr1,addr2,P_emaildomain,C1,C2,D1"], ["TransactionID,DeviceType,DeviceInfo,id_30,id_31,id_33"]
    for i in range(n):
        day, ring = rng.randrange(182), rng.random() < 0.2
        card = rng.randrange(5) if ring else rng.randrange(5, 200)
        lines.append(f"{1000 + i},{int(ring)},{86400 * (day + 1) + rng.randrange(86400)},{rng.randrange(5, 500)},W,{card},1,2,visa,{card % 7},debit,{card % 40},87,m{card % 9}.example,{rng.randrange(50) + 100 * ring},{rng.randrange(3)},{rng.randrange(90)}")
        ids.append(f"{1000 + i},mobile,d{card % 60},os,b,s" if i % 3 else f"{1000 + i},,,,,")
    (path / "train_transaction.csv").write_text("\n".join(lines))
    (path / "train_identity.csv").write_text("\n".join(ids))


@pytest.mark.parametrize("kind", ["generated", "cards"])
def test_all_steps_from_other_sources(spark, tmp_path, monkeypatch, kind):
    from coterie.operators import scoring
    from coterie.plans.graph import profile

    if kind == "generated":
        small = generator.Shape(customers=300, payments=700, rings=2)
        monkeypatch.setitem(adapters.SOURCES, "generated", lambda s, base: contract.conform(generator.generate(s, small)))
    else:
        _card_folder(tmp_path)
    monkeypatch.setattr(cli, "MOST_TREES", 3)
    data, out = f"file://{tmp_path}", f"file://{tmp_path}/out"
    for step in ("data", "features", "train", "evaluate", "explain", "bundle"):
        assert cli.run(spark, step, data, out, kind) == 0
    # on so few rows shuffled labels may look learned, so only the other checks must hold
    cli.run(spark, "verify", data, out, kind)
    bad = spark.read.option("header", True).csv(f"{out}/verification").where("cast(violations as bigint) > 0").collect()
    assert {r.check for r in bad} <= {"clock after day", "shuffled labels are learned"}
    given = [c for c in files.read_named(spark, out, "matrix").columns if c.startswith("src_")]
    arm = scoring.Arm.load(f"{out}/model_graph")
    if kind == "cards":
        assert given and set(given) <= set(arm.numeric) and profile(spark, out)[0].links[0].max_df == 40
        assert {r.split for r in contract.payments(spark, out, "day").join(files.read_named(spark, out, "matrix").select("payment_id", "split"), "payment_id").where("day between 150 and 181").select("split").distinct().collect()} == {"test"}
    before = rows(files.read_named(spark, out, "scores"), "payment_id", "score_graph")
    assert cli.run(spark, "score", data, out, kind) == 0
    assert rows(files.read_named(spark, out, "scores"), "payment_id", "score_graph") == before
    assert spark.read.text(f"{out}/bundle").head()[0].startswith("window.VIEWS = {")


def test_commands_report_on_the_written_scores(spark, tmp_path):
    from coterie.plans import reference

    out = f"file://{tmp_path}"
    p = contract.payments(spark, DATA).select("payment_id", F.lit(0.25).alias("score_base"), F.lit(0.75).alias("score_graph"))
    files.write_named(p, out, "scores", by=None)
    assert cli.run(spark, "evaluate", DATA, out) == 0
    got = spark.read.option("header", True).csv(f"{out}/headline").collect()
    assert {(r.arm, float(r.roc_auc)) for r in got} == {("base", 0.5), ("graph", 0.5)}
    assert {r.score for r in views.alerts(spark, DATA, scores=p).collect()} == {0.75}
    assert {r.with_graph for r in views.whatif(spark, DATA, views.alerts(spark, DATA).head().payment_id, p).collect()} == {0.75}
    assert reference.scored(spark, DATA, scores=p).where("score not in (0.25, 0.75)").count() == 0


def test_views_show_no_raw_identifier(spark):
    text = " ".join(r.value for df in (views.alerts(spark, DATA), views.rings(spark, DATA)) for r in df.select(F.to_json(F.struct("*")).alias("value")).collect())
    one = views.alerts(spark, DATA).head().payment_id
    text += " ".join(r.value for r in views.alert_detail(spark, DATA, one).select(F.to_json(F.struct("*")).alias("value")).collect())
    for prefix in ("cust_", "cfp_", "dev_", "addr_"):
        assert not any(len(w.split("…")[0]) > 10 for w in text.split('"') if w.startswith(prefix))
    assert views.alerts(spark, DATA, limit=10**6).count() <= views.MOST_ALERTS
    assert views.alert_detail(spark, DATA, "unknown").count() == 0


def test_graph_tables_come_back_when_their_files_are_gone(spark):
    from coterie.plans import graph
    from coterie.runtime import discard

    before = rows(graph.table(spark, DATA, "weights"))
    for kept in [v for k, v in graph._KEPT.items() if k[-1] in ("weights", "segments")]:
        discard(spark, kept[1])
    assert rows(graph.table(spark, DATA, "weights")) == before


def test_source_is_shipped_once(spark):
    from coterie.runtime import ship

    ship(spark)
    n = len(spark.sparkContext._python_includes)
    ship(spark)
    assert "coterie.zip" in spark.sparkContext._python_includes and len(spark.sparkContext._python_includes) == n


def test_stream_gives_the_batch_result(spark, tmp_path):
    schema = "key string, event_day int, known_day int, amount double"
    data = [("a", 3, 3, 5.0), ("a", 20, 21, 1.0), ("a", 4, 22, 2.0), ("b", 1, 2, None), ("a", 2, 60, 9.0), (None, 1, 1, 1.0), ("a", 15, 23, 4.0)]
    for i, part in enumerate((data[:2], data[2:5], data[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = corrected_totals(stream).writeStream.outputMode("update").format("memory").queryName("late_out").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("late_out").collect():
        if r.verdict != "too_late" and r.revision >= last.get((r.key, r.period), (0,))[0]:
            last[r.key, r.period] = (r.revision, r.n, r.total, r.running_n, r.running_total)
    from coterie.operators import late_events

    batch = {(r.key, r.period): (r.n, r.total, r.running_n, r.running_total) for r in late_events.period_totals(late_events.cells_of(spark.createDataFrame(data, schema))).collect()}
    assert {k: v[1:] for k, v in last.items()} == batch
