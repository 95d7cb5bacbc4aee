"""Operators of the pipeline on small hand-made tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.config import Costs, GraphConfig, Link
from coterie.operators import asof, catalogue, checks, clusters, communities, components, evaluation, explain, identity, pointintime, scoring
from coterie.plans import models
from coterie.sources import contract
from tests.conftest import rows

HOUR, DAY = 3600, 86400


def keyed(spark, data):
    return spark.createDataFrame([(f"p{i:03d}", *r) for i, r in enumerate(data)], "payment_id string, k string, created_at bigint")


# ---- point in time ----


def test_trailing_count_leaves_out_itself_ties_and_other_keys(spark):
    df = keyed(spark, [("a", 0), ("a", 100), ("a", 100), ("a", 3700), ("b", 50), (None, 10), (None, 20), ("a", None)])
    assert rows(pointintime.trailing_counts(df, "k", {"n": HOUR})) == [("p000", 0), ("p001", 1), ("p002", 1), ("p003", 2), ("p004", 0), ("p005", 0), ("p006", 0), ("p007", 0)]


def test_the_lower_bound_of_a_window_is_inside(spark):
    df = keyed(spark, [("a", 0), ("a", HOUR), ("a", 2 * HOUR + 1)])
    assert rows(pointintime.trailing_counts(df, "k", {"n": HOUR})) == [("p000", 0), ("p001", 1), ("p002", 0)]


@pytest.mark.parametrize("span", [HOUR // 2, HOUR * 3, DAY * 30])
def test_spans_do_not_change_results(spark, span):
    rng = random.Random(7)
    data = [(rng.choice(["hot", "hot", "hot", "x"]), rng.randrange(0, 40 * HOUR)) for _ in range(300)]
    df = keyed(spark, data).withColumn("v", F.lit(2.0))
    got = {r[0]: r[1:] for r in rows(pointintime.trailing_counts(df, "k", {"a": HOUR, "b": 5 * HOUR}, span=span))}
    run = {r[0]: r[1:] for r in rows(pointintime.running(df, "k", {"s": F.col("v")}, span=span))}
    for i, (k, t) in enumerate(data):
        pid = f"p{i:03d}"
        assert got[pid] == tuple(sum(1 for k2, t2 in data if k2 == k and t - w <= t2 < t) for w in (HOUR, 5 * HOUR))
        before = sorted((t2, j) for j, (k2, t2) in enumerate(data) if k2 == k and (t2, j) < (t, i))
        assert run[pid] == (len(before), before[-1][0] if before else None, 2.0 * len(before))


def test_prior_distinct(spark):
    df = spark.createDataFrame([("p1", "a", "x", 1), ("p2", "a", "x", 2), ("p3", "a", "y", 3), ("p4", "a", None, 4), ("p5", "b", "x", 5), ("p6", "a", "z", 6)], "payment_id string, a string, b string, created_at bigint")
    assert rows(pointintime.prior_distinct(df, "a", "b", "n")) == [("p1", 0), ("p2", 1), ("p3", 1), ("p4", 2), ("p5", 0), ("p6", 2)]


def test_features_do_not_see_the_future(spark):
    p = contract.payments(spark, "/root/testdata/sf0.001")
    early = p.where("day < 60")
    cols = ["payment_id", *models.TABULAR]
    rounded = lambda df: rows(df.select(*(F.round(c, 9).alias(c) if c != "payment_id" else F.col(c) for c in cols)))
    full = pointintime.tabular_features(p).join(early.select("payment_id"), "payment_id", "left_semi")
    assert rounded(full) == rounded(pointintime.tabular_features(early.repartition(7)))


# ---- identity ----

CFG = GraphConfig(links=(Link("card_fingerprint", 1.0, 3), Link("ip", 0.5, 15)), window_days=5, last_as_of=20)


def _graph(spark, data, cfg=CFG):
    p = spark.createDataFrame(data, "customer_id string, day int, card_fingerprint string, ip string")
    runs = identity.presence(identity.identifier_pairs(p, cfg.links), cfg)
    segments, nodes = identity.user_segments(runs, cfg), identity.window_nodes(p, cfg)
    sizes = identity.window_sizes(p, cfg)
    counted = {r.as_of_day: r["count"] for r in nodes.groupBy("as_of_day").count().collect()}
    assert {r.as_of_day: r.n_customers for r in sizes.collect() if r.n_customers} == counted
    weights = identity.identifier_weights(segments, sizes, cfg)
    tying = identity.tying_runs(runs, segments, cfg)
    members = identity.memberships(tying, weights)
    edges = identity.edges_of_runs(tying, weights, cfg)
    near = lambda df: {(r.as_of_day, r.src, r.dst): r.weight for r in df.collect()}
    assert near(edges) == pytest.approx(near(identity.identity_edges(members, cfg)))
    return nodes, weights, members, edges


def test_edges_of_many_runs(spark):
    rng = random.Random(6)
    data = [(f"c{rng.randrange(12)}", rng.randrange(20), rng.choice(["v", "w", None]), rng.choice(["x", "y", "z"])) for _ in range(120)]
    assert _graph(spark, data, GraphConfig(links=(Link("card_fingerprint", 1.0, 6), Link("ip", 0.5, 9)), window_days=3, last_as_of=20))[3].count() > 20


def test_hubs_at_and_above_the_cap(spark):
    base = [(f"x{i}", 1, None, None) for i in range(50)]
    at_cap = [(f"c{i}", 1, "shared", None) for i in range(3)]
    above = [(f"d{i}", 1, "busy", "") for i in range(4)]
    _, weights, _, edges = _graph(spark, base + at_cap + above + at_cap)
    assert {r.value for r in weights.collect()} == {"shared"}
    day = edges.where("as_of_day = 3").collect()
    assert sorted((r.src, r.dst) for r in day) == [("c0", "c1"), ("c0", "c2"), ("c1", "c2")]
    assert abs(day[0].weight - np.log(57 / 3) / np.log(57)) < 1e-12
    assert {r.as_of_day for r in edges.collect()} == {2, 3, 4, 5, 6}


def test_a_hub_ties_while_it_is_small(spark):
    data = [(f"x{i}", 1, None, None) for i in range(30)] + [("a", 1, "v", None), ("b", 1, "v", None)] + [(f"h{i}", 3, "v", None) for i in range(5)]
    _, weights, members, _ = _graph(spark, data)
    assert {(r.as_of_day, r.df) for r in weights.collect()} == {(2, 2), (3, 2)}
    assert members.count() == 4


def test_identity_of_nothing(spark):
    nodes, weights, members, edges = _graph(spark, [])
    assert [x.count() for x in (nodes, weights, members, edges)] == [0, 0, 0, 0]
    assert components.connected_components(edges).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find_per_day(spark, seed):
    rng = random.Random(seed)
    data = [(rng.randrange(3), f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(100)] + [(0, None, "n01"), (1, "n05", None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for d, a, b in data:
        if a and b and a != b:
            x, y = find((d, a)), find((d, b))
            parent[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(data, "as_of_day int, src string, dst string"))
    assert rows(got, "as_of_day", "customer_id", "component") == sorted((d, n, find((d, n))[1]) for d, n in list(parent))


@pytest.mark.parametrize("resolution", [0.5, 0.7, 0.9, 1.0])
def test_louvain_keeps_a_clique_whole(resolution):
    pairs = [(i, j) for i in range(26) for j in range(i + 1, 26)]
    a, b = np.array(pairs).T
    assert len(set(communities.louvain(a, b, np.full(len(a), 0.52), 26, resolution))) == 1


def test_louvain_splits_two_cliques_joined_by_an_edge(spark):
    pairs = [(i, j) for base in (0, 10) for i in range(base, base + 10) for j in range(i + 1, base + 10)] + [(9, 10)]
    edges = spark.createDataFrame([(5, f"n{i:02d}", f"n{j:02d}", 0.5) for i, j in pairs], "as_of_day int, src string, dst string, weight double")
    comp = components.connected_components(edges)
    loose = GraphConfig(whole_density=0.9)
    want = {f"cl_5_n{base:02d}": {f"n{i:02d}" for i in range(base, base + 10)} for base in (0, 10)}
    for limit in (10**6, 5):  # in a task, and in DataFrames
        found = {}
        for r in communities.communities(comp, edges, loose, task_edges=limit).collect():
            found.setdefault(r.cluster, set()).add(r.customer_id)
        assert found == want
    assert {r.cluster for r in communities.communities(comp, edges, GraphConfig(whole_density=0.4)).collect()} == {"cl_5_n00"}


def test_communities_are_the_same_in_a_task_and_in_tables(spark):
    rng = random.Random(8)
    data = []
    for day, n, groups in ((1, 40, 5), (2, 60, 9)):
        for i in range(n):
            for j in range(i + 1, n):
                if rng.random() < (0.6 if i % groups == j % groups else 0.03):
                    data.append((day, f"n{i:02d}", f"n{j:02d}", round(rng.uniform(0.1, 1.0), 3)))
    edges = spark.createDataFrame(data, "as_of_day int, src string, dst string, weight double")
    comp = components.connected_components(edges)
    one, other = (rows(communities.communities(comp, edges, GraphConfig(whole_density=0.99), task_edges=k)) for k in (10**6, 0))
    assert one == other and 10 < len({r[2] for r in one}) < 25
    assert rows(communities.communities(comp, edges.limit(0), GraphConfig())) == []


def test_resolution_prefers_own_then_strongest_link(spark):
    cfg = GraphConfig()
    p = spark.createDataFrame([("p1", "a", 3, "c1", "d1"), ("p2", "new", 3, "c2", "d1"), ("p3", "new", 3, None, "d1"), ("p4", "zz", 3, None, None)], "payment_id string, customer_id string, day int, card_fingerprint string, device_fingerprint string")
    p = p.withColumns({c: F.lit(None).cast("string") for c in ("shipping_address_hash", "contact", "email_root", "ip")})
    cl = spark.createDataFrame([(3, "a", "A")], "as_of_day int, customer_id string, cluster string")
    votes = spark.createDataFrame([(3, "card_fingerprint", "c2", "B"), (3, "device_fingerprint", "d1", "C")], "as_of_day int, link_type string, value string, cluster string")
    assert rows(asof.resolve(p, cl, votes, cfg), "payment_id", "cluster", "g_match") == [("p1", "A", 1), ("p2", "B", 2), ("p3", "C", 2), ("p4", None, 0)]


def test_equal_votes_go_to_the_first_cluster(spark):
    m = spark.createDataFrame([(1, "ip", "v", c) for c in "abcd"], "as_of_day int, link_type string, value string, customer_id string")
    cl = spark.createDataFrame([(1, "a", "Z"), (1, "b", "Z"), (1, "c", "K"), (1, "d", "K")], "as_of_day int, customer_id string, cluster string")
    assert rows(asof.identifier_votes(m, cl), "cluster") == [("K",)]


def test_unit_and_single_row_cluster(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(clusters.unit(F.col("x"), 0, 1)).collect()] == [0.0, 0.5, 1.0, 0.0]


# ---- evaluation ----

SCORED = "payment_id string, y int, score double, amount double"


@pytest.fixture(scope="module")
def six(spark):
    data = [("a", 1, 0.9, 10_000.0), ("b", 1, 0.8, 20_000.0), ("c", 0, 0.7, 30_000.0), ("d", 1, 0.4, 40_000.0), ("e", 0, 0.2, 50_000.0), ("f", 0, 0.2, 60_000.0)]
    return spark.createDataFrame(data, SCORED).withColumn("arm", F.lit("base"))


def test_curve_metrics_by_hand(six):
    assert evaluation.average_precision(six).head().pr_auc == pytest.approx((1 + 1 + 3 / 4) / 3)
    assert evaluation.roc_auc(six).head().roc_auc == pytest.approx(8 / 9)
    r = {x.target_precision: x for x in evaluation.recall_at_precision(six, (0.95, 0.7)).collect()}
    assert (r[0.95].recall, r[0.95].threshold) == (pytest.approx(2 / 3), 0.8)
    assert (r[0.7].recall, r[0.7].threshold) == (1.0, 0.4)


def test_unreachable_precision_and_one_class(six):
    none = six.withColumn("y", F.lit(0))
    r = evaluation.recall_at_precision(none, (0.5,)).head()
    assert (r.recall, r.threshold, r.achieved_precision) == (0.0, 1.0, 0.0)
    assert evaluation.roc_auc(none).head().roc_auc is None
    assert evaluation.pr_curve(six.limit(0)).count() == 0


def test_equal_scores_count_half(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 1.0), ("b", 0, 0.5, 1.0)], SCORED).withColumn("arm", F.lit("x"))
    assert evaluation.roc_auc(df).head().roc_auc == 0.5


def test_cost_curve_against_direct_sums(six):
    c = Costs()
    data = [(r.y, r.score, r.amount / 100) for r in six.collect()]
    for r in evaluation.cost_curve(six, c, 40).collect():
        blocked = [d for d in data if d[1] >= r.threshold]
        missed = [d for d in data if d[0] == 1 and d[1] < r.threshold]
        reviewed = [d for d in data if c.review_from <= d[1] < r.threshold]
        good = [d for d in blocked if d[0] == 0]
        want = sum(d[2] for d in missed) * (1 - c.recovery_rate) + len(missed) * c.chargeback_fee + sum(d[2] for d in good) * c.margin * c.churn_factor + len(reviewed) * c.review_cost
        assert r.total_cost == pytest.approx(want) and r.blocked == len(blocked) and r.reviewed == len(reviewed)


def test_saving_falls_with_churn_and_the_optimum_is_the_minimum(six):
    s = [r.net_saving for r in evaluation.cost_sensitivity(six).orderBy("churn_factor").collect()]
    assert s == sorted(s, reverse=True)
    curve = evaluation.cost_curve(six)
    assert evaluation.optimal_threshold(curve).head().total_cost == curve.agg(F.min("total_cost")).head()[0]


def test_tag_kinds(spark):
    df = spark.createDataFrame([("a_b_1;c_2;a_b_9",), ("",), (None,), (";",)], "t string")
    assert [r[0] for r in df.select(evaluation.tag_kinds(F.col("t"))).collect()] == ["a_b+c", *["no_shared_identifier"] * 3]


def test_permutation_test_tells_structure_from_none(spark):
    n = 600
    hot = spark.range(n).select(F.lit(1).alias("as_of_day"), F.floor(F.col("id") / 5).cast("string").alias("cluster"), (F.col("id") < 60).cast("int").alias("y"))
    mixed = hot.withColumn("y", F.expr(f"cast(cast(cluster as int) % 10 = 0 and y >= 0 as int)")).withColumn("cluster", F.expr("cast(pmod(xxhash64(cluster, y, rand(3)), 120) as string)"))
    a, b = evaluation.permutation_test(hot, 100).head(), evaluation.permutation_test(mixed, 100).head()
    assert a.observed == 1.0 and a.p_value < 0.02 and a.verdict == "structure present"
    assert b.p_value > 0.02


def test_label_noise(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("payment_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    fn = evaluation.corrupt_labels(df, "fn_only", 0.2)
    assert fn.where("flipped and y <> 0").count() == 0 and fn.where("flipped").count() == 400
    assert evaluation.corrupt_labels(df, "fn_only", 0.0).where("flipped").count() == 0
    assert evaluation.corrupt_labels(df, "fn_only", 1.0).where("flipped").count() == 2000
    assert 900 < evaluation.corrupt_labels(df, "symmetric", 0.05).where("flipped").count() < 1100
    assert rows(fn.limit(0)) == []
    with pytest.raises(ValueError):
        evaluation.corrupt_labels(df, "other", 0.1)


def test_study_summary(spark):
    df = spark.createDataFrame([("m", a, v) for a, vs in (("base", (0.5, 0.52)), ("graph", (0.7, 0.72))) for v in vs], "metric string, arm string, value double")
    r = evaluation.study_summary(df, ("metric",)).head()
    assert r.verdict == "graph better" and r.gap == pytest.approx(0.2)


# ---- explanation and models ----


def test_mask(spark):
    df = spark.createDataFrame([("card::cfp_abcdefgh",), ("short",), (None,)], "v string")
    assert [r[0] for r in df.select(explain.mask(F.col("v"))).collect()] == ["cfp…fgh", "sho…", None]


def test_quotes(spark):
    z = spark.createDataFrame([("a", "cl_cards_per_device", 3.5, 4.0), ("b", "cl_failure_rate", 0.001, 5.0), ("c", "cl_failure_rate", 0.42, 5.0), ("d", "vel_card_24h", 1.0, 5.0), ("e", "vel_card_24h", 1200.0, 5.0), ("f", "hour_of_day", 3.0, 9.0), ("g", "vel_card_24h", 0.0, 5.0)], "payment_id string, feature string, value double, z double")
    got = {r.payment_id: (r.text, r.number) for r in explain.quotes(z).collect()}
    assert got == {"a": ("the tied accounts used 3.50 cards per device", "3.50"), "c": ("42% of the payments of the tied accounts failed", "42%"), "d": ("this card paid once in the day before", "1"), "e": ("this card paid 1,200 times in the day before", "1,200")}


FACTS = explain.Facts("pay_A12", "1,234.00", "held for review", ["7 cards were new on this device in the day before", "a device is used by 5 accounts"], ["7", "1", "5"])


def test_a_draft_passes_its_own_check():
    assert explain.verify(explain.draft(FACTS), FACTS) == []
    bare = explain.Facts("p", "1.00", "released")
    assert explain.verify(explain.draft(bare), bare) == [] and explain.NOTHING in explain.draft(bare)


@pytest.mark.parametrize("text", ["pay_A12 was held for 99 reasons", "Payment held over 1,234.00", "pay_A12 looks like a criminal at work", "pay_A12: STOLEN card", "pay_A12 has 12 cards", "pay_A12 over 1,234.007", "pay_A12 over 11,234.00", "pay_A12: 7.5 cards", "pay_A123 has 7 cards"])
def test_notes_that_go_beyond_the_facts_are_rejected(text):
    assert explain.verify(text, FACTS)
    note = explain.write_note(FACTS, lambda f: text)
    assert note["source"] == "template" and note["rejected_because"]


def test_a_good_writer_is_kept():
    assert explain.write_note(FACTS, lambda f: "pay_A12 over 1,234.00 waits, 7 cards.")["source"] == "writer"


def test_link_points(spark):
    ids = [("device_fingerprint", "a", 5, False), ("device_fingerprint", "b", 4, False), ("ip", "c", 90, True), ("email_root", "d", 2, False)]
    df = spark.createDataFrame([(1, "c1", *i) for i in ids], "as_of_day int, cluster string, link_type string, value string, accounts bigint, pruned boolean")
    r = explain.link_points(df).head()
    assert [x.text for x in r.links] == ["2 devices are shared, one of them by 5 accounts", "a mail address is used by 2 accounts"]
    assert explain.link_points(df.limit(0)).count() == 0


def test_each_feature_stands_in_one_reason_group():
    everything = [c for cols in models.GROUPS.values() for c in cols]
    assert sorted(everything) == sorted([*models.TABULAR, *models.GRAPH, *contract.CATEGORICAL])
    assert {c for g in models.GRAPH_GROUPS for c in models.GROUPS[g]} == set(models.GRAPH)


def test_quoted_features_are_known():
    assert {s.feature for s in catalogue.SENTENCES} <= {*models.TABULAR, *models.GRAPH}


def test_narration(spark):
    g = catalogue.group_of
    amounts, ties, sharing, means = g("amount_z_vs_customer"), g("cl_customers"), g("new_cards_on_device_24h"), g("method")
    c = spark.createDataFrame([("p1", amounts, 0.4), ("p1", ties, 0.5), ("p1", sharing, 0.2), ("p1", means, 0.005), ("p2", ties, 0.5), ("p2", means, 0.3), ("p3", amounts, 0.001)], "payment_id string, group string, contribution double")
    z = spark.createDataFrame([("p1", "amount_z_vs_customer", 4.0, 9.0), ("p1", "cl_customers", 12.0, 3.5), ("p1", "new_cards_on_device_24h", 1.0, 0.6), ("p1", "prior_distinct_cards_device", 2.5, 0.9)], "payment_id string, feature string, value double, z double")
    known = spark.createDataFrame([("p1", True), ("p2", False), ("p3", True)], "payment_id string, clustered boolean")
    got = {r.payment_id: r for r in explain.narrate(c, z, known, models.GRAPH_GROUPS).collect()}
    assert [r.detail for r in got["p1"].reasons] == ["12 accounts are tied by shared details", "the amount is 4 times what this account pays on average", "2.50 cards had paid from this device"]
    assert not got["p1"].graph_driven and got["p1"].caveat is None
    assert [r.detail for r in got["p2"].reasons] == [means] and got["p2"].reasons[0].generic and got["p2"].caveat
    assert got["p3"].reasons == [] and got["p3"].summary == "no single driver"


def test_forbidden_columns():
    checks.assert_allowed([*models.TABULAR, *models.GRAPH, *contract.CATEGORICAL])
    with pytest.raises(ValueError, match="is_fraud"):
        checks.assert_allowed(["amount", "is_fraud"])


def test_an_arm_learns_and_occlusion_finds_why(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("payment_id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 * 5.0 + F.col("id") % 3).alias("amount"), F.lit(None).cast("double").alias("hour_of_day"), F.concat(F.lit("m"), F.col("id") % 4 % 3).alias("method"))
    arm = scoring.train_arm("a", df, ["amount", "hour_of_day"], ["method"], iterations=3)
    s = arm.predict(df.withColumn("method", F.lit("never seen"))).groupBy("y").agg(F.avg("score").alias("s")).collect()
    by = {r.y: r.s for r in s}
    assert by[1] > by[0] + 0.3
    occ = scoring.occlude(arm, df.where("y = 1").limit(5), {"value": ["amount"], "time": ["hour_of_day"]}, {"amount": 1.0, "hour_of_day": 3.0})
    per = {r.group: r.c for r in occ.groupBy("group").agg(F.avg("contribution").alias("c")).collect()}
    assert per["value"] > 0.3 > abs(per["time"])


def test_occlusion_reads_rows_once_and_falls_as_the_model_says(spark):
    df = spark.range(600).select(
        F.col("id").cast("string").alias("payment_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.when(F.col("id") % 7 > 0, F.col("id") % 3 * 2.0 + F.col("id") % 5).alias("amount"), F.when(F.col("id") % 11 == 0, float("nan")).otherwise(F.col("id") % 13 * 1.0).alias("hour_of_day"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("m"), F.col("id") % 6)).alias("method"),
    )
    arm = scoring.train_arm("a", df, ["amount", "hour_of_day"], ["method"], iterations=4)
    groups, honest = {"value": ["amount"], "time": ["hour_of_day"], "how": ["method", "amount"], "gone": ["missing"], "unknown": ["city"]}, {"amount": 3.0, "method": "no such level"}
    test = df.unionByName(df.limit(1).withColumn("payment_id", F.lit("new")).withColumn("method", F.lit("never seen")))
    occ = scoring.occlude(arm, test, groups, honest)
    assert "Window" not in occ._jdf.queryExecution().toString() and "Generate" not in occ._jdf.queryExecution().toString()
    got = {(r.payment_id, r.group): r.contribution for r in occ.collect()}
    whole = {r.payment_id: r.score for r in arm.predict(test).collect()}
    want = {}
    for g in ("value", "time", "how"):
        swapped = test.withColumns({c: F.lit(honest[c]) for c in groups[g] if c in honest})
        want |= {(r.payment_id, g): whole[r.payment_id] - r.score for r in arm.predict(swapped).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    assert any(v > 0.01 for v in got.values())
    assert scoring.occlude(arm, df.limit(0), groups, honest).count() == 0


def test_only_the_asked_arms_are_trained_and_arms_train_at_once(spark, monkeypatch):
    import threading

    both, seen = threading.Barrier(2, timeout=60), []

    def train(name, *_, **__):
        seen.append(name)
        if len(wanted) == 2:
            both.wait()
        return name

    monkeypatch.setattr(scoring, "train_arm", train)
    df = spark.createDataFrame([("train", True, 1)], "split string, matured boolean, y int")
    wanted = ("graph",)
    assert models.arms(df, names=wanted) == ("graph",) and seen == ["graph"]
    wanted = ("base", "graph")
    assert models.arms(df) == wanted


def test_curve_and_confusion_agree_on_close_scores(spark):
    data = [(0, 0.95), (1, 0.91999), (1, 0.91996), (0, 0.91995), (1, 0.5), (0, 0.5)]
    df = spark.createDataFrame([("base", y, s, 1.0) for y, s in data], "arm string, y int, score double, amount double")
    for r in evaluation.pr_curve(df).collect():
        c = evaluation.confusion(df, {"base": r.threshold}).head()
        assert (c.tp, c.fp) == (r.tp, r.fp)
    assert evaluation.pr_curve(df).count() == 5
    costs = {r.threshold: r.blocked for r in evaluation.cost_curve(df, points=40).collect()}
    assert all(n == sum(s >= t for _, s in data) for t, n in costs.items())


def test_curves_over_many_ranges_equal_brute_force(spark):
    rng = random.Random(5)
    data = [(a, int(rng.random() < 0.3), rng.choice([rng.random(), 0.5]), 1.0) for a in ("base", "graph") for _ in range(400)]
    df = spark.createDataFrame(data, "arm string, y int, score double, amount double").repartition(7)
    got = {r.arm: r for r in evaluation.headline(df).collect()}
    for arm in ("base", "graph"):
        pos, neg = ([s for a, y, s, _ in data if a == arm and y == k] for k in (1, 0))
        want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
        assert got[arm].roc_auc == pytest.approx(want) and (got[arm].n, got[arm].positives) == (400, len(pos))
    points = evaluation.pr_curve(df).where("arm = 'base'").collect()
    assert all(p.tp + p.fp == sum(s >= p.threshold for a, _, s, _ in data if a == "base") for p in points)
    assert evaluation.headline(df.limit(0)).count() == 0


def test_draws_from_urns_beyond_a_thousand_million():
    rng = np.random.default_rng(1)
    assert abs(evaluation.hypergeometric(rng, 3 * 10**9, 10**9, 10**9) / 10**9 - 0.75) < 1e-4
    few = [evaluation.hypergeometric(rng, 50, 4 * 10**9, 2 * 10**9) for _ in range(300)]
    assert 23 < np.mean(few) < 27 and max(few) <= 50
    assert evaluation.hypergeometric(rng, 5, 0, 3) == 3 and evaluation.hypergeometric(rng, 0, 5, 3) == 0
    assert evaluation._hot_frauds(rng, 2, 3, 6) == 6 and 0 <= evaluation._hot_frauds(rng, 10, 2_500_000, 1000) <= 1000
