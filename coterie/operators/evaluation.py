"""Tables that judge scores: curves, operating points, costs and breakdowns.

Input is a table of scored payments: y (0 or 1), score, amount, and for the
breakdowns their own columns; ``arm`` names the model. Curves and costs start
from one aggregation per distinct score. Scores are taken as they are, so
every threshold of a curve tells what flagging from it up gives.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coterie.config import Costs
from coterie.runtime import materialise

PRECISIONS = (0.95, 0.90, 0.80, 0.60)


MEASURES = ("n", "pos", "amount", "pos_amount")


def by_score(scored: DataFrame) -> DataFrame:
    """(arm, score, n, pos, amount, pos_amount) per distinct score. Rows with a null y or score are left out."""
    rows = scored.where("y is not null and score is not null")
    return rows.groupBy("arm", F.col("score").cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("pos"), F.sum("amount").alias("amount"), F.sum(F.when(F.col("y") == 1, F.col("amount")).otherwise(0.0)).alias("pos_amount")
    )


def add_up(rows: DataFrame) -> DataFrame:
    """``rows`` (arm, score, mark, measures) with each measure's sum down to the row, and over its arm.

    Down means from the greatest score, rows with ``mark`` after others of the
    same score. Rows are ranged by (arm, score) and written; sums run inside
    each range, and what the ranges before hold, a row per arm and range, is
    added. So there may be as many distinct scores as payments.
    """
    ranged, _ = materialise(rows.repartitionByRange("arm", F.desc("score"), "mark").withColumn("part", F.spark_partition_id()), "scores")
    per = ranged.groupBy("arm", "part").agg(*(F.sum(m).alias(m) for m in MEASURES))
    before, arm = Window.partitionBy("arm").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("arm")
    base = per.select("arm", "part", *(F.sum(m).over(before).alias(f"base_{m}") for m in MEASURES), *(F.sum(m).over(arm).alias(f"all_{m}") for m in MEASURES))
    down = Window.partitionBy("arm", "part").orderBy(F.desc("score"), "mark").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.select("*", *(F.sum(m).over(down).alias(f"in_{m}") for m in MEASURES))
    joined = inside.join(F.broadcast(base), ["arm", "part"])  # a row per arm and range
    return joined.select("arm", "score", "mark", *MEASURES, *((F.coalesce(f"base_{m}", F.lit(0)) + F.col(f"in_{m}")).alias(f"down_{m}") for m in MEASURES), *(f"all_{m}" for m in MEASURES))


def curve_points(scored: DataFrame) -> DataFrame:
    """Each distinct score of each arm with its measures added up."""
    return add_up(by_score(scored).withColumn("mark", F.lit(False)))


def _curve(points: DataFrame) -> DataFrame:
    tp, n = F.col("down_pos"), F.col("down_n")
    return points.select("arm", F.col("score").alias("threshold"), tp.alias("tp"), (n - tp).alias("fp"), (tp / n).alias("precision"), F.coalesce(tp / F.nullif("all_pos", F.lit(0)), F.lit(0.0)).alias("recall"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """(arm, threshold, tp, fp, precision, recall) at every distinct score, flagging scores from it up."""
    return _curve(curve_points(scored))


def _precision() -> Column:
    """The precision at each score, weighted by the recall it adds."""
    return F.coalesce(F.sum(F.col("pos") / F.nullif("all_pos", F.lit(0)) * F.col("down_pos") / F.col("down_n")), F.lit(0.0))


def _in_order() -> Column:
    """The share of pairs of a positive and a negative in order, of equal scores half."""
    c = F.col
    wins = c("pos") * ((c("all_n") - c("all_pos")) - (c("down_n") - c("down_pos")) + (c("n") - c("pos")) / 2)
    pairs = F.max("all_pos").cast("double") * (F.max("all_n") - F.max("all_pos"))
    return F.sum(wins) / F.nullif(pairs, F.lit(0.0))


def average_precision(scored: DataFrame) -> DataFrame:
    """(arm, pr_auc): the precision at each score, weighted by the recall it adds."""
    return curve_points(scored).groupBy("arm").agg(_precision().alias("pr_auc"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """(arm, roc_auc): the share of pairs in order, equal scores counting half; null with one class only."""
    return curve_points(scored).groupBy("arm").agg(_in_order().alias("roc_auc"))


def headline(scored: DataFrame) -> DataFrame:
    """(arm, n, positives, base_rate, pr_auc, roc_auc)."""
    n, pos = F.max("all_n"), F.max("all_pos")
    return curve_points(scored).groupBy("arm").agg(n.alias("n"), pos.alias("positives"), (pos / n).alias("base_rate"), _precision().alias("pr_auc"), _in_order().alias("roc_auc"))


def recall_at_precision(scored: DataFrame, targets: tuple[float, ...] = PRECISIONS) -> DataFrame:
    """(arm, target_precision, recall, threshold, achieved_precision).

    Of the thresholds that reach the target the one of greatest recall, then
    the lowest; if none does, recall 0 at threshold 1 and the best precision.
    """
    curve = pr_curve(scored)
    target = F.explode(F.array(*map(F.lit, targets))).alias("target_precision")
    rows = curve.select("arm", "threshold", "precision", "recall", target)
    ok = F.col("precision") >= F.col("target_precision")
    best = F.max(F.when(ok, F.struct(F.col("recall"), (-F.col("threshold")).alias("t"), F.col("precision"))))
    return rows.groupBy("arm", "target_precision").agg(best.alias("b"), F.max("precision").alias("top")).select(
        "arm", "target_precision", F.coalesce("b.recall", F.lit(0.0)).alias("recall"), F.coalesce(-F.col("b.t"), F.lit(1.0)).alias("threshold"), F.coalesce("b.precision", "top").alias("achieved_precision")
    )


def precision_at_recall(scored: DataFrame, targets: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """(arm, target_recall, precision, threshold): the mirror of ``recall_at_precision``."""
    rows = pr_curve(scored).select("arm", "threshold", "precision", "recall", F.explode(F.array(*map(F.lit, targets))).alias("target_recall"))
    best = F.max(F.when(F.col("recall") >= F.col("target_recall"), F.struct(F.col("precision"), (-F.col("threshold")).alias("t"))))
    return rows.groupBy("arm", "target_recall").agg(best.alias("b")).select("arm", "target_recall", F.coalesce("b.precision", F.lit(0.0)).alias("precision"), F.coalesce(-F.col("b.t"), F.lit(0.0)).alias("threshold"))


def ablation(operating: DataFrame, base: str = "base", graph: str = "graph") -> DataFrame:
    """Recall of two arms at each precision, with the absolute and relative lift."""
    wide = operating.groupBy("target_precision").pivot("arm", [base, graph]).agg(F.first("recall"))
    a, b = F.col(base), F.col(graph)
    return wide.select("target_precision", a.alias("base_recall"), b.alias("graph_recall"), (b - a).alias("lift"), ((b - a) / F.nullif(a, F.lit(0.0)) * 100).alias("relative_lift"))


def confusion(scored: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Counts and rates of each arm at its threshold; a rate with an empty denominator is 0."""
    t = reduce(lambda out, kv: out.when(F.col("arm") == kv[0], F.lit(kv[1])), thresholds.items(), F.when(F.lit(False), F.lit(0.0)))
    flag, y = F.col("score") >= F.col("threshold"), F.col("y") == 1
    n = lambda c: F.count_if(c)
    out = scored.withColumn("threshold", t).groupBy("arm", "threshold").agg(n(flag & y).alias("tp"), n(flag & ~y).alias("fp"), n(~flag & y).alias("fn"), n(~flag & ~y).alias("tn"))
    rate = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = out.withColumns({"precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn")), "alert_rate": rate(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def per_archetype(scored: DataFrame, threshold: float) -> DataFrame:
    """Per arm and ring type of fraud: rows, recall, median score, captured and caught amounts in whole major units."""
    flag, captured = F.col("score") >= threshold, F.col("status") == "captured"
    money = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0.0)) / 100)
    return scored.where("ring_type is not null and ring_type <> 'none'").groupBy("arm", F.col("ring_type").alias("archetype")).agg(
        F.count(F.lit(1)).alias("payments"), F.avg(flag.cast("double")).alias("recall"), F.median("score").alias("median_score"), money(captured).alias("amount_major"), money(flag & captured).alias("caught_major")
    )


def archetype_lift(per: DataFrame, base: str = "base", graph: str = "graph") -> DataFrame:
    """Recall of both arms side by side for each archetype."""
    wide = per.groupBy("archetype").pivot("arm", [base, graph]).agg(F.first("recall"))
    return wide.select("archetype", F.col(base).alias("base_recall"), F.col(graph).alias("graph_recall"), (F.col(graph) - F.col(base)).alias("lift"))


def tag_kinds(tags: Column) -> Column:
    """'a_1;b_2;a_3' becomes 'a+b'; no tags become 'no_shared_identifier'."""
    kinds = F.transform(F.filter(F.split(F.coalesce(tags, F.lit("")), ";"), lambda x: x != ""), lambda x: F.regexp_replace(x, "_[^_]*$", ""))
    joined = F.array_join(F.array_sort(F.array_distinct(kinds)), "+")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("no_shared_identifier"))


def fp_composition(scored: DataFrame, threshold: float) -> DataFrame:
    """Where the false positives lie: per arm and kind of benign sharing the number and share."""
    n = scored.where((F.col("score") >= threshold) & (F.col("y") == 0)).groupBy("arm", tag_kinds(F.col("benign_cluster")).alias("bucket")).agg(F.count(F.lit(1)).alias("false_positives"))
    return n.withColumn("share", F.round(F.col("false_positives") / F.sum("false_positives").over(Window.partitionBy("arm")), 4))


def missed_fraud(scored: DataFrame, threshold: float) -> DataFrame:
    """Fraud under the threshold per arm and ring type."""
    captured = F.when(F.col("status") == "captured", F.col("amount"))
    return scored.where((F.col("score") < threshold) & (F.col("y") == 1)).groupBy("arm", F.col("ring_type").alias("archetype")).agg(
        F.count(F.lit(1)).alias("missed_payments"), F.round(F.coalesce(F.sum(captured), F.lit(0.0)) / 100).alias("missed_major"), F.round(F.median("score"), 4).alias("median_score"), F.round(F.median("amount") / 100).alias("median_amount_major")
    )


def novel_vs_seen(scored: DataFrame, train: DataFrame, threshold: float) -> DataFrame:
    """Recall on rings that already had fraud in training, and on new ones."""
    seen = train.where("y = 1 and ring_id is not null").select("ring_id").distinct().withColumn("seen", F.lit(True))
    fraud = scored.where("y = 1").join(seen, "ring_id", "left")
    cohort = F.when(F.col("seen"), "seen_in_training").otherwise("novel_ring")
    return fraud.groupBy("arm", cohort.alias("cohort")).agg(F.count_distinct("ring_id").alias("rings"), F.count(F.lit(1)).alias("payments"), F.avg((F.col("score") >= threshold).cast("double")).alias("recall"))


def do_nothing_cost(scored: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(arm, do_nothing_cost): what fraud costs when nothing is blocked."""
    c = by_score(scored).groupBy("arm").agg(F.sum("pos_amount").alias("a"), F.sum("pos").alias("n"))
    return c.select("arm", (F.coalesce("a", F.lit(0.0)) / 100 * (1 - costs.recovery_rate) + F.col("n") * costs.chargeback_fee).alias("do_nothing_cost"))


def thresholds(spark, points: int) -> DataFrame:
    """The grid of thresholds, rounded to four digits."""
    return spark.range(points).select(F.round(F.lit(0.01) + F.col("id") * (0.989 / (points - 1)), 4).alias("threshold")).distinct()


def cost_curve(scored: DataFrame, costs: Costs = Costs(), points: int = 200) -> DataFrame:
    """Counts and costs of each arm at every threshold of the grid.

    Thresholds are placed among the score rows, and one running sum over both
    gives what lies at or above each: no product of payments and thresholds.
    What lies between the review bound and the threshold is reviewed.
    """
    spark = scored.sparkSession
    s = by_score(scored)
    grid = thresholds(spark, points).unionByName(spark.range(1).select(F.lit(float(costs.review_from)).alias("threshold"))).distinct()
    arms = scored.where("y is not null and score is not null").select("arm").distinct()
    zero = [F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"), F.lit(0.0).alias("amount"), F.lit(0.0).alias("pos_amount")]
    marks = arms.withColumn("k", F.lit(1)).join(F.broadcast(grid.withColumn("k", F.lit(1))), "k").select("arm", F.col("threshold").alias("score"), *zero, F.lit(True).alias("mark"))
    arm = Window.partitionBy("arm")
    at = add_up(s.withColumn("mark", F.lit(False)).unionByName(marks)).where("mark")
    at = at.select("arm", "score", *(F.col(f"down_{m}").alias(m) for m in MEASURES), *(f"all_{m}" for m in MEASURES))
    at = at.withColumn("from_review", F.max(F.when(F.col("score") == costs.review_from, F.col("n"))).over(arm))
    c = F.col
    out = at.select(
        "arm", c("score").alias("threshold"), c("n").alias("blocked"), F.greatest(c("from_review") - c("n"), F.lit(0)).alias("reviewed"),
        c("pos").alias("caught_fraud"), (c("all_pos") - c("pos")).alias("missed_fraud"), (c("n") - c("pos")).alias("blocked_good"),
        ((c("all_pos_amount") - c("pos_amount")) / 100 * (1 - costs.recovery_rate)).alias("fraud_loss"),
        ((c("all_pos") - c("pos")) * costs.chargeback_fee).alias("chargebacks"),
        ((c("amount") - c("pos_amount")) / 100 * costs.margin * costs.churn_factor).alias("false_block_loss"),
        (F.greatest(c("from_review") - c("n"), F.lit(0)) * costs.review_cost).alias("review_loss"),
        (c("all_pos_amount") / 100 * (1 - costs.recovery_rate) + c("all_pos") * costs.chargeback_fee).alias("do_nothing_cost"),
    )
    total = c("fraud_loss") + c("chargebacks") + c("false_block_loss") + c("review_loss")
    return out.join(F.broadcast(thresholds(spark, points)), "threshold").withColumn("total_cost", total).withColumn("net_saving", c("do_nothing_cost") - c("total_cost"))


def optimal_threshold(curve: DataFrame) -> DataFrame:
    """The cheapest row of each arm's curve, the lowest threshold on ties."""
    row = F.struct(*(c for c in curve.columns if c != "arm"))
    return curve.groupBy("arm").agg(F.min_by(row, F.struct(F.round("total_cost", 6), "threshold")).alias("b")).select("arm", "b.*")


def cost_sensitivity(scored: DataFrame, costs: Costs = Costs(), factors: tuple[float, ...] = (1.0, 1.8, 2.6, 4.0, 6.0), points: int = 90) -> DataFrame:
    """The optimum for several values of the churn factor, which only scales one term of one curve."""
    curve = cost_curve(scored, costs, points)
    rows = curve.select("*", F.explode(F.array(*map(F.lit, factors))).alias("churn_factor"))
    loss = F.col("false_block_loss") / costs.churn_factor * F.col("churn_factor")
    rows = rows.withColumn("total_cost", F.col("fraud_loss") + F.col("chargebacks") + loss + F.col("review_loss"))
    best = rows.groupBy("arm", "churn_factor").agg(F.min_by(F.struct("threshold", "blocked", "caught_fraud", "total_cost", "do_nothing_cost"), F.struct(F.round("total_cost", 6), "threshold")).alias("b")).select("arm", "churn_factor", "b.*")
    saving = F.col("do_nothing_cost") - F.col("total_cost")
    return best.select("arm", "churn_factor", F.col("threshold").alias("optimal_threshold"), "blocked", "caught_fraud", F.round(saving).alias("net_saving"), F.round(saving / F.nullif("do_nothing_cost", F.lit(0.0)) * 100, 1).alias("saving_percent"))


#: Upper ends of the cluster-size buckets with their names.
SIZE_BUCKETS = ((0, "no cluster"), (4, "2-4 accounts"), (19, "5-19 accounts"), (99, "20-99 accounts"), (None, "100+ accounts"))


def size_bucket(size: Column) -> Column:
    size = F.coalesce(size, F.lit(0))
    out = F.lit(SIZE_BUCKETS[-1][1])
    for top, name in reversed(SIZE_BUCKETS[:-1]):
        out = F.when(size <= top, name).otherwise(out)
    return out


def fraud_concentration(rows: DataFrame, keys: tuple[str, ...] = ("as_of_day", "cluster")) -> DataFrame:
    """Share of the fraud in clusters of two or more rows that are mostly fraud. Rows without cluster are left out."""
    per = rows.where("cluster is not null and cluster <> ''").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("f"))
    hot = F.when((F.col("n") >= 2) & (F.col("f") / F.col("n") > 0.5), F.col("f")).otherwise(0)
    return per.agg(F.sum("n").alias("clustered_rows"), F.count(F.lit(1)).alias("clusters"), F.sum("f").alias("fraud_rows"), F.coalesce(F.sum(hot) / F.nullif(F.sum("f"), F.lit(0)), F.lit(0.0)).alias("concentration"))


def hypergeometric(rng: np.random.Generator, good: int, other: int, drawn: int, limit: int = 10**9 - 1) -> int:
    """How many of ``good`` are among ``drawn`` out of ``good + other``.

    Exact below ``limit`` of each kind, the most that NumPy draws from. Above
    it the law is normal to within one in a thousand of its deviation, or,
    where few can be drawn at all, binomial.
    """
    if drawn <= 0 or good <= 0:
        return 0
    if other <= 0:
        return min(drawn, good)
    if good <= limit and other <= limit:
        return int(rng.hypergeometric(good, other, drawn))
    n = good + other
    mean = drawn * (good / n)
    var = mean * (other / n) * ((n - drawn) / max(1, n - 1))
    if mean * (other / n) < 1000 or var < 1000:
        # few can be drawn at all: a binomial step is exact to the share that was drawn
        return int(min(good, drawn, rng.binomial(min(good, drawn), min(1.0, max(good, drawn) / n))))
    return int(min(good, drawn, max(0, drawn - other, round(rng.normal(mean, var**0.5)))))


def _hot_frauds(rng: np.random.Generator, n: int, c: int, inside: int, chunk: int = 1_000_000) -> int:
    """Frauds in the clusters that are mostly fraud, of ``c`` clusters of ``n`` rows that hold ``inside`` frauds.

    The clusters are filled in chunks, each by one draw from what is left.
    """
    hot, done = 0, 0
    while done < c and inside:
        k = min(chunk, c - done)
        part = hypergeometric(rng, inside, (c - done) * n - inside, k * n)
        if part and k * n < 10**9:
            f = rng.multivariate_hypergeometric(np.full(k, n), part, method="marginals")
            hot += int(f[f / n > 0.5].sum())
        elif part:
            # clusters so large that a chunk goes beyond what NumPy draws: one after the other
            rest = part
            for j in range(k):
                f = hypergeometric(rng, rest, (k - j) * n - rest, n)
                hot, rest = hot + (f if f / n > 0.5 else 0), rest - f
        done, inside = done + k, inside - part
    return hot


def permutation_test(rows: DataFrame, permutations: int = 400, seed: int = 20260905, keys: tuple[str, ...] = ("as_of_day", "cluster")) -> DataFrame:
    """Fraud concentration against clusters of the same sizes filled at random.

    Only the sizes of the clusters and the number of frauds matter for the
    null distribution, so what reaches the tasks is a histogram of sizes, with
    a row per distinct size. Each permutation draws the frauds of the clusters
    one after the other from the urn that is left.
    """
    spark = rows.sparkSession
    observed = fraud_concentration(rows, keys).head()
    per = rows.where("cluster is not null and cluster <> ''").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hist = [(r.n, r.c) for r in per.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy("n").collect()]
    total, fraud = sum(n * c for n, c in hist), int(observed.fraud_rows or 0)

    def draw(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                left, bad, hot = total, fraud, 0
                for n, c in hist:
                    # frauds that fall into the clusters of this size, then split over them
                    inside = hypergeometric(rng, bad, left - bad, n * c)
                    left, bad = left - n * c, bad - inside
                    if n >= 2 and inside:
                        hot += _hot_frauds(rng, n, c, inside)
                out.append(hot / fraud if fraud else 0.0)
            yield pd.DataFrame({"value": out})

    null = spark.range(0, permutations, 1, 8).mapInPandas(draw, "value double")
    s = null.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count_if(F.col("value") >= observed.concentration).alias("k"))
    z = (F.lit(observed.concentration) - F.col("m")) / F.nullif("s", F.lit(0.0))
    verdict = F.when(z.isNull(), "indeterminate").when(z < 2, "no detectable structure").otherwise("structure present")
    return s.select(
        F.lit(observed.clustered_rows).alias("clustered_rows"), F.lit(observed.clusters).alias("clusters"), F.lit(fraud).alias("fraud_rows"), F.round(F.lit(observed.concentration), 4).alias("observed"),
        F.round("m", 4).alias("null_mean"), F.round("s", 4).alias("null_sd"), F.round(z, 2).alias("z_score"), F.round((F.col("k") + 1) / (permutations + 1), 4).alias("p_value"), verdict.alias("verdict"),
    )


def study_summary(runs: DataFrame, keys: tuple[str, ...], metric: str = "value") -> DataFrame:
    """Two arms over repeated runs: means, deviations, the pooled deviation, and the gap in units of it."""
    per = runs.groupBy(*keys).pivot("arm", ["base", "graph"]).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))
    pooled = F.sqrt((F.col("base_sd") ** 2 + F.col("graph_sd") ** 2) / 2)
    gap = F.col("graph_mean") - F.col("base_mean")
    effect = F.abs(gap) / F.nullif(pooled, F.lit(0.0))
    verdict = F.when(effect.isNull() | (effect < 2), "no measurable difference").when(gap > 0, "graph better").otherwise("base better")
    return per.select(*keys, "base_mean", "base_sd", "graph_mean", "graph_sd", gap.alias("gap"), pooled.alias("pooled_sd"), effect.alias("effect"), verdict.alias("verdict"))


def exact_quantiles(long: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(feature, q): the quantiles of each feature's values, interpolated between neighbours, as an array in the order of ``shares``.

    ``long`` has feature and value. Equal values are counted first; the counts
    are ranged by (feature, value) and written, and prefix sums over the ranges
    give every value its place, so no feature's values come together in one
    task. A row per feature and share is broadcast.
    """
    counted = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged, _ = materialise(counted.repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id()), "values")
    per = ranged.groupBy("feature", "part").agg(F.sum("n").alias("n"))
    every = Window.partitionBy("feature")
    base = per.select("feature", "part", F.coalesce(F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("feature", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(base), ["feature", "part"])
    placed = placed.select("feature", "value", (F.col("base") + F.col("upto") - F.col("n")).alias("first"), (F.col("base") + F.col("upto") - 1).alias("last"))
    asked = per.groupBy("feature").agg(F.sum("n").alias("rows")).select("feature", "rows", F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("share")) for i, p in enumerate(shares)))))
    at = F.col("share") * (F.col("rows") - 1)
    asked = asked.select("feature", "i", (at - F.floor(at)).alias("beyond"), F.floor(at).alias("low"), F.ceil(at).alias("high"))
    hit = placed.join(F.broadcast(asked), "feature").where("first <= high and last >= low")
    inside_of = lambda place: F.max(F.when(F.col(place).between(F.col("first"), F.col("last")), F.col("value")))
    each = hit.groupBy("feature", "i", "beyond").agg(inside_of("low").alias("lo"), inside_of("high").alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("beyond")
    return each.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("l")).select("feature", F.transform("l", lambda x: x["v"]).alias("q"))


def corrupt_labels(rows: DataFrame, mode: str, rate: float, seed: int = 42) -> DataFrame:
    """Labels with noise: ``fn_only`` turns the share ``rate`` of the positives to 0, ``symmetric`` flips each with that chance.

    Which rows change depends on a hash of the payment and the seed, not on
    partitions or order. ``fn_only`` takes the positives of the smallest
    hashes, as many as the share says, rounded down.
    """
    if mode not in ("fn_only", "symmetric"):
        raise ValueError(f"unknown mode {mode}")
    h = F.xxhash64("payment_id", F.lit(seed))
    if mode == "symmetric":
        hit = F.pmod(h, F.lit(1_000_000)) < int(rate * 1_000_000)
    else:
        place = F.pmod(h, F.lit(1 << 52)).cast("double")
        marked = rows.where("y = 1").select(F.lit("y").alias("feature"), place.alias("value"))
        n = marked.count()
        k = int(rate * n)
        # the k-th smallest of n values stands at the share (k - 1) / (n - 1)
        last = exact_quantiles(marked, ((k - 1) / max(1, n - 1),)).head()["q"][0] if k else -1.0
        hit = (F.col("y") == 1) & (place <= F.lit(last + 0.5))
    return rows.withColumn("flipped", F.coalesce(hit, F.lit(False))).withColumn("y", F.when(F.col("flipped"), 1 - F.col("y")).otherwise(F.col("y")))
