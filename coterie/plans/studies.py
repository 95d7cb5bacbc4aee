"""Repeated training: over seeds, over noisy labels, over cluster sizes, over shuffled labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.operators import evaluation, scoring
from coterie.plans.models import inputs
from coterie.runtime import materialise
from coterie.sources.contract import CATEGORICAL


def _scored(rows: DataFrame, train: DataFrame, seed: int, iterations: int) -> DataFrame:
    """Test rows with the score of both arms, in long form."""
    test = rows.where("split = 'test'")
    for name, cols in inputs(rows).items():
        test = scoring.train_arm(name, train, cols, list(CATEGORICAL), iterations=iterations, seed=seed).predict(test, name)
    return test.select("payment_id", "y", "amount", "cl_customers", F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(a).alias("score")) for a in ("base", "graph")))))


def seed_study(rows: DataFrame, seeds: tuple[int, ...] = (11, 23, 42, 77, 101), iterations: int = 20) -> DataFrame:
    """Average precision of both arms over seeds. ``rows`` is the written model matrix."""
    train = rows.where("split = 'train' and matured")
    runs = [evaluation.average_precision(_scored(rows, train, s, iterations)).select(F.lit(s).alias("seed"), "arm", F.col("pr_auc").alias("value"), F.lit("pr_auc").alias("metric")) for s in seeds]
    return evaluation.study_summary(reduce(DataFrame.unionByName, runs), ("metric",))


def label_noise(rows: DataFrame, seeds: tuple[int, ...] = (11, 42, 101), rates: tuple[float, ...] = (0.0, 0.05, 0.10, 0.20), iterations: int = 20) -> DataFrame:
    """Average precision of both arms trained on corrupted labels, judged on clean ones."""
    train = rows.where("split = 'train' and matured")
    runs = []
    for mode in ("fn_only", "symmetric"):
        for rate in rates:
            for s in seeds:
                scored = _scored(rows, evaluation.corrupt_labels(train, mode, rate, s), s, iterations)
                runs.append(evaluation.average_precision(scored).select(F.lit(mode).alias("mode"), F.lit(rate).alias("rate"), "arm", F.col("pr_auc").alias("value")))
    return evaluation.study_summary(reduce(DataFrame.unionByName, runs), ("mode", "rate"))


def subgroup(rows: DataFrame, seeds: tuple[int, ...] = (11, 23, 42), iterations: int = 20, least: int = 20) -> DataFrame:
    """Average precision of both arms by cluster size; buckets with fewer than ``least`` frauds are left out."""
    train = rows.where("split = 'train' and matured")
    runs = []
    for s in seeds:
        scored = _scored(rows, train, s, iterations).withColumn("bucket", evaluation.size_bucket(F.col("cl_customers")))
        keep = scored.where("arm = 'base'").groupBy("bucket").agg(F.sum("y").alias("f")).where(F.col("f") >= least).select("bucket")
        each = scored.join(F.broadcast(keep), "bucket").withColumn("arm", F.concat_ws("|", "arm", "bucket"))  # at most five buckets
        ap = evaluation.average_precision(each)
        runs.append(ap.select(F.split("arm", r"\|")[0].alias("arm"), F.split("arm", r"\|")[1].alias("bucket"), F.col("pr_auc").alias("value")))
    return evaluation.study_summary(reduce(DataFrame.unionByName, runs), ("bucket",))


def shuffled_label_check(rows: DataFrame, seed: int = 42, iterations: int = 20, limit: float = 1.6, orders: int = 12) -> DataFrame:
    """Trained on labels dealt out at random, the graph arm must do no better than chance: (pr_auc, base_rate, chance, passed).

    Labels are dealt by a hash, with the share of positives of the data. It
    passes below ``limit`` times the base rate, or within three deviations of
    what random orders of the same test rows reach: with few positives chance
    alone goes beyond the limit.
    """
    train = rows.where("split = 'train' and matured")
    share = train.agg(F.avg("y")).head()[0] or 0.0
    dealt = train.withColumn("y", (F.pmod(F.xxhash64("payment_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).cast("int"))
    scored, _ = materialise(_scored(rows, dealt, seed, iterations).where("arm = 'graph'").select("payment_id", "arm", "y", "score", "amount"), "dealt")
    luck = scored.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(orders)))).select("y", "amount", F.col("k").cast("string").alias("arm"), F.xxhash64("payment_id", "k").cast("double").alias("score"))
    chance = evaluation.average_precision(luck).agg((F.avg("pr_auc") + 3 * F.coalesce(F.stddev_samp("pr_auc"), F.lit(0.0))).alias("chance"))
    head = evaluation.headline(scored).join(F.broadcast(chance))  # one row each
    return head.select("pr_auc", "base_rate", "chance", ((F.col("pr_auc") / F.col("base_rate") < limit) | (F.col("pr_auc") <= F.col("chance"))).alias("passed"))
