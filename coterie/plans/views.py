"""Read-only views over the results: summary, alerts, one alert, rings, what-if.

Each is a DataFrame. No view shows a raw identifier. ``scores`` is the table of
trained scores, as in ``reference.scored``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.operators import explain
from coterie.plans import reference
from coterie.plans.graph import COMMUNITIES

RING_TYPES = ("card_testing", "refund_abuse", "bust_out")
MOST_ALERTS, MOST_RINGS = 400, 100


def summary(spark: SparkSession, sf_dir: str, scores: DataFrame | None = None) -> dict[str, DataFrame]:
    """The result tables by name."""
    names = ("corpus_summary", "link_coverage", "headline", "confusion", "ablation", "per_archetype", "fp_composition", "missed_fraud", "optimal_threshold", "causality_violations")
    return {n: reference.judged(spark, sf_dir, n, scores) for n in names}


def alerts(spark: SparkSession, sf_dir: str, verdict: str = "", limit: int = 50, scores: DataFrame | None = None) -> DataFrame:
    """The queue, by exposure; ``verdict`` is fraud, honest, graph_only, graph_backed or a ring type. Others filter nothing."""
    rows = reference.alert_queue(spark, sf_dir, COMMUNITIES, scores)
    kinds = {"fraud": "is_fraud", "honest": "not is_fraud", "graph_only": "score >= 0.99 and baseline_score < 0.99", "graph_backed": "g_in_cluster > 0", **{t: f"ring_type = '{t}'" for t in RING_TYPES}}
    if verdict in kinds:
        rows = rows.where(kinds[verdict])
    return rows.drop("y").orderBy(F.desc("exposure"), "payment_id").limit(min(limit, MOST_ALERTS))


def alert_detail(spark: SparkSession, sf_dir: str, payment_id: str, scores: DataFrame | None = None) -> DataFrame:
    """One alert with its masked evidence and its note; no row for an unknown payment."""
    one = lambda df: df.where(F.col("payment_id") == payment_id)
    row = one(reference._alerts(spark, sf_dir, COMMUNITIES, scores)).drop("y")
    details = (q(spark, sf_dir, COMMUNITIES) for q in (reference.evidence_members, reference.evidence_identifiers, reference.evidence_edges))
    nested = explain.nested_evidence(one(reference.evidence_packets(spark, sf_dir)), *details)
    evidence = nested.select("payment_id", F.struct(*(c for c in nested.columns if c not in ("payment_id", "cluster"))).alias("evidence"))
    note = one(reference.merchant_notes(spark, sf_dir, scores)).select("payment_id", F.col("text").alias("note"))
    return row.join(evidence, "payment_id", "left").join(note, "payment_id", "left")


def rings(spark: SparkSession, sf_dir: str, limit: int = 25, scores: DataFrame | None = None) -> DataFrame:
    """Clusters by the money at risk; the cluster's name is masked."""
    from coterie.operators.explain import mask

    return reference.ring_leaderboard(spark, sf_dir, COMMUNITIES, scores).withColumn("cluster", mask(F.col("cluster"), 5)).orderBy(F.desc("exposure")).limit(min(limit, MOST_RINGS))


def whatif(spark: SparkSession, sf_dir: str, payment_id: str, scores: DataFrame | None = None) -> DataFrame:
    """The scores of one payment with and without the graph."""
    return reference.whatif(spark, sf_dir, scores).where(F.col("payment_id") == payment_id)


def health(spark: SparkSession, sf_dir: str, scores: DataFrame | None = None) -> DataFrame:
    """One row: the number of alerts that can be shown, and whether there are any."""
    n = F.count(F.lit(1))
    return reference.alert_queue(spark, sf_dir, COMMUNITIES, scores).agg(F.when(n > 0, "ok").otherwise("empty").alias("status"), n.alias("alerts"))


def every(spark: SparkSession, sf_dir: str, scores: DataFrame | None = None) -> dict[str, DataFrame]:
    """All views but those of one payment, by name."""
    return {
        "health": health(spark, sf_dir, scores), "alerts": alerts(spark, sf_dir, limit=MOST_ALERTS, scores=scores), "rings": rings(spark, sf_dir, MOST_RINGS, scores),
        **summary(spark, sf_dir, scores),
    }


VIEWS = {"health": health, "alerts": alerts, "alert": alert_detail, "rings": rings, "whatif": whatif}
