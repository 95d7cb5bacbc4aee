"""Commands: ``python -m coterie.cli COMMAND --data DIR --out DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

STEPS = ("data", "features", "train", "evaluate", "explain", "verify")
EXTRA = ("score", "structure", "seedstudy", "labelnoise", "subgroup", "narrative", "views", "bundle")
#: The most trees of an arm; boosting stops earlier by the validation rows.
MOST_TREES = 400
REPORTS = ("corpus_summary", "link_coverage", "headline", "recall_at_precision", "ablation", "confusion", "per_archetype", "archetype_lift", "fp_composition", "missed_fraud", "novel_vs_seen", "cost_curve", "optimal_threshold", "cost_sensitivity", "cluster_size_buckets")


ARMS = ("base", "graph")


def _write_scores(rows: DataFrame, arms, out: str) -> None:
    from coterie.sources import files

    for arm in arms:
        rows = arm.predict(rows, f"score_{arm.name}")
    files.write_named(rows.select("payment_id", "split", "y", *(f"score_{a}" for a in ARMS)), out, "scores", by=None)


def _scores(spark: SparkSession, data: str, out: str) -> DataFrame:
    """The scores that ``train`` or ``score`` wrote; makes them first where there are none, with the saved arms if there are some."""
    from coterie.runtime import exists
    from coterie.sources import files

    if not exists(spark, f"{out}/scores"):
        if not exists(spark, f"{out}/matrix"):
            run(spark, "features", data, out)
        run(spark, "score" if all(exists(spark, f"{out}/model_{a}") for a in ARMS) else "train", data, out)
    return files.read_named(spark, out, "scores", "train")


def run(spark: SparkSession, command: str, data: str, out: str, source: str = "payments") -> int:
    """Run one command; returns the exit code. ``verify`` and ``narrative`` fail if a check does.

    ``data`` writes the payments of any source to ``out``; all other commands
    read those, or the deliveries in ``data`` where it was not run.
    """
    from pyspark.sql import functions as F

    from coterie.operators import checks, scoring
    from coterie.operators.explain import mask
    from coterie.plans import models, reference, studies
    from coterie.plans.graph import profile, table
    from coterie.runtime import exists, ship
    from coterie.sources import adapters, contract, files

    ship(spark)
    if command == "all":
        return max(run(spark, s, data, out, source) for s in STEPS)
    if command == "data":
        files.write_source(spark, out, source, adapters.write(spark, source, data, out))
        return 0
    base = out if exists(spark, contract.canonical(out)) else data
    scores = _scores(spark, data, out) if command in ("evaluate", "explain", "narrative", "views", "bundle") else None
    q = lambda name: reference.judged(spark, base, name, scores)
    matrix = lambda: files.read_named(spark, out, "matrix", "features")
    if command == "features":
        files.write_named(models.matrix(spark, base), out, "matrix", by="split")
    elif command == "train":
        arms = models.arms(matrix(), iterations=MOST_TREES, positive_weight=profile(spark, base)[0].positive_weight)
        for arm in arms:
            arm.save(f"{out}/model_{arm.name}")
        _write_scores(matrix(), arms, out)
    elif command == "score":
        _write_scores(matrix(), [scoring.Arm.load(f"{out}/model_{a}") for a in ARMS], out)
    elif command == "evaluate":
        for name in REPORTS:
            files.write_report(q(name), out, name)
        files.write_markdown(q("ablation"), out, "ablation_md")
    elif command == "explain":
        files.write_named(q("evidence_packets"), out, "evidence", by=None)
        for name, raw in (("evidence_members", ("customer_id",)), ("evidence_identifiers", ("value",)), ("evidence_edges", ("src", "dst"))):
            files.write_named(q(name).withColumns({c: mask(F.col(c), 3 if c == "value" else 5) for c in raw}), out, name, by=None)
        files.write_report(q("merchant_notes"), out, "notes", "json")
    elif command == "verify":
        t = lambda n: table(spark, base, n)
        report = q("causality_violations").unionByName(checks.outcome_free(t("payments"), t("communities"), profile(spark, base)[1]))
        if exists(spark, f"{out}/matrix"):
            report = report.unionByName(studies.shuffled_label_check(matrix()).selectExpr("'shuffled labels are learned' as `check`", "cast(not passed as bigint) as violations", "cast(1 as bigint) as rows"))
        files.write_report(report, out, "verification")
        done = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/verification")
        return 1 if done.where("violations > 0 and `check` <> 'clock after day'").limit(1).count() else 0
    elif command == "structure":
        files.write_report(q("permutation_test"), out, "structure_test")
    elif command in ("seedstudy", "labelnoise", "subgroup"):
        study = {"seedstudy": studies.seed_study, "labelnoise": studies.label_noise, "subgroup": studies.subgroup}[command]
        files.write_report(study(matrix()), out, command)
    elif command == "narrative":
        notes = q("merchant_notes")
        files.write_report(notes, out, "notes", "json")
        return 1 if notes.where("problems <> ''").limit(1).count() else 0
    elif command in ("views", "bundle"):
        from coterie.plans import views

        every = views.every(spark, base, scores)
        if command == "bundle":
            files.write_bundle(every, out, "bundle")
        else:
            for name, df in every.items():
                files.write_report(df, out, f"view_{name}", "json")
    else:
        raise ValueError(f"unknown command {command!r}")
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="coterie", description=__doc__)
    p.add_argument("command", choices=(*STEPS, *EXTRA, "all"))
    p.add_argument("--data", default="", help="folder of the source tables")
    p.add_argument("--out", required=True, help="folder for results")
    p.add_argument("--source", default="payments", help="kind of source")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("coterie").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(spark, a.command, a.data, a.out, a.source)


if __name__ == "__main__":
    raise SystemExit(main())
