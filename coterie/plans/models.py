"""The two model arms over the feature blocks, their scores, and what drives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.operators import catalogue, explain, scoring
from coterie.plans.features import GRAPH, TABULAR
from coterie.plans.graph import split_in, table
from coterie.runtime import at_once, materialise
from coterie.sources.contract import CATEGORICAL

#: The features of each reason group.
GROUPS = catalogue.groups([*TABULAR, *GRAPH, *CATEGORICAL])
GRAPH_GROUPS = frozenset(filter(catalogue.from_graph, GROUPS))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feature blocks of every payment with its split, label and maturity, and the source's own columns."""
    p = table(spark, sf_dir, "payments")
    at_once(spark, lambda: table(spark, sf_dir, "tabular"), lambda: table(spark, sf_dir, "graph_block"))
    given = (F.col(c).cast("double").alias(c) for c in p.columns if c.startswith("src_"))
    own = p.select("payment_id", F.col("is_fraud").cast("int").alias("y"), split_in(spark, sf_dir).alias("split"), F.coalesce("label_matured", F.lit(False)).alias("matured"), *given)
    graph = table(spark, sf_dir, "graph_block").select("payment_id", "cluster", *GRAPH)
    return materialise(own.join(table(spark, sf_dir, "tabular"), "payment_id").join(graph, "payment_id", "left"), "matrix")[0]


def inputs(rows: DataFrame) -> dict[str, list[str]]:
    """The numeric columns of each arm; both read what the source gave."""
    base = [*TABULAR, *(c for c in rows.columns if c.startswith("src_"))]
    return {"base": base, "graph": [*base, *GRAPH]}


def arms(rows: DataFrame, iterations: int = 40, positive_weight: float = 6.0, names: tuple[str, ...] = ("base", "graph")) -> tuple[scoring.Arm, ...]:
    """The arms of the given names, trained at once on matured training rows and stopped by matured validation rows."""
    train, held_out = (rows.where((F.col("split") == s) & F.col("matured")) for s in ("train", "val"))
    if not held_out.limit(1).count():
        held_out = None
    columns = inputs(rows)
    return at_once(rows.sparkSession, *(lambda n=n: scoring.train_arm(n, train, columns[n], list(CATEGORICAL), positive_weight, iterations, validation=held_out) for n in names))


def groups_of(rows: DataFrame) -> dict[str, list[str]]:
    """The reason groups of the features in ``rows``."""
    return catalogue.groups([*inputs(rows)["graph"], *CATEGORICAL])


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payment_id, base, graph) of the test payments."""
    rows = matrix(spark, sf_dir)
    base, graph = arms(rows)
    test = base.predict(rows.where("split = 'test'"), "base")
    return graph.predict(test, "graph").select("payment_id", "base", "graph")


def group_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payment_id, group, contribution) of the test payments in the graph arm."""
    rows = matrix(spark, sf_dir)
    (graph,) = arms(rows, names=("graph",))
    honest = rows.where("split = 'train' and y = 0")
    # one row per feature comes to the driver
    reference = {r.feature: r.level if r.level is not None else r.center for r in explain.honest_reference(honest, tuple(inputs(rows)["graph"]), CATEGORICAL, accuracy=10_000).collect()}
    return scoring.occlude(graph, rows.where("split = 'test'"), groups_of(rows), reference)


def alert_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons of every test payment in the graph arm, in words."""
    rows = matrix(spark, sf_dir)
    (graph,) = arms(rows, names=("graph",))
    numeric = tuple(inputs(rows)["graph"])
    reference, _ = materialise(explain.honest_reference(rows.where("split = 'train' and y = 0"), numeric, CATEGORICAL, accuracy=10_000), "reference")
    centers = {r.feature: r.level if r.level is not None else r.center for r in reference.collect()}  # a row per feature
    test = rows.where("split = 'test'")
    contributions, _ = materialise(scoring.occlude(graph, test, groups_of(rows), centers), "occlusion")
    z = explain.robust_z(test, reference, tuple(q.feature for q in catalogue.SENTENCES))
    return explain.narrate(contributions, z, test.select("payment_id", F.col("cluster").isNotNull().alias("clustered")), GRAPH_GROUPS)
