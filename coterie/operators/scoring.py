"""Model matrix, two boosted-tree arms, and group occlusion."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coterie.operators.checks import assert_allowed
from coterie.runtime import discard, materialise

NONE, OTHER = "__none__", "__other__"
MISSING = -999.0


def category_vocab(train: DataFrame, columns: tuple[str, ...], most: int = 254) -> DataFrame:
    """(feature, level, n, rank) of the most frequent levels of each column, from training rows only; null is a level."""
    levels = train.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(NONE)).alias("level")) for c in columns))))
    counted = levels.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "level"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most)


@dataclass
class Arm:
    """A trained arm with its columns and vocabulary."""

    name: str
    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    levels: dict[str, list[str]]

    def prepare(self, df: DataFrame) -> DataFrame:
        """The arm's inputs: missing numbers as a sentinel, unknown levels as 'other'."""
        out = {c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(MISSING)) for c in self.numeric}
        for c in self.categorical:
            level = F.coalesce(F.col(c), F.lit(NONE))
            out[c] = F.when(level.isin(self.levels[c]), level).otherwise(OTHER)
        return df.withColumns(out)

    def predict(self, df: DataFrame, score: str = "score") -> DataFrame:
        """``df`` with the probability of fraud."""
        raw = self.model.transform(self.prepare(df))
        done = raw.withColumn(score, vector_to_array("probability")[1])
        return done.drop("features", "rawPrediction", "probability", "prediction", *(f"{c}_ix" for c in self.categorical))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        about = json.dumps({"name": self.name, "numeric": self.numeric, "categorical": self.categorical, "levels": self.levels})
        SparkSession.active().createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/arm")

    @staticmethod
    def load(path: str) -> Arm:
        """An arm that was saved."""
        about = json.loads(SparkSession.active().read.text(f"{path}/arm").head()[0])
        return Arm(about["name"], PipelineModel.load(f"{path}/model"), about["numeric"], about["categorical"], about["levels"])


def train_arm(name: str, train: DataFrame, numeric: list[str], categorical: list[str], positive_weight: float = 6.0, iterations: int = 40, depth: int = 5, seed: int = 42, validation: DataFrame | None = None, step: float = 0.1) -> Arm:
    """Boosted trees on ``train``, whose column ``y`` is the label. Forbidden columns raise an error.

    Each tree sees four fifths of the rows, which ones depends on the seed. With
    ``validation`` rows boosting stops as soon as a tree no longer lowers their
    loss by a hundredth; ``iterations`` is the most trees then. The vocabulary
    has at most 254 levels per column and goes to the driver.
    """
    assert_allowed([*numeric, *categorical])
    levels: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        for r in category_vocab(train, tuple(categorical)).orderBy("feature", "rank").collect():
            levels[r.feature].append(r.level)
    arm = Arm(name, None, numeric, categorical, levels)
    columns = [*numeric, *categorical, "y"]
    rows = train.select(*columns, F.lit(False).alias("held_out"))
    if validation is not None:
        rows = rows.unionByName(validation.select(*columns, F.lit(True).alias("held_out")))
    ready = arm.prepare(rows).withColumn("weight", F.when(F.col("y") == 1, positive_weight).otherwise(1.0)).withColumn("label", F.col("y").cast("double"))
    indexers = [StringIndexerModel.from_labels([*levels[c], OTHER], inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep") for c in categorical]
    assembler = VectorAssembler(inputCols=[*numeric, *(f"{c}_ix" for c in categorical)], outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=iterations, maxDepth=depth, stepSize=step, maxBins=max(64, *(len(v) + 3 for v in levels.values())) if levels else 64, subsamplingRate=0.8, seed=seed)
    if validation is not None:
        gbt = gbt.setValidationIndicatorCol("held_out")
    # boosting reads its rows several times: they are put together once
    put = PipelineModel([*indexers, assembler])
    vectors, path = materialise(put.transform(ready).select("features", "label", "weight", "held_out"), f"vectors_{name}")
    try:
        arm.model = PipelineModel([*indexers, assembler, gbt.fit(vectors)])
    finally:
        discard(rows.sparkSession, path)
    return arm


def _tree(root) -> tuple[list[tuple], list[float]]:
    """A tree's nodes as (feature, threshold or None, categories that go left, left, right) and the values at them; a leaf's feature is -1."""
    nodes, values, todo = [], [], [(root, None, 0)]
    while todo:
        node, parent, side = todo.pop()
        at = len(nodes)
        if parent is not None:
            nodes[parent][3 + side] = at
        values.append(node.prediction())
        if node.getClass().getSimpleName() == "LeafNode":
            nodes.append([-1, None, None, at, at])
            continue
        split = node.split()
        numeric = split.getClass().getSimpleName() == "ContinuousSplit"
        nodes.append([split.featureIndex(), split.threshold() if numeric else None, None if numeric else [int(x) for x in split.leftCategories()], at, at])
        todo += [(node.leftChild(), at, 0), (node.rightChild(), at, 1)]
    return [tuple(n) for n in nodes], values


def _walk(tree: tuple[list[tuple], list[float]], columns: list[np.ndarray], n: int) -> np.ndarray:
    """What a tree says of ``n`` rows, given by column."""
    nodes, values = tree
    out, todo = np.empty(n), [(0, np.arange(n))]
    while todo:
        at, rows = todo.pop()
        feature, threshold, left, a, b = nodes[at]
        if feature < 0:
            out[rows] = values[at]
        elif rows.size:
            x = columns[feature][rows]
            goes = x <= threshold if left is None else np.isin(x, left)
            todo += [(a, rows[goes]), (b, rows[~goes])]
    return out


def occlude(arm: Arm, rows: DataFrame, groups: dict[str, list[str]], reference: dict[str, float | str]) -> DataFrame:
    """(payment_id, group, contribution): how much the score falls when a group takes honest values.

    Rows are read once, in Arrow batches. For a group only the trees that ask
    for one of its features are walked again; where no tree does, the
    contribution is 0.
    """
    inputs = [*arm.numeric, *arm.categorical]
    used = {g: [c for c in cols if c in inputs] for g, cols in groups.items()}
    used = {g: [c for c in cols if c in reference] for g, cols in used.items() if cols}
    place = {c: i for i, c in enumerate(inputs)}
    levels = {c: [*arm.levels[c], OTHER] for c in arm.categorical}
    model = arm.model.stages[-1]
    trees, weights = [_tree(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights)
    honest = {c: float(levels[c].index(reference[c] if reference[c] in levels[c] else OTHER)) if c in levels else float(reference[c]) for c in reference if c in place}
    asks = [{n[0] for n in nodes} for nodes, _ in trees]
    again = {g: [i for i, of in enumerate(asks) if of & {place[c] for c in cols}] for g, cols in used.items()}
    names = list(used)

    def score(said: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * sum(w * x for w, x in zip(weights, said, strict=True))))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            columns = []
            for c in inputs:
                values = batch.column(batch.schema.get_field_index(c))
                if c in levels:
                    values = pc.index_in(values, pa.array(levels[c]))
                columns.append(values.to_numpy(zero_copy_only=False).astype("float64"))
            said = [_walk(t, columns, n) for t in trees]
            whole = score(said)
            falls = np.zeros((n, len(names)))
            for k, g in enumerate(names):
                if again[g]:
                    swapped, other = list(columns), list(said)
                    for c in used[g]:
                        swapped[place[c]] = np.full(n, honest[c])
                    for i in again[g]:
                        other[i] = _walk(trees[i], swapped, n)
                    falls[:, k] = whole - score(other)
            ids = batch.column(batch.schema.get_field_index("payment_id"))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(n), len(names)))), pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(len(names)), n))), pa.array(falls.ravel())], names=["payment_id", "group", "contribution"])

    return arm.prepare(rows).select("payment_id", *inputs).mapInArrow(run, "payment_id string, `group` string, contribution double")
