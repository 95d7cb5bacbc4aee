"""One group identifier for all records linked directly or through others.

Deterministic Borůvka hooking over pairs: every component selects its smallest
outgoing edge, the trees of selected edges collapse by pointer doubling, edges
are relabelled with the roots and deduplicated, until none remain. Edges are
ordered by their two ends, so the only cycles are pairs that select each
other; there the smaller end becomes the root. Each round at least halves the
components that have edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coterie.runtime import discard, materialise


def star_pairs(uses: DataFrame, most: int = 20) -> DataFrame:
    """Pairs (a, b) that tie the records sharing a value, by a star around the smallest.

    ``uses`` has kind, value, record. Values used by more than ``most``
    different records match nobody. Only the first ``most`` + 1 records of a
    value leave a partition, so a value that stands on a third of all rows is
    recognised without being gathered. Null values and records are left out;
    repeated rows count once.
    """
    distinct = uses.where("kind is not null and value is not null and record is not null").select("kind", "value", "record").distinct()
    by_record = Window.partitionBy("kind", "value").orderBy("record")
    few = distinct.withColumn("rank", F.row_number().over(by_record)).where(F.col("rank") <= most + 1)
    group = Window.partitionBy("kind", "value")
    few = few.withColumn("users", F.max("rank").over(group)).withColumn("a", F.min("record").over(group))
    return few.where((F.col("users") <= most) & (F.col("rank") > 1)).select("a", F.col("record").alias("b"))


def _edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct undirected edges (u < v)."""
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()


def _roots(edges: DataFrame) -> tuple[DataFrame, str]:
    """(c, root) of each component with an edge."""
    ends = F.array(F.struct(F.col("u").alias("c"), F.struct("u", "v").alias("edge")), F.struct(F.col("v").alias("c"), F.struct("u", "v").alias("edge")))
    chosen = edges.select(F.inline(ends)).groupBy("c").agg(F.min("edge").alias("edge"))
    parents, path = materialise(chosen.select("c", F.when(F.col("c") == F.col("edge.u"), F.col("edge.v")).otherwise(F.col("edge.u")).alias("parent")), "hooks")
    # of two that chose each other the smaller is the root
    other = parents.select(F.col("c").alias("parent"), F.col("parent").alias("back"))
    hooked = parents.join(other, "parent", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("parent")), F.col("c")).otherwise(F.col("parent")).alias("parent"))
    old = path
    parents, path = materialise(hooked, "hooks")
    discard(edges.sparkSession, old)
    while True:
        up = parents.select(F.col("c").alias("parent"), F.col("parent").alias("above"))
        twice = parents.join(up, "parent").select("c", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
        old = path
        parents, path = materialise(twice, "hooks")
        moved = parents.where("moved").limit(1).count()
        parents = parents.select("c", "parent")
        discard(edges.sparkSession, old)
        if not moved:
            return parents.withColumnRenamed("parent", "root"), path


def connected_groups(pairs: DataFrame) -> DataFrame:
    """(record, group_id) of every record in some pair; the id is the smallest record of the group.

    Pairs have columns a and b. Pairs with a null end, of a record with itself
    or repeated add nothing, so a record with no other partner has no row; no
    pairs give no rows. All state is in written tables, so lost executors cost
    a retry at most.
    """
    spark = pairs.sparkSession
    edges, path = materialise(_edges(pairs, "a", "b"), "edges")
    rounds: list[DataFrame] = []
    while edges.limit(1).count():
        roots, _ = _roots(edges)
        rounds.append(roots)
        of = lambda end: roots.select(F.col("c").alias(end), F.col("root").alias(f"root_{end}"))
        moved = edges.join(of("u"), "u").join(of("v"), "v")
        old = path
        edges, path = materialise(_edges(moved, "root_u", "root_v"), "edges")
        discard(spark, old)
    if not rounds:
        return edges.select(F.col("u").alias("record"), F.col("v").alias("group_id"))
    # from the last round back, each root is replaced by its root of the later rounds
    final = rounds[-1]
    for roots in reversed(rounds[:-1]):
        later = final.select(F.col("c").alias("root"), F.col("root").alias("later"))
        final = roots.join(later, "root", "left").select("c", F.coalesce("later", "root").alias("root"))
    if len(rounds) > 1:
        final, _ = materialise(final, "roots")
    smallest = final.groupBy("root").agg(F.min("c").alias("group_id"))
    return final.join(smallest, "root").select(F.col("c").alias("record"), "group_id")
