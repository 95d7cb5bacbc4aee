"""The graph tables of a data folder, each written once and shared by the queries that read them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.config import PROFILES, Config, GraphConfig, Profile
from coterie.operators import asof, clusters, communities, components, identity, pointintime
from coterie.runtime import exists, materialise, state
from coterie.sources.contract import canonical, payments, source_of, split_of

CONFIG = Config()
_KEPT: dict[tuple, tuple[DataFrame, str]] = {}
_PROFILES: dict[tuple[str, str], tuple[Profile, GraphConfig]] = {}


def _payments_at(spark: SparkSession, base: str) -> str:
    return canonical(base) if exists(spark, canonical(base)) else f"{base}/payments.parquet"


def profile(spark: SparkSession, base: str) -> tuple[Profile, GraphConfig]:
    """The profile of a folder's source, and the settings of its graph."""
    mark = state(spark, f"{base}/source") if exists(spark, f"{base}/source") else ""
    if (base, mark) not in _PROFILES:
        kind, last = source_of(spark, base)
        of = PROFILES.get(kind, Profile())
        _PROFILES[base, mark] = of, replace(CONFIG.graph, links=of.links, last_as_of=CONFIG.graph.last_as_of if last is None else max(last, CONFIG.graph.first_as_of))
    return _PROFILES[base, mark]


def split_in(spark: SparkSession, base: str, day: str = "day") -> Column:
    """The split of a day by the profile of a folder."""
    return split_of(F.col(day), profile(spark, base)[0].splits)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A graph table, computed on first use in this session, and again if its files are gone."""
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, _payments_at(spark, sf_dir)), name)
    if key not in _KEPT or not exists(spark, _KEPT[key][1]):
        _KEPT[key] = materialise(_MAKE[name](spark, sf_dir), name)
    return _KEPT[key][0]


def _asked(nodes: DataFrame, payments: DataFrame) -> DataFrame:
    """The nodes that some payment of their own day asks for."""
    return nodes.join(payments.selectExpr("day as as_of_day", "customer_id").distinct(), ["as_of_day", "customer_id"], "left_semi")


def _g(spark: SparkSession, base: str) -> GraphConfig:
    return profile(spark, base)[1]


_MAKE = {
    "payments": lambda s, d: payments(s, d),
    "runs": lambda s, d: identity.presence(identity.identifier_pairs(table(s, d, "payments"), _g(s, d).links), _g(s, d)),
    "segments": lambda s, d: identity.user_segments(table(s, d, "runs"), _g(s, d)),
    "nodes": lambda s, d: identity.window_nodes(table(s, d, "payments"), _g(s, d)),
    "weights": lambda s, d: identity.identifier_weights(table(s, d, "segments"), identity.window_sizes(table(s, d, "payments"), _g(s, d)), _g(s, d)),
    "tying": lambda s, d: identity.tying_runs(table(s, d, "runs"), table(s, d, "segments"), _g(s, d)),
    "members": lambda s, d: identity.memberships(table(s, d, "tying"), table(s, d, "weights")),
    "edges": lambda s, d: identity.edges_of_runs(table(s, d, "tying"), table(s, d, "weights"), _g(s, d)),
    "components": lambda s, d: components.connected_components(identity.tie_stars(table(s, d, "members")), table(s, d, "members").count()),
    "component_clusters": lambda s, d: table(s, d, "components").withColumnRenamed("component", "cluster"),
    "communities": lambda s, d: communities.communities(table(s, d, "components"), table(s, d, "edges"), _g(s, d)),
}


def _of(clusters_of: str, prefix: str) -> dict:
    """Everything that is built from a table of clusters, under names with the prefix."""
    t = lambda s, d, name: table(s, d, prefix + name)
    return {
        f"{prefix}cohesion": lambda s, d: clusters.cluster_cohesion(table(s, d, "edges"), table(s, d, clusters_of)),
        f"{prefix}behaviour": lambda s, d: clusters.cluster_behaviour(table(s, d, "payments"), table(s, d, clusters_of), _g(s, d), table(s, d, "runs")),
        f"{prefix}stats": lambda s, d: clusters.cluster_stats(t(s, d, "cohesion"), t(s, d, "behaviour")),
        f"{prefix}votes": lambda s, d: asof.identifier_votes(table(s, d, "members"), table(s, d, clusters_of)),
        f"{prefix}resolved": lambda s, d: asof.resolve(table(s, d, "payments"), table(s, d, clusters_of), t(s, d, "votes"), _g(s, d)),
    }


#: the pipeline's clusters are the communities; whole components stand only in the queries that SQL checks
COMPONENTS, COMMUNITIES = "component_", ""
_MAKE |= _of("component_clusters", COMPONENTS) | _of("communities", COMMUNITIES)
for _p in (COMPONENTS, COMMUNITIES):
    _MAKE[f"{_p}graph_block"] = lambda s, d, p=_p: asof.graph_block(table(s, d, "payments"), table(s, d, f"{p}resolved"), identity.degrees(_asked(table(s, d, "nodes"), table(s, d, "payments")), table(s, d, "edges")), table(s, d, f"{p}stats"))
_MAKE["tabular"] = lambda s, d: pointintime.tabular_features(table(s, d, "payments"))


def clusters_of(spark: SparkSession, sf_dir: str, of: str) -> DataFrame:
    """The components or the communities."""
    return table(spark, sf_dir, "component_clusters" if of == COMPONENTS else "communities")
