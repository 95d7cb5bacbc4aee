"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA


def _text(v):
    return f"{v:.7g}" if isinstance(v, float) else str(v)


def _same(spark, duck, queries, sql, name, folder=DATA):
    got, want = queries[name](spark, folder).toArrow(), duck.execute(sql[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    table = lambda t: Counter(zip(*([_text(v) for v in t.column(c).to_pylist()] for c in cols), strict=True))
    assert table(got) == table(want)


CORE = [n for n in entry.problems.ORACLE | entry.reference.ORACLE]


@pytest.mark.parametrize("name", CORE)
def test_matches_sql(spark, duck, name):
    _same(spark, duck, entry.queries(), entry.oracle_sql(), name)


def test_entry(spark):
    assert entry.entry(spark).columns == ["as_of_day", "src", "dst", "weight"]


@pytest.mark.parametrize("name", ["tabular_features", "graph_features", "louvain_clusters", "evidence_packets", "permutation_test", "merchant_notes"])
def test_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_notes_hold_only_facts(spark):
    assert entry.queries()["merchant_notes"](spark, DATA).where("problems <> ''").count() == 0


@pytest.mark.parametrize("name", ["graph_features", "evidence_packets"])
def test_clusters_of_the_pipeline_are_communities(spark, name):
    q = entry.queries()
    found = q[name](spark, DATA).where("cluster is not null").select("as_of_day", "cluster").distinct()
    assert found.count() > 0
    assert found.join(q["louvain_clusters"](spark, DATA), ["as_of_day", "cluster"], "left_anti").count() == 0


#: Queries that take clusters as they are.
ON_CLUSTERS = ["cluster_cohesion", "cluster_behaviour", "cluster_risk", "identifier_cluster_vote", "asof_cluster_resolution", "component_graph_features", "evidence_members", "evidence_identifiers", "evidence_edges", "component_evidence_packets"]


@pytest.fixture(scope="module")
def split_clusters(spark, duck):
    """A folder name under which the components are replaced by communities that split many of them, also known to DuckDB."""
    from coterie.config import GraphConfig
    from coterie.operators.communities import communities
    from coterie.plans import graph

    folder, made = DATA + "/.", graph._MAKE["component_clusters"]
    loose = GraphConfig(whole_below=3, whole_density=0.99)
    graph._MAKE["component_clusters"] = lambda s, d: communities(graph.table(s, d, "components"), graph.table(s, d, "edges"), loose)
    given = graph.table(spark, folder, "component_clusters")
    assert given.select("as_of_day", "cluster").distinct().count() > graph.table(spark, folder, "components").select("as_of_day", "component").distinct().count()
    duck.register("given", given.toArrow())
    yield folder
    graph._MAKE["component_clusters"] = made


@pytest.mark.parametrize("name", ON_CLUSTERS)
def test_matches_sql_on_split_clusters(spark, duck, split_clusters, name):
    sql = entry.oracle_sql()[name]
    given = sql.replace(entry.reference.FINDS_CLUSTERS, ", clusters as (select as_of_day, customer_id, cluster from given)")
    assert given != sql
    _same(spark, duck, entry.queries(), {name: given}, name, split_clusters)


def test_notes_look_up_their_queue_only(spark, monkeypatch):
    """The notes ask for the z of the queue's payments and the sentences' features, and read as before."""
    from coterie.operators import catalogue, explain
    from coterie.plans import graph, reference

    asked, robust = [], explain.robust_z
    monkeypatch.setattr(explain, "robust_z", lambda rows, ref, numeric: asked.append((rows.count(), numeric)) or robust(rows, ref, numeric))
    notes = {r.payment_id: r.text for r in reference.merchant_notes(spark, DATA).collect()}
    queue = reference.alert_queue(spark, DATA, graph.COMMUNITIES)
    assert set(notes) == {r.payment_id for r in queue.collect()}
    assert asked == [(len(notes), tuple(q.feature for q in catalogue.SENTENCES if q.feature in reference.TABULAR))]
    far = explain.quotes(reference.robust_z(spark, DATA).where("z >= 3")).join(queue, "payment_id", "left_semi").groupBy("payment_id").agg({"z": "max"}).count()
    assert far > 0
    every = explain.quotes(reference.robust_z(spark, DATA).where("z >= 3")).join(queue, "payment_id", "left_semi").orderBy("payment_id", "z").collect()
    furthest = {r.payment_id: r for r in every}
    top = {p: {r.text for r in every if r.payment_id == p and r.z == best.z} for p, best in furthest.items()}
    assert all(any(t in notes[p] for t in texts) for p, texts in top.items())
