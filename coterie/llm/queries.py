"""Queries p3, p7, p8, p9 and p10 over the tables of TESTDATA.md, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.clean import PREFIX, code, identifier_body
from coterie.llm import abuse, distinct_runs, leaks, match_groups, tokenise
from coterie.plans.problems import VALID, sql_code, sql_identifier
from coterie.runtime import materialise, spread, state
from coterie.sources.payments import read_table, valid_payments

COUNTED = ("card_fingerprint", "device_fingerprint", "shipping_address_hash", "customer_id")


def runs(spark: SparkSession, sf_dir: str, days: str = "true", more_bits: int = 0) -> DataFrame:
    """The stored runs of the four identifiers by day, method and city, of the days that fulfil a condition."""
    payments = read_table(spark, sf_dir, "payments")
    columns = {c: identifier_body(c) if c in PREFIX else F.col(c) for c in COUNTED} | {"day": F.col("day"), "method": code("method"), "city": F.col("city")}
    fields = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(c).alias("id")) for i, c in enumerate(COUNTED)))
    ids = valid_payments(payments, columns).where(days).select(F.inline(fields), "day", "method", "city")
    return distinct_runs.build_runs(ids, distinct_runs.hash_bits(payments.count()) + more_bits)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("field", F.element_at(F.array(*map(F.lit, COUNTED)), F.col("field") + 1))


def p3_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of each field for all combinations of day, method and city."""
    stored, _ = materialise(runs(spark, sf_dir), "runs")
    return _named(distinct_runs.with_error(distinct_runs.distinct_counts(stored)))


def p3_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two stores, of the first half of the days and of the rest, the later one in more buckets, merged."""
    early, _ = materialise(runs(spark, sf_dir, "day < 75"), "runs")
    late, _ = materialise(runs(spark, sf_dir, "day >= 75 or day is null", 1), "runs")
    merged, _ = materialise(distinct_runs.merge_stores(early, late), "runs")
    return _named(distinct_runs.with_error(distinct_runs.distinct_counts(merged)))


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable form: delta-coded runs of the finest groups."""
    return _named(runs(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"customer_id": F.col("customer_id"), "card": identifier_body("card_fingerprint"), "address": identifier_body("shipping_address_hash")}
    p = valid_payments(read_table(spark, sf_dir, "payments"), columns)
    kinds = F.array(*(F.struct(F.lit(k).cast("tinyint").alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("card", "address"))))
    pairs = match_groups.star_pairs(p.select(F.inline(kinds), F.col("customer_id").alias("record")))
    return match_groups.connected_groups(pairs).select(F.col("record").alias("customer_id"), "group_id")


def p8_ids(spark: SparkSession, sf_dir: str, vocabulary: str = tokenise.VOCABULARY) -> DataFrame:
    """The ids of every document by the vocabulary in a rank file, which all executors can read."""
    return tokenise.encode_texts(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), vocabulary)


def p9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items with a seed hit: the longest equal run and the overlap with substitutions."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leaks.leaked_items(docs, read_table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_overlaps(spark, sf_dir).where("longest >= 8").select("doc_id", "item_id")


#: The last fitted scorer, with the application and the files it was fitted on: three queries ask for the same.
_FITTED: dict[tuple, abuse.Scorer] = {}


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, score) of every document, by a model of the folder's own texts and labels."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    key = (spark.sparkContext.applicationId, sf_dir, *(state(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = abuse.fit(spread(docs), read_table(spark, sf_dir, "labels"))
    return abuse.score_documents(spread(docs), _FITTED[key], ("doc_id", "source"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where(F.col("score") >= abuse.CASE).select("doc_id")


def p10_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the documents, those of the kind, and the rate."""
    found = F.col("score") >= abuse.CASE
    return scores(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(found).alias("found"), F.avg(found.cast("double")).alias("rate"))


QUERIES = {f.__name__: f for f in (p3_distinct, p3_merged, p3_runs, p7_found, p8_ids, p9_found, p9_overlaps, p10_found, p10_scores, p10_source_rates)}

_IDS = " union all ".join(f"select '{c}' as field, {sql_identifier(c) if c in PREFIX else c} as id, \"day\", {sql_code('method')} as method, city from valid" for c in COUNTED)

_COUNTS = f"""with {VALID}, ids as ({_IDS}),
counts as (select field, array_to_string([x for x in [case when grouping("day") = 0 then 'day' end, case when grouping(method) = 0 then 'method' end, case when grouping(city) = 0 then 'city' end] if x is not null], '+') as g,
  "day", method, city, count(distinct id) as n from ids where id is not null group by field, cube ("day", method, city))
select field, case when g = '' then 'all' else g end as grouping, "day", method, city, n, n::double * (n - 1) / power(2, 65) as error_bound from counts"""

ORACLE = {
    "p3_distinct": _COUNTS,
    "p3_merged": _COUNTS,
    "p7_found": f"""with recursive {VALID},
uses as (select distinct kind, value, customer_id from (select 'card' as kind, {sql_identifier('card_fingerprint')} as value, customer_id from valid union all select 'address', {sql_identifier('shipping_address_hash')}, customer_id from valid) where value is not null),
few as (select *, count(*) over (partition by kind, value) as users, min(customer_id) over (partition by kind, value) as first from uses),
ends as (select first as a, customer_id as b from few where users between 2 and 20 and first <> customer_id),
edges as (select a, b from ends union select b, a from ends),
reach as (select a, b from edges union select r.a, e.b from reach r join edges e on e.a = r.b)
select a as customer_id, least(a, min(b)) as group_id from reach group by a""",
}
