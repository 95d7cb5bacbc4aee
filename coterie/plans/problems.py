"""Queries p1, p2, p4, p5 and p6 over the tables of TESTDATA.md, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.clean import PREFIX, SPACE, account_age, code, identifier_body, identifier_pattern
from coterie.operators import as_known, entity_features, hot_keys, late_events, rolling
from coterie.runtime import materialise, named_path
from coterie.sources.payments import read_table, valid_payments

DAYS = 150


def event_type() -> Column:
    """status:method:band; a missing status or method is called 'unknown'."""
    age = account_age()
    band = F.when(age < 30, "new").when(age < 180, "mid").otherwise("old")
    return F.concat_ws(":", F.coalesce(code("status"), F.lit("unknown")), F.coalesce(code("method"), F.lit("unknown")), band)


def feature_store(spark: SparkSession, sf_dir: str) -> tuple[entity_features.FeatureStore, DataFrame]:
    """The refreshed store of a data folder, and its events."""
    events = read_table(spark, sf_dir, "payments").select(
        F.col("payment_id").alias("event_id"), F.col("customer_id").alias("entity"), event_type().alias("event_type"), "day", "amount", F.col("src_received_at").alias("received_at")
    )
    store = entity_features.FeatureStore(spark, named_path(spark, "features-2", sf_dir))
    store.refresh(events)
    return store, events


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = feature_store(spark, sf_dir)[0].features()
    return cells.where("n >= 3 and total >= 500000 and last_day >= 120").select(F.col("entity").alias("customer_id"), "event_type")


def p1_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of days 20 to 139: three stored buckets and the days at both ends."""
    store, events = feature_store(spark, sf_dir)
    return store.features(20, 140, events).withColumnRenamed("entity", "customer_id")


def p1_entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer; ``features`` lists type=count/last day/total."""
    rows = entity_features.one_row_per_entity(feature_store(spark, sf_dir)[0].features())
    text = F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), F.concat_ws("/", e["value"]["n"], e["value"]["last_day"], e["value"]["total"].cast("bigint"))))
    return rows.select(F.col("entity").alias("customer_id"), F.array_join(text, ";").alias("features"), F.col("n").alias("payments"), "last_day", "total")


def outcome_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payment_id, key, event_day, known_day, amount) of refunds, disputes and declines, written once."""
    columns = {c: F.col(c) for c in ("day", "amount", "refund_day", "dispute_day", "label_available_day")} | {"failed": code("status") == "failed"}
    p = valid_payments(read_table(spark, sf_dir, "payments"), columns)
    outcome = lambda name, day, when: F.struct(F.lit(name).alias("key"), F.when(when, F.col(day)).alias("event_day"))
    kinds = F.array(outcome("refund", "refund_day", F.col("refund_day") >= 0), outcome("dispute", "dispute_day", F.col("dispute_day") >= 0), outcome("decline", "day", F.col("failed")))
    events = p.select("payment_id", F.inline(kinds), F.col("label_available_day").alias("known_day"), "amount").where("event_day is not null")
    return materialise(events, "outcomes")[0]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = late_events.judged_events(outcome_events(spark, sf_dir))
    return judged.where(F.col("verdict") != late_events.ON_TIME).select("payment_id", F.col("key").alias("outcome"), "period", "verdict")


def p2_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected weekly totals per outcome."""
    totals = late_events.period_totals(late_events.cells_of(outcome_events(spark, sf_dir)))
    return totals.withColumnRenamed("key", "outcome")


KEY_FIELDS = ("shipping_address_hash", "device_fingerprint", "ip")


def key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-key results of the three fields; the field is its place in KEY_FIELDS."""
    columns = {c: identifier_body(c) if c in PREFIX else F.col(c) for c in KEY_FIELDS} | {"created_at": F.col("created_at"), "amount": F.col("amount"), "tie": F.xxhash64("payment_id")}
    p = valid_payments(read_table(spark, sf_dir, "payments"), columns).withColumnRenamed("created_at", "at").drop("payment_id")
    fields = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(c).alias("key_value")) for i, c in enumerate(KEY_FIELDS)))
    # a payment is ranged once, with all its keys
    return hot_keys.per_key(hot_keys.input_partitions(p).select("part", F.inline(fields), "at", "tie", "amount"), ranged=True)


def named_keys(keys: DataFrame) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, KEY_FIELDS)), F.col("field") + 1)
    prefix = F.element_at(F.array(*(F.lit(f"{PREFIX[c]}_" if c in PREFIX else "") for c in KEY_FIELDS)), F.col("field") + 1)
    return keys.withColumn("key_value", F.concat(prefix, "key_value")).withColumn("field", name)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, _ = materialise(key_results(spark, sf_dir).select("field", "key_value", "n"), "keys")
    totals = keys.groupBy("field").agg(F.sum("n").alias("all_n"))
    hot = keys.join(F.broadcast(totals), "field").where("key_value is not null and n * 50 >= all_n")  # a row per field
    return named_keys(hot).select("field", "key_value")


def p4_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, amount, first and last second and longest pause of every value."""
    keys = key_results(spark, sf_dir).where("key_value is not null")
    return named_keys(keys).select("field", "key_value", "n", "total", "first_at", "last_at", "max_gap")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {c: F.col(c) for c in ("customer_id", "day", "created_at", "is_fraud", "label_available_day")}
    p, _ = materialise(valid_payments(read_table(spark, sf_dir, "payments"), columns), "payments")
    events = p.select(F.col("payment_id").alias("event_id"), F.col("customer_id").alias("entity"), F.col("day").alias("x"), F.col("created_at").alias("y"))
    graph = read_table(spark, sf_dir, "graph_features").select(F.col("customer_id").alias("entity"), F.col("as_of_day").alias("x"), F.col("created_at").alias("y"), F.col("snapshot_id").alias("ref"))
    fraud = p.where("is_fraud").select(F.col("customer_id").alias("entity"), F.col("label_available_day").alias("x"), F.col("created_at").alias("y"), F.col("payment_id").alias("ref"))
    feeds = [as_known.Feed("snapshot", graph, strict=False, by_x=True), as_known.Feed("known_fraud", fraud, strict=True, by_x=False)]
    found = as_known.attributes_as_known(events, feeds)
    return found.select(F.col("event_id").alias("payment_id"), F.col("feed").alias("kind"), "ref_id")


ROLLING_FIELDS = ("device_fingerprint", "card_fingerprint", "customer_id")


def rolling_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {c: identifier_body(c) if c in PREFIX else F.col(c) for c in ROLLING_FIELDS} | {"day": F.floor(F.col("created_at") / 86400).cast("int"), "amount": F.col("amount")}
    p = valid_payments(read_table(spark, sf_dir, "payments"), columns)
    fields = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(c).alias("entity")) for i, c in enumerate(ROLLING_FIELDS)))
    return rolling.trailing_segments(p.select(F.inline(fields), "day", "amount"), 0, DAYS - 1)


def named_entities(rows: DataFrame) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ROLLING_FIELDS)), F.col("field") + 1)
    prefix = F.element_at(F.array(*(F.lit(f"{PREFIX[c]}_" if c in PREFIX else "") for c in ROLLING_FIELDS)), F.col("field") + 1)
    return rows.withColumn("entity_type", name).withColumn("entity", F.concat(prefix, "entity")).drop("field")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = rolling_segments(spark, sf_dir).where("n_7 >= 15 and total_30 >= 100000")
    return rolling.each_day(named_entities(busy)).select("entity_type", "entity", "day")


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing totals and averages of every entity and day, in segments of days with equal ones.

    An entity's segments cover all days from its first payment to the last day
    of the table, days without payments included.
    """
    seg = rolling.trailing_averages(named_entities(rolling_segments(spark, sf_dir)))
    return seg.select("entity_type", "entity", "day_from", "day_to", "n_7", "total_7", "avg_7", "n_30", "total_30", "avg_30")


def p6_day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing totals and averages in a row per entity and day, from its first payment on, inactive days included."""
    return rolling.each_day(p6_totals(spark, sf_dir))


def p6_entity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity the peaks of its trailing totals and their means over all days, with or without payments."""
    seg = named_entities(rolling_segments(spark, sf_dir))
    days = (F.col("day_to") - F.col("day_from") + 1).cast("double")
    mean = lambda w: (F.sum(F.col(f"total_{w}") * days) / DAYS / w).alias(f"mean_avg_{w}")
    return seg.groupBy("entity_type", "entity").agg(
        F.sum(F.when(F.col("n_30") > 0, days).otherwise(0.0)).cast("int").alias("days_with_activity_30"), F.max("n_7").alias("peak_n_7"), F.max("total_7").alias("peak_total_7"), F.max("n_30").alias("peak_n_30"), F.max("total_30").alias("peak_total_30"), mean(7), mean(30)
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_window_features, p1_entity_rows, p2_found, p2_weekly, p4_found, p4_key_stats, p5_found, p6_found, p6_totals, p6_day_totals, p6_entity_totals)}

# ---- the same queries in SQL ----

VALID = "valid as (select * from payments where payment_id is not null qualify row_number() over (partition by payment_id order by src_received_at desc) = 1)"


def sql_code(col: str) -> str:
    return f"lower(regexp_replace({col}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))"


def sql_identifier(col: str) -> str:
    return f"case when regexp_matches({col}, '{identifier_pattern(PREFIX[col])}') then '{PREFIX[col]}_' || regexp_extract({col}, '{identifier_pattern(PREFIX[col])}', 1) end"


TYPE_SQL = f"coalesce({sql_code('status')}, 'unknown') || ':' || coalesce({sql_code('method')}, 'unknown') || ':' || case when greatest(\"day\" - signup_day, 0) < 30 then 'new' when greatest(\"day\" - signup_day, 0) < 180 then 'mid' else 'old' end"


def cells_sql(where: str = "") -> str:
    return f"with {VALID}, cells as (select customer_id, {TYPE_SQL} as event_type, count(*) as n, max(\"day\") as last_day, sum(amount) as total from valid {where} group by 1, 2)"


OUTCOMES_SQL = f"""with {VALID}, outcomes as (
  select payment_id, 'refund' as outcome, refund_day as d, label_available_day as known, amount from valid where refund_day >= 0
  union all select payment_id, 'dispute', dispute_day, label_available_day, amount from valid where dispute_day >= 0
  union all select payment_id, 'decline', "day", label_available_day, amount from valid where {sql_code("status")} = 'failed'),
judged as (select *, d // 7 as period, known - (d // 7 * 7 + 6) as over from outcomes)"""
KEYS_SQL = f"with {VALID}, vals as (" + " union all ".join(f"select '{c}' as field, {sql_identifier(c) if c in PREFIX else c} as key_value, created_at, payment_id, amount from valid" for c in KEY_FIELDS) + ")"
ENTITY_SQL = f"with {VALID}, vals as (" + " union all ".join(f"select '{c}' as entity_type, {sql_identifier(c) if c in PREFIX else c} as entity, created_at // 86400 as \"day\", amount from valid" for c in ROLLING_FIELDS) + f"""),
daily as (select entity_type, entity, "day", count(*) as n, sum(amount) as amount from vals where entity is not null group by all),
days as (select distinct d.entity_type, d.entity, d."day" + k as "day" from daily d, range(30) t(k) where d."day" + k < {DAYS}),
totals as (select s.entity_type, s.entity, s."day"::int as "day",
  sum(case when d."day" > s."day" - 7 then d.n else 0 end)::bigint as n_7, sum(case when d."day" > s."day" - 7 then d.amount else 0 end) as total_7, sum(d.n)::bigint as n_30, sum(d.amount) as total_30
  from days s join daily d on d.entity_type = s.entity_type and d.entity = s.entity and d."day" between s."day" - 29 and s."day" group by all)"""

ORACLE = {
    "p1_found": cells_sql() + " select customer_id, event_type from cells where n >= 3 and total >= 500000 and last_day >= 120",
    "p1_window_features": cells_sql('where "day" >= 20 and "day" < 140') + " select * from cells",
    "p1_entity_rows": cells_sql() + " select customer_id, string_agg(event_type || '=' || n || '/' || last_day || '/' || total::bigint, ';' order by event_type) as features, sum(n)::bigint as payments, max(last_day) as last_day, sum(total) as total from cells group by 1",
    "p2_found": OUTCOMES_SQL + " select payment_id, outcome, period, case when over <= 28 then 'corrects' else 'too_late' end as verdict from judged where over > 0",
    "p2_weekly": OUTCOMES_SQL
    + """, weekly as (select outcome, period, count(*) filter (over <= 28) as n, coalesce(sum(amount) filter (over <= 28), 0) as total, count(distinct known) filter (over between 1 and 28) as corrections, count(*) filter (over between 1 and 28) as late_n, count(*) filter (over > 28) as too_late_n from judged group by 1, 2)
select *, sum(n) over (partition by outcome order by period)::bigint as running_n, sum(total) over (partition by outcome order by period) as running_total from weekly""",
    "p4_found": KEYS_SQL + " select field, key_value from vals where key_value is not null group by 1, 2 having count(*) * 50 >= (select count(*) from valid)",
    "p4_key_stats": KEYS_SQL
    + ", gaps as (select *, created_at - lag(created_at) over (partition by field, key_value order by created_at) as gap from vals where key_value is not null) select field, key_value, count(*) as n, sum(amount) as total, min(created_at) as first_at, max(created_at) as last_at, max(gap) as max_gap from gaps group by 1, 2",
    "p5_found": f"""with {VALID}, snaps as (select distinct customer_id, as_of_day, created_at, snapshot_id from graph_features)
select payment_id, 'snapshot' as kind, arg_max(snapshot_id, (as_of_day, s.created_at, snapshot_id)) as ref_id from valid p join snaps s on s.customer_id = p.customer_id and s.as_of_day <= p."day" and s.created_at <= p.created_at group by 1
union all
select p.payment_id, 'known_fraud', arg_max(f.payment_id, (f.created_at, f.payment_id)) from valid p join valid f on f.customer_id = p.customer_id and f.is_fraud and f.created_at < p.created_at and f.label_available_day <= p."day" group by 1""",
    "p6_found": ENTITY_SQL + ' select entity_type, entity, "day" from totals where n_7 >= 15 and total_30 >= 100000',
    "p6_day_totals": ENTITY_SQL + f""", spans as (select entity_type, entity, min("day") as lo from daily group by 1, 2)
select a.entity_type, a.entity, k.d::int as "day", coalesce(t.n_7, 0)::bigint as n_7, coalesce(t.total_7, 0)::double as total_7, coalesce(t.total_7, 0) / 7.0::double as avg_7, coalesce(t.n_30, 0)::bigint as n_30, coalesce(t.total_30, 0)::double as total_30, coalesce(t.total_30, 0) / 30.0::double as avg_30
from spans a join range({DAYS}) k(d) on k.d >= a.lo left join totals t on t.entity_type = a.entity_type and t.entity = a.entity and t."day" = k.d""",
    "p6_entity_totals": ENTITY_SQL + f" select entity_type, entity, count(*)::int as days_with_activity_30, max(n_7) as peak_n_7, max(total_7) as peak_total_7, max(n_30) as peak_n_30, max(total_30) as peak_total_30, sum(total_7) / {DAYS} / 7 as mean_avg_7, sum(total_30) / {DAYS} / 30 as mean_avg_30 from totals group by 1, 2",
}
