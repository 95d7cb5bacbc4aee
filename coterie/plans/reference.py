"""Queries for every operator of the pipeline over the payments table, with the same in SQL."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.config import LINKS, Config
from coterie.operators import checks, evaluation, explain, identity, pointintime
from coterie.plans.graph import COMMUNITIES, COMPONENTS, clusters_of, profile, split_in, table
from coterie.plans.problems import VALID, sql_code, sql_identifier
from coterie.functions.clean import PREFIX
from coterie.sources.contract import CATEGORICAL, label_day, payments
from coterie.plans.features import TABULAR
from coterie.runtime import materialise

CONFIG = Config()
G = CONFIG.graph
DAY = 86400
THRESHOLDS = {"base": 0.6, "graph": 0.6}
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = _counts(sql)
        return f

    return add


# ---- shared SQL ----

_IDENT = ", ".join(f"{sql_identifier(c)} as {c}" for c in PREFIX)
SPLIT_SQL = "case when \"day\" between 110 and 149 then 'test' when \"day\" between 90 and 109 then 'val' when \"day\" between 0 and 89 then 'train' else 'unassigned' end"
CONF = f"""{VALID}, conf as (select payment_id, customer_id, "day", created_at, amount, is_fraud, {_IDENT},
  nullif(trim(contact), '') as contact, nullif(trim(email_root), '') as email_root, nullif(trim(ip), '') as ip, {sql_code('status')} as status, {sql_code('method')} as method,
  card_network, card_type, card_issuer, city, refunded, disputed, refund_day, dispute_day, ring_id, ring_type, benign_cluster, signup_day, greatest("day" - signup_day, 0) as account_age_days,
  label_available_day, label_matured, {SPLIT_SQL} as split from valid)"""
_LINKS = " union all ".join(f"select customer_id, \"day\", '{k.column}' as link_type, {k.column} as value from conf" for k in LINKS)
_SPECS = ", ".join(f"('{k.column}', {k.prior}, {k.max_df}, {i})" for i, k in enumerate(LINKS))
PAIRS = f"{CONF}, pairs as (select distinct customer_id, \"day\", link_type, value from ({_LINKS}) where value is not null and value <> '')"
DFS = f"""{PAIRS}, specs(link_type, prior, max_df, ord) as (values {_SPECS}), days as (select unnest(range({G.first_as_of}, {G.last_as_of + 1}))::int as as_of_day),
win as (select distinct as_of_day, customer_id, link_type, value from pairs p join days a on p."day" >= a.as_of_day - {G.window_days} and p."day" < a.as_of_day),
nodes as (select distinct as_of_day, customer_id from conf p join days a on p."day" >= a.as_of_day - {G.window_days} and p."day" < a.as_of_day),
dfs as (select as_of_day, link_type, value, count(*) as df from win group by all)"""
EDGES = f"""{DFS}, sizes as (select as_of_day, count(*) as n from nodes group by 1),
weights as (select * from (select as_of_day, link_type, value, df, greatest(ln(n / df) / ln(n), 0) * prior as weight from dfs join sizes using (as_of_day) join specs using (link_type) where df between 2 and max_df) where weight >= {G.min_weight}),
members as (select win.*, weight from win join weights using (as_of_day, link_type, value)),
edges as (select a.as_of_day, a.customer_id as src, b.customer_id as dst, sum(a.weight) as weight from members a join members b using (as_of_day, link_type, value) where a.customer_id < b.customer_id group by all having sum(a.weight) >= {G.min_weight})"""
CLUSTERS = f"""{EDGES}, ways as (select as_of_day, src as a, dst as b from edges union all select as_of_day, dst, src from edges),
reach as (select as_of_day, a, b from ways union select r.as_of_day, r.a, w.b from reach r join ways w on w.as_of_day = r.as_of_day and w.a = r.b),
clusters as (select as_of_day, a as customer_id, least(a, min(b)) as cluster from reach group by as_of_day, a)"""
#: The part of the SQL that finds the clusters; a table of given clusters can stand in its place.
FINDS_CLUSTERS = CLUSTERS[len(EDGES) :]
STATS = f"""{CLUSTERS}, inner_edges as (select e.as_of_day, c.cluster, e.weight from edges e join clusters c on c.as_of_day = e.as_of_day and c.customer_id = e.src join clusters d on d.as_of_day = e.as_of_day and d.customer_id = e.dst and d.cluster = c.cluster),
cohesion as (select as_of_day, cluster, count(*) as edges, avg(weight) as mean_edge_weight, max(weight) as max_edge_weight, sum(weight) as total_weight, any_value(size) as size, count(*) / (any_value(size) * (any_value(size) - 1) / 2) as density
  from inner_edges join (select as_of_day, cluster, count(*) as size from clusters group by all) using (as_of_day, cluster) group by all),
rows_of as (select c.as_of_day, c.cluster, p.* from conf p join clusters c on c.customer_id = p.customer_id and p."day" >= c.as_of_day - {G.window_days} and p."day" < c.as_of_day),
firsts as (select as_of_day, cluster, customer_id, min("day") as first_day, arg_min(signup_day, (created_at, payment_id)) as signup from rows_of group by all),
cohort as (select as_of_day, cluster, stddev_samp(signup) as cl_signup_std, (max(signup) - min(signup))::double as cl_signup_span, stddev_samp(first_day) as cl_first_seen_std, (max(first_day) - min(first_day))::double as cl_first_seen_span from firsts group by all),
base as (select as_of_day, cluster, count(*) as cl_payments, count(distinct customer_id) as cl_customers, count(distinct card_fingerprint) as cl_distinct_cards, count(distinct device_fingerprint) as cl_distinct_devices, count(distinct shipping_address_hash) as cl_distinct_addresses, count(distinct ip) as cl_distinct_ips,
  avg((status <> 'captured')::int) as cl_failure_rate, avg(amount) as cl_amount_mean, median(amount) as cl_amount_median, stddev_samp(amount) / nullif(avg(amount), 0) as cl_amount_cv, avg(account_age_days) as cl_account_age_mean, min(account_age_days)::double as cl_account_age_min,
  count(distinct "day") as cl_active_days, (max("day") - min("day") + 1)::bigint as cl_day_span, max("day") as last_day, count(distinct card_issuer) as cl_distinct_issuers, avg((account_age_days < 30)::int) as cl_new_account_share from rows_of group by all),
behaviour as (select base.* exclude (last_day), (max(last_day) over (partition by base.as_of_day) - last_day)::bigint as cl_last_seen_lag, cl_signup_std, cl_signup_span, cl_first_seen_std, cl_first_seen_span,
  cl_distinct_cards / nullif(cl_distinct_devices, 0) as cl_cards_per_device, cl_customers / nullif(cl_distinct_addresses, 0) as cl_customers_per_address, cl_payments / nullif(cl_active_days, 0) as cl_payments_per_active_day, cl_active_days / nullif(cl_day_span, 0) as cl_burstiness,
  1 / (1 + coalesce(cl_signup_std, 400)) as cl_signup_synchrony, 1 / (1 + coalesce(cl_first_seen_std, 60)) as cl_first_seen_synchrony, cl_signup_span / nullif(cl_customers, 0) as cl_signup_span_per_customer, cl_distinct_issuers / nullif(cl_customers, 0) as cl_issuers_per_customer
  from base join cohort using (as_of_day, cluster))"""
RISK = f"""{STATS}, unit(x, lo, hi, r) as (select 0, 0, 0, 0 where false),
sig as (select as_of_day, cluster,
  {{u(mean_edge_weight, 0.05, 0.6)}} * {{u(density, 0.2, 1.0)}} as clsig_cohesion, {{u(ln(1 + cl_customers), ln(4), ln(41))}} as clsig_scale, {{u(cl_cards_per_device, 3, 60)}} as clsig_card_fanout, {{u(cl_failure_rate, 0.25, 0.9)}} as clsig_decline, {{u(30 - cl_account_age_mean, 5, 30)}} as clsig_fresh,
  {{u(cl_customers_per_address, 4, 30)}} as clsig_address_concentration, {{u(cl_payments_per_active_day, 3, 40)}} as clsig_burst, {{u(cl_signup_synchrony, 0.002, 0.05)}} * {{u(ln(1 + cl_customers), ln(5), ln(26))}} as clsig_cohort_synchrony, {{u(cl_new_account_share, 0.25, 0.9)}} as clsig_new_accounts
  from cohesion join behaviour using (as_of_day, cluster)),
risk as (select *, least(greatest(0.17 * clsig_cohesion + 0.07 * clsig_scale + 0.15 * clsig_card_fanout + 0.13 * clsig_decline + 0.09 * clsig_fresh + 0.10 * clsig_address_concentration + 0.06 * clsig_burst + 0.14 * clsig_cohort_synchrony + 0.09 * clsig_new_accounts, 0), 1) as cl_ring_risk from sig)"""
RISK = RISK.replace("unit(x, lo, hi, r) as (select 0, 0, 0, 0 where false),\n", "")


def _units(sql: str) -> str:
    import re

    return re.sub(r"\{u\((.+?), ([^,{}]+), ([^,{}]+)\)\}", r"coalesce(least(greatest((\1 - \2) / (\3 - \2), 0), 1), 0)", sql)


RISK = _units(RISK)
VOTES = f"""{CLUSTERS}, counted as (select as_of_day, link_type, value, cluster, count(*) as n from members join clusters using (as_of_day, customer_id) group by all),
votes as (select as_of_day, link_type, value, arg_min(cluster, (-n, cluster)) as cluster from counted group by all)"""
_TARGETS = " union all ".join(f"select payment_id, \"day\" as as_of_day, '{k.column}' as link_type, {k.column} as value from conf" for k in LINKS)
RESOLVED = f"""{VOTES}, own as (select payment_id, 0 as rank, cluster from conf p join clusters c on c.as_of_day = p."day" and c.customer_id = p.customer_id),
inherited as (select payment_id, ord + 1 as rank, cluster from ({_TARGETS}) t join votes using (as_of_day, link_type, value) join specs using (link_type)),
best as (select payment_id, arg_min(cluster, rank) as cluster, min(rank) as rank from (select * from own union all select * from inherited) group by 1),
resolved as (select payment_id, "day" as as_of_day, cluster, case when rank is null then 0 when rank = 0 then 1 else 2 end as g_match from conf left join best using (payment_id))"""
SCORED = f"""{CONF}, scored as (select c.*, is_fraud::int as y, 'base' as arm, 0.35::double * is_fraud::int + ((created_at * 31 + amount::bigint * 17) % 6500)::double / 10007.0::double as score from conf c
  union all select c.*, is_fraud::int, 'graph', 0.5::double * is_fraud::int + ((created_at * 13 + amount::bigint * 7) % 5000)::double / 10007.0::double from conf c),
test as (select * from scored where split = 'test')"""
CURVE = f"""{SCORED}, agg as (select arm, score, count(*) as n, sum(y)::bigint as pos, sum(amount) as amount, sum(case when y = 1 then amount else 0 end) as pos_amount from test group by 1, 2),
curve as (select arm, threshold, tp, fp, tp / (tp + fp) as precision, coalesce(tp / nullif(all_pos, 0), 0) as recall from (select arm, score as threshold, sum(pos) over (partition by arm order by score desc)::bigint as tp, sum(n - pos) over (partition by arm order by score desc)::bigint as fp, sum(pos) over (partition by arm) as all_pos from agg))"""


def R(sql: str, rec: bool = False) -> str:
    return ("with recursive " if rec else "with ") + sql


def _counts(sql: str) -> str:
    """Counts of conditions written so that they come out as 64-bit integers."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) filter (where {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def scored(spark: SparkSession, sf_dir: str, test_only: bool = True, scores: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """Payments of both arms with their scores: those of ``scores`` (payment_id, score_base, score_graph).

    Without that table, as in the queries that SQL checks, scores are plain
    arithmetic of the columns. Those exercise the evaluation and say nothing
    about how well anything is detected. ``of`` has the payments where they
    are written already.
    """
    p = (payments(spark, sf_dir) if of is None else of).withColumn("split", split_in(spark, sf_dir)).withColumn("y", F.col("is_fraud").cast("int"))
    if test_only:
        p = p.where("split = 'test'")
    if scores is not None:
        p = p.join(scores.select("payment_id", F.col("score_base").alias("_base"), F.col("score_graph").alias("_graph")), "payment_id")
        arms = F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"_{a}").alias("score")) for a in ("base", "graph")))
        return p.select("*", F.inline(arms)).drop("_base", "_graph")
    whole = F.col("amount").cast("bigint")
    base = F.lit(0.35) * F.col("y") + ((F.col("created_at") * 31 + whole * 17) % 6500).cast("double") / F.lit(10007.0)
    graph = F.lit(0.5) * F.col("y") + ((F.col("created_at") * 13 + whole * 7) % 5000).cast("double") / F.lit(10007.0)
    arms = F.array(F.struct(F.lit("base").alias("arm"), base.alias("score")), F.struct(F.lit("graph").alias("arm"), graph.alias("score")))
    return p.select("*", F.inline(arms))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


# ---- sources and splits ----


@query(R(CONF) + """ select split, count(*) as payments, count_if(is_fraud) as fraud, round(avg(is_fraud::int), 6) as fraud_rate, count(distinct case when is_fraud and ring_id <> '' then ring_id end) as rings,
 round(coalesce(sum(amount) filter (status = 'captured'), 0) / 100) as gmv_major, round(coalesce(sum(amount) filter (status = 'captured' and is_fraud), 0) / 100) as fraud_major from conf group by 1""")
def corpus_summary(spark, sf_dir):
    p = payments(spark, sf_dir, "day", "amount", "status", "is_fraud", "ring_id")
    captured = F.col("status") == "captured"
    money = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0.0)) / 100)
    return p.groupBy(split_in(spark, sf_dir).alias("split")).agg(
        F.count(F.lit(1)).alias("payments"), F.count_if("is_fraud").alias("fraud"), F.round(F.avg(F.col("is_fraud").cast("int")), 6).alias("fraud_rate"),
        F.count_distinct(F.when(F.col("is_fraud") & (F.col("ring_id") != ""), F.col("ring_id"))).alias("rings"), money(captured).alias("gmv_major"), money(captured & F.col("is_fraud")).alias("fraud_major"),
    )


@query(R(CONF) + ", long as (" + _LINKS + ") select link_type, count(value) as filled, round(count(value) / count(*) * 100, 4) as percent, count(distinct value) as distinct_values from long group by 1")
def link_coverage(spark, sf_dir):
    p = payments(spark, sf_dir, *(k.column for k in LINKS))
    long = p.select(F.inline(F.array(*(F.struct(F.lit(k.column).alias("link_type"), F.col(k.column).alias("value")) for k in LINKS))))
    counted = long.groupBy("link_type", "value").agg(F.count(F.lit(1)).alias("n"))  # combines before the shuffle, then a row per value
    filled = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    return counted.groupBy("link_type").agg(filled.alias("filled"), F.round(filled / F.sum("n") * 100, 4).alias("percent"), F.count("value").alias("distinct_values"))


@query(R(CONF) + " select payment_id, split from conf")
def temporal_split(spark, sf_dir):
    return payments(spark, sf_dir, "day").select("payment_id", split_in(spark, sf_dir).alias("split"))


@query(R(CONF) + """ select payment_id, label_day, label_day <= 150 as matured from (select payment_id, case when disputed and dispute_day >= 0 then dispute_day when refunded and refund_day >= 0 then refund_day when status = 'failed' then "day" else "day" + 45 end as label_day from conf)""")
def label_maturity(spark, sf_dir):
    p = payments(spark, sf_dir, "day", "status", "refunded", "disputed", "refund_day", "dispute_day")
    return p.select("payment_id", label_day().alias("label_day")).withColumn("matured", F.col("label_day") <= CONFIG.maturity.as_of)


@query(R(CONF) + " select payment_id, split, is_fraud from conf where split in ('train', 'val') and coalesce(label_matured, false)")
def matured_training_rows(spark, sf_dir):
    p = payments(spark, sf_dir, "day", "is_fraud", "label_matured").withColumn("split", split_in(spark, sf_dir))
    return p.where(F.col("split").isin("train", "val") & F.coalesce("label_matured", F.lit(False))).select("payment_id", "split", "is_fraud")


@query(R(CONF) + " select split, count(*) as payments, count_if(is_fraud) as fraud, count_if(split in ('train', 'val') and not coalesce(label_matured, false)) as dropped from conf group by 1")
def split_stats(spark, sf_dir):
    p = payments(spark, sf_dir, "day", "is_fraud", "label_matured").withColumn("split", split_in(spark, sf_dir))
    dropped = F.col("split").isin("train", "val") & ~F.coalesce("label_matured", F.lit(False))
    return p.groupBy("split").agg(F.count(F.lit(1)).alias("payments"), F.count_if("is_fraud").alias("fraud"), F.count_if(dropped).alias("dropped"))


@query(R(PAIRS) + ' select customer_id, "day", link_type, value from pairs')
def identifier_pairs(spark, sf_dir):
    return identity.identifier_pairs(payments(spark, sf_dir, "customer_id", "day", *(k.column for k in LINKS)), LINKS)


# ---- point in time ----


@query(R(CONF) + ' select payment_id, amount, round(ln(1 + amount), 9) as log_amount, (created_at % 86400) / 3600 as hour_of_day, "day" % 7 as day_of_week, account_age_days, (amount < 5000)::int as is_micro_ticket from conf')
def tabular_scalars(spark, sf_dir):
    return rounded(pointintime.scalars(payments(spark, sf_dir, "day", "created_at", "amount", "account_age_days")), "log_amount", digits=9)


def _velocity(key: str):
    short, windows = pointintime.VELOCITY[key]
    cols = ", ".join(f"case when {key} is null then 0 else count(*) over (partition by {key} order by created_at range between {s} preceding and 1 preceding) end as vel_{short}_{n}" for n, s in windows.items())

    def run(spark, sf_dir):
        return pointintime.trailing_counts(payments(spark, sf_dir, key, "created_at"), key, {f"vel_{short}_{n}": s for n, s in windows.items()})

    query(R(CONF) + f" select payment_id, {cols} from conf", f"velocity_{short}")(run)


for _key in pointintime.VELOCITY:
    _velocity(_key)


@query(R(CONF) + """ select payment_id, created_at - lag(created_at) over (partition by customer_id order by created_at, payment_id) as since_customer,
 case when device_fingerprint is not null then created_at - lag(created_at) over (partition by device_fingerprint order by created_at, payment_id) end as since_device from conf""")
def seconds_since_prev(spark, sf_dir):
    p = payments(spark, sf_dir, "customer_id", "device_fingerprint", "created_at")
    by = lambda key, name: pointintime.running(p, key, {}).select("payment_id", F.col("prev_at").alias(name))
    out = p.select("payment_id", "created_at").join(by("customer_id", "c"), "payment_id", "left").join(by("device_fingerprint", "d"), "payment_id", "left")
    return out.select("payment_id", (F.col("created_at") - F.col("c")).alias("since_customer"), (F.col("created_at") - F.col("d")).alias("since_device"))


_PRIOR = "partition by customer_id order by created_at, payment_id rows between unbounded preceding and 1 preceding"


@query(R(CONF) + f" select payment_id, count(*) over ({_PRIOR}) as prior_payments, coalesce(sum((status = 'failed')::int) over ({_PRIOR}), 0)::double as prior_failures, coalesce(round(sum((status = 'failed')::int) over ({_PRIOR}) / count(*) over ({_PRIOR}), 9), 0) as prior_failure_rate from conf")
def prior_failures(spark, sf_dir):
    p = payments(spark, sf_dir, "customer_id", "created_at", "status")
    r = pointintime.running(p, "customer_id", {"prior_failures": F.coalesce((F.col("status") == "failed").cast("int"), F.lit(0))})
    return r.select("payment_id", F.col("prior_n").alias("prior_payments"), "prior_failures", F.coalesce(F.round(F.col("prior_failures") / F.nullif("prior_n", F.lit(0)), 9), F.lit(0.0)).alias("prior_failure_rate"))


@query(R(CONF) + """ select p.payment_id, count(q.payment_id) as prior_customer_refunds from conf p left join conf q on q.customer_id = p.customer_id and q.payment_id <> p.payment_id and q.refund_day >= 0 and greatest(q.refund_day, q."day") <= p."day" group by 1""")
def prior_refunds_asof(spark, sf_dir):
    return pointintime.refunds_known(payments(spark, sf_dir, "customer_id", "day", "refund_day"))


@query(R(CONF) + f" select payment_id, round(case when avg(amount) over ({_PRIOR}) > 0 then amount / avg(amount) over ({_PRIOR}) else 1 end, 6) as amount_ratio from conf")
def amount_ratio(spark, sf_dir):
    p = payments(spark, sf_dir, "customer_id", "created_at", "amount")
    r = pointintime.running(p, "customer_id", {"s": F.coalesce("amount", F.lit(0.0))}).join(p.select("payment_id", "amount"), "payment_id")
    mean = F.col("s") / F.nullif("prior_n", F.lit(0))
    return r.select("payment_id", F.round(F.when(mean > 0, F.col("amount") / mean).otherwise(1.0), 6).alias("amount_ratio"))


def _distinct(a: str, b: str, name: str):
    def run(spark, sf_dir):
        return pointintime.prior_distinct(payments(spark, sf_dir, a, b, "created_at"), a, b, name)

    sql = f", marked as (select payment_id, {a}, created_at, case when {b} is not null and row_number() over (partition by {a}, {b} order by created_at, payment_id) = 1 then 1 else 0 end as first from conf where {a} is not null) select payment_id, coalesce(sum(first) over (partition by {a} order by created_at, payment_id rows between unbounded preceding and 1 preceding), 0)::bigint as {name} from marked"
    query(R(CONF) + sql, name)(run)


for _spec in pointintime.DISTINCT:
    _distinct(*_spec)


@query(R(CONF) + """, marked as (select payment_id, device_fingerprint, created_at, device_fingerprint is not null and card_fingerprint is not null and row_number() over (partition by device_fingerprint, card_fingerprint order by created_at, payment_id) = 1 as first from conf),
firsts as (select payment_id, count(*) over (partition by device_fingerprint order by created_at range between 86400 preceding and 1 preceding) as d1, count(*) over (partition by device_fingerprint order by created_at range between 604800 preceding and 1 preceding) as d7 from marked where first)
select payment_id, coalesce(d1, 0) as new_cards_24h, coalesce(d7, 0) as new_cards_7d from conf left join firsts using (payment_id)""")
def new_cards_on_device(spark, sf_dir):
    p = payments(spark, sf_dir, "device_fingerprint", "card_fingerprint", "created_at")
    marked = pointintime.flagged(p, pointintime.first_of_pair(p, "device_fingerprint", "card_fingerprint"), "is_first")
    return pointintime.trailing_counts(marked, "device_fingerprint", {"new_cards_24h": DAY, "new_cards_7d": 7 * DAY}, only=F.col("is_first"))


def _tabular_sql() -> str:
    """The queries above, put together: each window of the block in one select, firsts and refunds beside it."""
    vel = ", ".join(f"case when {k} is null then 0 else count(*) over (partition by {k} order by created_at range between {w} preceding and 1 preceding) end as vel_{short}_{n}" for k, (short, windows) in pointintime.VELOCITY.items() for n, w in windows.items())
    levels = ", ".join(f"coalesce({c}, '__none__') as {c}" for c in CATEGORICAL)
    marks = ", ".join(f"{a} is not null and {b} is not null and row_number() over (partition by {a}, {b} order by created_at, payment_id) = 1 as f{i}" for i, (a, b, _) in enumerate(pointintime.DISTINCT))
    seen = ", ".join(f"case when {a} is null then 0 else coalesce(sum(f{i}::int) over (partition by {a} order by created_at, payment_id rows between unbounded preceding and 1 preceding), 0)::bigint end as {name}" for i, (a, _, name) in enumerate(pointintime.DISTINCT))
    return R(CONF) + f""", marked as (select *, {marks} from conf),
seen as (select payment_id, {seen} from marked),
fresh as (select payment_id, count(*) over (partition by device_fingerprint order by created_at range between 86400 preceding and 1 preceding) as new_cards_on_device_24h, count(*) over (partition by device_fingerprint order by created_at range between 604800 preceding and 1 preceding) as new_cards_on_device_7d from marked where f2),
refunds as (select p.payment_id, count(q.payment_id) as prior_customer_refunds from conf p left join conf q on q.customer_id = p.customer_id and q.payment_id <> p.payment_id and q.refund_day >= 0 and greatest(q.refund_day, q."day") <= p."day" group by 1),
own as (select payment_id, amount, ln(1 + amount) as log_amount, (created_at % 86400) / 3600 as hour_of_day, "day" % 7 as day_of_week, account_age_days, (amount < 5000)::int as is_micro_ticket, {levels}, {vel},
 count(*) over ({_PRIOR}) as prior_customer_payments, coalesce(sum((status = 'failed')::int) over ({_PRIOR}), 0)::double as prior_customer_failures, case when avg(amount) over ({_PRIOR}) > 0 then amount / avg(amount) over ({_PRIOR}) else 1 end as amount_z_vs_customer,
 created_at - lag(created_at) over (partition by customer_id order by created_at, payment_id) as seconds_since_prev_customer, case when device_fingerprint is not null then created_at - lag(created_at) over (partition by device_fingerprint order by created_at, payment_id) end as seconds_since_prev_device from conf),
block as (select own.*, seen.* exclude (payment_id), coalesce(new_cards_on_device_24h, 0) as new_cards_on_device_24h, coalesce(new_cards_on_device_7d, 0) as new_cards_on_device_7d, prior_customer_refunds,
 coalesce(prior_customer_failures / nullif(prior_customer_payments, 0), 0) as prior_customer_failure_rate, coalesce(prior_customer_refunds / nullif(prior_customer_payments, 0), 0) as prior_customer_refund_rate from own join seen using (payment_id) join refunds using (payment_id) left join fresh using (payment_id))
select * replace ({_r(*_TABULAR_ROUNDED)}) from block"""


_TABULAR_ROUNDED = ("log_amount", "hour_of_day", "prior_customer_failure_rate", "prior_customer_refund_rate", "amount_z_vs_customer")


@query(_tabular_sql())
def tabular_features(spark, sf_dir):
    return rounded(table(spark, sf_dir, "tabular"), *_TABULAR_ROUNDED)


# ---- identity graph ----


@query(R(DFS) + " select as_of_day, link_type, value, df, df > max_df as pruned from dfs join specs using (link_type) where df >= 2")
def identifier_df(spark, sf_dir):
    s = table(spark, sf_dir, "segments").where("df >= 2")
    return s.select(F.explode(F.sequence("from_day", "to_day")).alias("as_of_day"), "link_type", "value", "df", (F.col("df") > identity.cap(profile(spark, sf_dir)[1])).alias("pruned"))


@query(R(EDGES) + f" select as_of_day, link_type, value, df, {_r('weight')} from weights")
def identifier_weights(spark, sf_dir):
    return rounded(table(spark, sf_dir, "weights"), "weight")


@query(R(EDGES) + f" select as_of_day, src, dst, {_r('weight')} from edges")
def identity_edges(spark, sf_dir):
    return rounded(table(spark, sf_dir, "edges"), "weight")


@query(R(EDGES) + """, ends as (select as_of_day, src as customer_id, weight from edges union all select as_of_day, dst, weight from edges)
select as_of_day, customer_id, count(weight) as g_degree, round(coalesce(sum(weight), 0), 6) as g_weighted_degree, round(coalesce(max(weight), 0), 6) as g_max_edge_weight, round(coalesce(avg(weight), 0), 6) as g_mean_edge_weight from nodes left join ends using (as_of_day, customer_id) group by 1, 2""")
def customer_degree(spark, sf_dir):
    d = identity.degrees(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"))
    return rounded(d, "g_weighted_degree", "g_max_edge_weight", "g_mean_edge_weight")


@query(R(CLUSTERS, True) + " select as_of_day, customer_id, cluster as component from clusters")
def connected_components(spark, sf_dir):
    return table(spark, sf_dir, "components")


@query(R(STATS, True) + " select as_of_day, cluster as component, size, edges, round(density, 6) as density, size < 14 or density >= 0.4 as whole from cohesion")
def component_density(spark, sf_dir):
    from coterie.operators.communities import component_density as density

    return rounded(density(table(spark, sf_dir, "components"), table(spark, sf_dir, "edges"), profile(spark, sf_dir)[1]), "density")


@query()
def louvain_clusters(spark, sf_dir):
    return table(spark, sf_dir, "communities")


_COHESION = ("mean_edge_weight", "max_edge_weight", "total_weight", "density")


@query(R(STATS, True) + f" select as_of_day, cluster, edges, size, {_r(*_COHESION)} from cohesion")
def cluster_cohesion(spark, sf_dir):
    return rounded(table(spark, sf_dir, "component_cohesion"), *_COHESION)


_BEHAVIOUR = "cl_failure_rate cl_amount_mean cl_amount_median cl_amount_cv cl_account_age_mean cl_new_account_share cl_signup_std cl_first_seen_std cl_cards_per_device cl_customers_per_address cl_payments_per_active_day cl_burstiness cl_signup_synchrony cl_first_seen_synchrony cl_signup_span_per_customer cl_issuers_per_customer".split()


@query(R(STATS, True) + " select * replace (" + ", ".join(f"round({c}, 6) as {c}" for c in _BEHAVIOUR) + ") from behaviour")
def cluster_behaviour(spark, sf_dir):
    return rounded(table(spark, sf_dir, "component_behaviour"), *_BEHAVIOUR)


_SIGNALS = [f"clsig_{n}" for n in ("cohesion", "scale", "card_fanout", "decline", "fresh", "address_concentration", "burst", "cohort_synchrony", "new_accounts")]


@query(R(RISK, True) + f" select as_of_day, cluster, {_r(*_SIGNALS, 'cl_ring_risk')} from risk")
def cluster_risk(spark, sf_dir):
    return rounded(table(spark, sf_dir, "component_stats").select("as_of_day", "cluster", *_SIGNALS, "cl_ring_risk"), *_SIGNALS, "cl_ring_risk")


@query(R(VOTES, True) + " select * from votes")
def identifier_cluster_vote(spark, sf_dir):
    return table(spark, sf_dir, "component_votes")


@query(R(RESOLVED, True) + " select * from resolved")
def asof_cluster_resolution(spark, sf_dir):
    return table(spark, sf_dir, "component_resolved")


@query(R(RESOLVED, True) + " select split, g_match, count(*) as payments from resolved join conf using (payment_id) group by 1, 2")
def resolution_coverage(spark, sf_dir):
    r = table(spark, sf_dir, "component_resolved").withColumn("split", split_in(spark, sf_dir, "as_of_day"))
    return r.groupBy("split", "g_match").agg(F.count(F.lit(1)).alias("payments"))


@query()
def graph_features(spark, sf_dir):
    return table(spark, sf_dir, "graph_block")


# ---- evaluation ----


@query(R(CURVE) + " select arm, threshold, tp, fp, round(precision, 9) as precision, round(recall, 9) as recall from curve")
def pr_curve(spark, sf_dir, scores=None):
    return rounded(evaluation.pr_curve(scored(spark, sf_dir, scores=scores)), "precision", "recall", digits=9)


_AP = "ap as (select arm, sum((recall - before) * precision) as pr_auc from (select *, coalesce(lag(recall) over (partition by arm order by threshold desc), 0) as before from curve) group by 1)"
_ROC = "roc as (select arm, sum(pos * (below + (n - pos) / 2)) / nullif(sum(pos) * sum(n - pos), 0) as roc_auc from (select *, coalesce(sum(n - pos) over (partition by arm order by score rows between unbounded preceding and 1 preceding), 0) as below from agg) group by 1)"


@query(R(CURVE) + f", {_AP} select arm, round(pr_auc, 9) as pr_auc from ap")
def average_precision(spark, sf_dir, scores=None):
    return rounded(evaluation.average_precision(scored(spark, sf_dir, scores=scores)), "pr_auc", digits=9)


@query(R(CURVE) + f", {_ROC} select arm, round(roc_auc, 9) as roc_auc from roc")
def roc_auc(spark, sf_dir, scores=None):
    return rounded(evaluation.roc_auc(scored(spark, sf_dir, scores=scores)), "roc_auc", digits=9)


@query(R(CURVE) + f", {_AP}, {_ROC} select arm, n, positives, round(positives / n, 9) as base_rate, round(pr_auc, 9) as pr_auc, round(roc_auc, 9) as roc_auc from (select arm, sum(n)::bigint as n, sum(pos)::bigint as positives from agg group by 1) join ap using (arm) join roc using (arm)")
def headline(spark, sf_dir, scores=None):
    return rounded(evaluation.headline(scored(spark, sf_dir, scores=scores)), "base_rate", "pr_auc", "roc_auc", digits=9)


_OPERATING = """, targets(target_precision) as (values (0.95::double), (0.9), (0.8), (0.6)), hits as (select arm, target_precision, arg_max({recall: recall, threshold: threshold, precision: precision}, (recall, -threshold)) filter (precision >= target_precision) as b, max(precision) as top from curve cross join targets group by 1, 2),
operating as (select arm, target_precision, coalesce(b.recall, 0) as recall, coalesce(b.threshold, 1) as threshold, coalesce(b.precision, top) as achieved_precision from hits)"""


@query(R(CURVE) + _OPERATING + f" select arm, target_precision, threshold, {_r('recall', 'achieved_precision')} from operating")
def recall_at_precision(spark, sf_dir, scores=None):
    return rounded(evaluation.recall_at_precision(scored(spark, sf_dir, scores=scores)), "recall", "achieved_precision")


@query(R(CURVE) + """, targets(target_recall) as (values (0.5::double), (0.7), (0.9)), hits as (select arm, target_recall, arg_max({threshold: threshold, precision: precision}, (precision, -threshold)) filter (recall >= target_recall) as b from curve cross join targets group by 1, 2)
select arm, target_recall, round(coalesce(b.precision, 0), 6) as precision, coalesce(b.threshold, 0) as threshold from hits""")
def precision_at_recall(spark, sf_dir, scores=None):
    return rounded(evaluation.precision_at_recall(scored(spark, sf_dir, scores=scores)), "precision")


@query(R(CURVE) + _OPERATING + """ select b.target_precision, round(b.recall, 6) as base_recall, round(g.recall, 6) as graph_recall, round(g.recall - b.recall, 6) as lift, round((g.recall - b.recall) / nullif(b.recall, 0) * 100, 6) as relative_lift from operating b join operating g using (target_precision) where b.arm = 'base' and g.arm = 'graph'""")
def ablation(spark, sf_dir, scores=None):
    return rounded(evaluation.ablation(evaluation.recall_at_precision(scored(spark, sf_dir, scores=scores))), "base_recall", "graph_recall", "lift", "relative_lift")


@query(R(SCORED) + """, c as (select arm, 0.6::double as threshold, count_if(score >= 0.6 and y = 1) as tp, count_if(score >= 0.6 and y = 0) as fp, count_if(score < 0.6 and y = 1) as fn, count_if(score < 0.6 and y = 0) as tn from test group by 1)
select *, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round((tp + fp) / (tp + fp + fn + tn), 6) as alert_rate, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from c""")
def confusion(spark, sf_dir, scores=None):
    return rounded(evaluation.confusion(scored(spark, sf_dir, scores=scores), THRESHOLDS), "precision", "recall", "alert_rate", "f1")


@query(R(SCORED) + """ select arm, ring_type as archetype, count(*) as payments, round(avg((score >= 0.6)::int), 6) as recall, round(median(score), 6) as median_score, round(coalesce(sum(amount) filter (status = 'captured'), 0) / 100) as amount_major, round(coalesce(sum(amount) filter (score >= 0.6 and status = 'captured'), 0) / 100) as caught_major from test where ring_type <> 'none' group by 1, 2""")
def per_archetype(spark, sf_dir, scores=None):
    return rounded(evaluation.per_archetype(scored(spark, sf_dir, scores=scores), 0.6), "recall", "median_score")


@query(R(SCORED) + """, a as (select arm, ring_type as archetype, avg((score >= 0.6)::int) as recall from test where ring_type <> 'none' group by 1, 2) select archetype, round(b.recall, 6) as base_recall, round(g.recall, 6) as graph_recall, round(g.recall - b.recall, 6) as lift from a b join a g using (archetype) where b.arm = 'base' and g.arm = 'graph'""")
def archetype_lift(spark, sf_dir, scores=None):
    return rounded(evaluation.archetype_lift(evaluation.per_archetype(scored(spark, sf_dir, scores=scores), 0.6)), "base_recall", "graph_recall", "lift")


@query(R(SCORED) + """, fp as (select arm, coalesce(nullif(array_to_string(list_sort(list_distinct([regexp_replace(t, '_[^_]*$', '') for t in string_split(coalesce(benign_cluster, ''), ';') if t <> ''])), '+'), ''), 'no_shared_identifier') as bucket from test where score >= 0.4 and y = 0)
select arm, bucket, count(*) as false_positives, round(count(*) / sum(count(*)) over (partition by arm), 4) as share from fp group by 1, 2""")
def fp_composition(spark, sf_dir, scores=None):
    return evaluation.fp_composition(scored(spark, sf_dir, scores=scores), 0.4)


@query(R(SCORED) + """ select arm, ring_type as archetype, count(*) as missed_payments, round(coalesce(sum(amount) filter (status = 'captured'), 0) / 100) as missed_major, round(median(score), 4) as median_score, round(median(amount) / 100) as median_amount_major from test where score < 0.6 and y = 1 group by 1, 2""")
def missed_fraud(spark, sf_dir, scores=None):
    return evaluation.missed_fraud(scored(spark, sf_dir, scores=scores), 0.6)


@query(R(SCORED) + """, seen as (select distinct ring_id from conf where split = 'train' and is_fraud and ring_id is not null) select arm, case when seen.ring_id is not null then 'seen_in_training' else 'novel_ring' end as cohort, count(distinct t.ring_id) as rings, count(*) as payments, round(avg((score >= 0.6)::int), 6) as recall from test t left join seen on seen.ring_id = t.ring_id where y = 1 group by 1, 2""")
def novel_vs_seen(spark, sf_dir, scores=None):
    train = payments(spark, sf_dir, "day", "is_fraud", "ring_id").withColumn("y", F.col("is_fraud").cast("int")).where(split_in(spark, sf_dir) == "train")
    return rounded(evaluation.novel_vs_seen(scored(spark, sf_dir, scores=scores), train, 0.6), "recall")


@query(R(CURVE) + " select arm, round(coalesce(sum(pos_amount), 0) / 100 * 0.88 + sum(pos) * 1500, 4) as do_nothing_cost from agg group by 1")
def do_nothing_cost(spark, sf_dir, scores=None):
    return rounded(evaluation.do_nothing_cost(scored(spark, sf_dir, scores=scores)), "do_nothing_cost", digits=4)


def _cost_sql(points: int) -> str:
    return f""", grid as (select distinct round(0.01 + i * (0.989 / {points - 1}), 4) as threshold from range({points}) t(i)),
pieces as (select arm, threshold, coalesce(sum(n) filter (score >= threshold), 0)::bigint as blocked, greatest(coalesce(sum(n) filter (score >= 0.35), 0) - coalesce(sum(n) filter (score >= threshold), 0), 0)::bigint as reviewed, coalesce(sum(pos) filter (score >= threshold), 0)::bigint as caught_fraud, coalesce(sum(pos) filter (score < threshold), 0)::bigint as missed_fraud,
  coalesce(sum(n - pos) filter (score >= threshold), 0)::bigint as blocked_good, coalesce(sum(pos_amount) filter (score < threshold), 0) / 100 * 0.88 as fraud_loss, coalesce(sum(pos) filter (score < threshold), 0) * 1500 as chargebacks, coalesce(sum(amount - pos_amount) filter (score >= threshold), 0) / 100 * 0.28 as margin_loss,
  sum(pos_amount) / 100 * 0.88 + sum(pos) * 1500 as do_nothing_cost from agg cross join grid group by 1, 2),
costs as (select * exclude (margin_loss), margin_loss * 2.6 as false_block_loss, reviewed * 45 as review_loss, fraud_loss + chargebacks + margin_loss * 2.6 + reviewed * 45 as total_cost, margin_loss from pieces)"""


_MONEY = ("fraud_loss", "chargebacks", "false_block_loss", "review_loss", "do_nothing_cost", "total_cost", "net_saving")


def _cents(df):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in _MONEY})


_COST_COLUMNS = "arm, threshold, blocked, reviewed, caught_fraud, missed_fraud, blocked_good, " + ", ".join(f"round({c}::double, 2) as {c}" for c in _MONEY)


@query(R(CURVE) + _cost_sql(200) + f", final as (select *, do_nothing_cost - total_cost as net_saving from costs) select {_COST_COLUMNS} from final")
def cost_curve(spark, sf_dir, scores=None):
    return _cents(evaluation.cost_curve(scored(spark, sf_dir, scores=scores)))


@query(R(CURVE) + _cost_sql(200) + f", final as (select *, do_nothing_cost - total_cost as net_saving from costs) select {_COST_COLUMNS} from final qualify row_number() over (partition by arm order by round(total_cost, 6), threshold) = 1")
def optimal_threshold(spark, sf_dir, scores=None):
    return _cents(evaluation.optimal_threshold(evaluation.cost_curve(scored(spark, sf_dir, scores=scores))))


@query(R(CURVE) + _cost_sql(90) + """, varied as (select arm, churn_factor, threshold, blocked, caught_fraud, do_nothing_cost, fraud_loss + chargebacks + margin_loss * churn_factor + review_loss as total from costs cross join (values (1.0::double), (1.8), (2.6), (4.0), (6.0)) f(churn_factor))
select arm, churn_factor, threshold as optimal_threshold, blocked, caught_fraud, round(do_nothing_cost - total) as net_saving, round((do_nothing_cost - total) / nullif(do_nothing_cost, 0) * 100, 1) as saving_percent from varied qualify row_number() over (partition by arm, churn_factor order by round(total, 6), threshold) = 1""")
def cost_sensitivity(spark, sf_dir, scores=None):
    return evaluation.cost_sensitivity(scored(spark, sf_dir, scores=scores))


def _clustered(spark, sf_dir, of=COMPONENTS):
    """Test payments with their resolved cluster and its statistics."""
    p = payments(spark, sf_dir, "customer_id", "day", "amount", "is_fraud").withColumn("y", F.col("is_fraud").cast("int")).where(split_in(spark, sf_dir) == "test")
    stats = table(spark, sf_dir, f"{of}stats").select("as_of_day", "cluster", "cl_customers", "cl_ring_risk")
    return p.join(table(spark, sf_dir, f"{of}resolved"), "payment_id").join(stats, ["as_of_day", "cluster"], "left")


@query(R(RESOLVED + ", sizes_of as (select as_of_day, cluster, count(*) as cl_customers from clusters group by all)", True) + """ select bucket, count(*) as payments, sum(y)::bigint as fraud, round(avg(y), 6) as base_rate from (select is_fraud::int as y, case when coalesce(cl_customers, 0) <= 0 then 'no cluster' when cl_customers <= 4 then '2-4 accounts' when cl_customers <= 19 then '5-19 accounts' when cl_customers <= 99 then '20-99 accounts' else '100+ accounts' end as bucket
 from conf join resolved using (payment_id) left join sizes_of using (as_of_day, cluster) where split = 'test') group by 1""")
def cluster_size_buckets(spark, sf_dir, of=COMPONENTS):
    return _clustered(spark, sf_dir, of).groupBy(evaluation.size_bucket(F.col("cl_customers")).alias("bucket")).agg(F.count(F.lit(1)).alias("payments"), F.sum("y").cast("bigint").alias("fraud"), F.round(F.avg("y"), 6).alias("base_rate"))


@query(R(RESOLVED, True) + """, per as (select as_of_day, cluster, count(*) as n, sum(is_fraud::int) as f from conf join resolved using (payment_id) where split = 'test' and cluster is not null group by all)
select sum(n)::bigint as clustered_rows, count(*) as clusters, sum(f)::bigint as fraud_rows, round(coalesce(sum(case when n >= 2 and f / n > 0.5 then f else 0 end) / nullif(sum(f), 0), 0), 6) as concentration from per""")
def fraud_concentration(spark, sf_dir):
    return rounded(evaluation.fraud_concentration(_clustered(spark, sf_dir)), "concentration")


@query()
def permutation_test(spark, sf_dir):
    return evaluation.permutation_test(_clustered(spark, sf_dir, COMMUNITIES))


@query()
def label_noise_rows(spark, sf_dir):
    rows = payments(spark, sf_dir, "is_fraud").withColumn("y", F.col("is_fraud").cast("int"))
    return evaluation.corrupt_labels(rows, "symmetric", 0.05).select("payment_id", "y", "flipped")


_RUNS_SQL = """, seeded as (select *, arm || '|' || ("day" % 5) as run from test), agg as (select run, score, count(*) as n, sum(y)::bigint as pos from seeded group by 1, 2),
curve as (select run, threshold, tp / (tp + fp) as precision, coalesce(tp / nullif(all_pos, 0), 0) as recall from (select run, score as threshold, sum(pos) over (partition by run order by score desc)::bigint as tp, sum(n - pos) over (partition by run order by score desc)::bigint as fp, sum(pos) over (partition by run) as all_pos from agg)),
runs as (select split_part(run, '|', 1) as arm, sum((recall - before) * precision) as value from (select *, coalesce(lag(recall) over (partition by run order by threshold desc), 0) as before from curve) group by run),
wide as (select avg(value) filter (arm = 'base') as base_mean, stddev_samp(value) filter (arm = 'base') as base_sd, avg(value) filter (arm = 'graph') as graph_mean, stddev_samp(value) filter (arm = 'graph') as graph_sd from runs),
gaps as (select *, graph_mean - base_mean as gap, sqrt((base_sd ** 2 + graph_sd ** 2) / 2) as pooled_sd from wide),
sized as (select *, abs(gap) / nullif(pooled_sd, 0) as effect from gaps)"""
_STUDY = ("base_mean", "base_sd", "graph_mean", "graph_sd", "gap", "pooled_sd", "effect")


@query(R(SCORED) + _RUNS_SQL + f""" select 'pr_auc' as metric, {_r(*_STUDY)}, case when effect is null or effect < 2 then 'no measurable difference' when gap > 0 then 'graph better' else 'base better' end as verdict from sized""")
def study_summary(spark, sf_dir, scores=None):
    """Both arms over repeated runs; here a run is a fifth of the test days, in the studies it is a seed."""
    rows = scored(spark, sf_dir, scores=scores).withColumn("arm", F.concat_ws("|", "arm", F.col("day") % 5))
    runs = evaluation.average_precision(rows).select(F.lit("pr_auc").alias("metric"), F.split("arm", r"\|")[0].alias("arm"), F.col("pr_auc").alias("value"))
    return rounded(evaluation.study_summary(runs, ("metric",)), *_STUDY)


@query(R(CONF) + """, levels as (select feature, coalesce(level, '__none__') as level from (select payment_id, unnest(['method', 'card_network', 'card_type', 'card_issuer', 'city']) as feature, unnest([method, card_network, card_type, card_issuer, city]) as level from conf where split = 'train'))
select feature, level, count(*) as n, (row_number() over (partition by feature order by count(*) desc, level))::int as rank from levels group by 1, 2 qualify rank <= 254""")
def category_vocab(spark, sf_dir):
    from coterie.operators.scoring import category_vocab as vocab

    return vocab(payments(spark, sf_dir, "day", *CATEGORICAL).where(split_in(spark, sf_dir) == "train"), CATEGORICAL)


_NUMERIC = TABULAR
_NAMES = "[" + ", ".join(f"'{c}'" for c in _NUMERIC) + "]"
_VALUES = "[" + ", ".join(f"{c}::double" for c in _NUMERIC) + "]"
_LEVELS = ("[" + ", ".join(f"'{c}'" for c in CATEGORICAL) + "]", "[" + ", ".join(CATEGORICAL) + "]")
_REFERENCE = f""", honest as (select b.* from rounded_block b join conf c using (payment_id) where c.split = 'train' and not c.is_fraud), long as (select feature, value from (select unnest({_NAMES}) as feature, unnest({_VALUES}) as value from honest) where value is not null),
centers as (select feature, median(value) as center, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from long group by 1),
reference as (select feature, center, coalesce(nullif(median(abs(value - center)), 0), nullif(any_value(iqr), 0), 1) as scale from long join centers using (feature) group by 1, 2)"""
_ROUNDED_BLOCK = _tabular_sql().replace("select * replace (", "rounded_block as (select * replace (").replace("join fresh using (payment_id))\n", "join fresh using (payment_id)),\n") + ")"


def _honest(spark, sf_dir, numeric=_NUMERIC, categorical=CATEGORICAL):
    """The tabular block, and what honest training payments look like in the given features."""
    block = tabular_features(spark, sf_dir)
    p = payments(spark, sf_dir, "day", "is_fraud").where((split_in(spark, sf_dir) == "train") & ~F.col("is_fraud")).select("payment_id")
    return block, explain.honest_reference(block.join(p, "payment_id", "left_semi"), numeric, categorical)


@query(_ROUNDED_BLOCK + _REFERENCE + f""", modes as (select feature, arg_min(level, (-n, level)) as level from (select feature, level, count(*) as n from (select unnest({_LEVELS[0]}) as feature, unnest({_LEVELS[1]}) as level from honest) group by 1, 2) group by 1)
select feature, round(center, 6) as center, round(scale, 6) as scale, null::varchar as level from reference union all select feature, null, null, level from modes""")
def honest_reference(spark, sf_dir):
    return rounded(_honest(spark, sf_dir)[1], "center", "scale")


@query(_ROUNDED_BLOCK + _REFERENCE + f""", rows_of as (select payment_id, unnest({_NAMES}) as feature, unnest({_VALUES}) as value from rounded_block)
select payment_id, feature, value, round(abs(value - center) / scale, 4) as z from rows_of join reference using (feature) where value is not null""")
def robust_z(spark, sf_dir, numeric=_NUMERIC, only=None):
    """``only`` has the payment_ids that are asked for, all without it; every honest payment counts for what is normal."""
    block, reference = _honest(spark, sf_dir, numeric, ())
    asked = block if only is None else block.join(only, "payment_id", "left_semi")
    return rounded(explain.robust_z(asked, reference, numeric), "z", digits=4)


# ---- views ----


def _alerts(spark, sf_dir, of=COMPONENTS, scores=None):
    written = table(spark, sf_dir, "payments")
    wide = scored(spark, sf_dir, scores=scores, of=written).groupBy("payment_id").pivot("arm", ["base", "graph"]).agg(F.first("score"))
    p = written.select("payment_id", "day", "amount", "is_fraud", "ring_type", "account_age_days")
    r = table(spark, sf_dir, f"{of}resolved").select("payment_id", "cluster", F.col("cluster").isNotNull().cast("int").alias("g_in_cluster"))
    rows = wide.join(p, "payment_id").join(r, "payment_id")
    return rows.select(
        "payment_id", F.col("graph").alias("score"), F.col("base").alias("baseline_score"), F.round(F.col("amount") / 100, 2).alias("amount_major"), F.round(F.col("graph") * F.col("amount") / 100, 2).alias("exposure"),
        "day", "is_fraud", F.col("is_fraud").cast("int").alias("y"), "ring_type", F.when(F.col("is_fraud"), F.col("ring_type")).otherwise("honest").alias("verdict"), "g_in_cluster", "account_age_days",
    )


_ALERTS_SQL = """, alerts as (select g.payment_id, g.score, b.score as baseline_score, round(g.amount / 100, 2) as amount_major, round(g.score * g.amount / 100, 2) as exposure, g."day", g.is_fraud, g.y, g.ring_type, case when g.is_fraud then g.ring_type else 'honest' end as verdict, (cluster is not null)::int as g_in_cluster, g.account_age_days
 from test g join test b on b.payment_id = g.payment_id and b.arm = 'base' join resolved r on r.payment_id = g.payment_id where g.arm = 'graph')"""
_SCORED_ONLY = SCORED[len(CONF) :]


@query(R(RESOLVED + _SCORED_ONLY + _ALERTS_SQL, True) + " select * from alerts where score >= 0.99 and baseline_score < 0.99")
def alerts_graph_only(spark, sf_dir):
    return _alerts(spark, sf_dir).where("score >= 0.99 and baseline_score < 0.99")


@query(R(RESOLVED + _SCORED_ONLY + _ALERTS_SQL, True) + " select * from alerts where g_in_cluster > 0")
def alerts_graph_backed(spark, sf_dir):
    return _alerts(spark, sf_dir).where("g_in_cluster > 0")


def _top(where: str, k: int) -> str:
    return f"(select payment_id from alerts where {where} order by exposure desc, payment_id limit {k})"


@query(R(RESOLVED + _SCORED_ONLY + _ALERTS_SQL, True) + " select * from alerts where payment_id in (" + " union ".join([_top("true", 200), *(_top(f"ring_type = '{t}'", 60) for t in ("card_testing", "refund_abuse", "bust_out")), _top("y = 0", 60), _top("g_in_cluster > 0", 80)]) + ")")
def alert_queue(spark, sf_dir, of=COMPONENTS, scores=None):
    # each stratum reads the alerts
    return explain.alert_queue(materialise(_alerts(spark, sf_dir, of, scores), "alerts")[0])


@query(R(SCORED) + """ select arm, kind, payment_id, score, rank from (select arm, payment_id, score, kind, (row_number() over (partition by arm, kind order by score desc, payment_id))::int as rank from (select *, case when y = 0 then 'honest' when coalesce(ring_type, 'none') = 'none' then 'fraud' else ring_type end as kind from test)) where rank <= 4 and arm = 'graph'""")
def top_per_type(spark, sf_dir, scores=None):
    return explain.top_per_type(scored(spark, sf_dir, scores=scores).where("arm = 'graph'")).select("arm", "kind", "payment_id", "score", "rank")


@query(R(SCORED) + " select payment_id, g.score as with_graph, b.score as without_graph, round(g.score - b.score, 4) as delta from test g join test b using (payment_id) where g.arm = 'graph' and b.arm = 'base'")
def whatif(spark, sf_dir, scores=None):
    wide = scored(spark, sf_dir, scores=scores).groupBy("payment_id").pivot("arm", ["base", "graph"]).agg(F.first("score"))
    return wide.select("payment_id", F.col("graph").alias("with_graph"), F.col("base").alias("without_graph"), F.round(F.col("graph") - F.col("base"), 4).alias("delta"))


@query(R(RISK + RESOLVED[len(CLUSTERS) :] + _SCORED_ONLY, True) + """ select as_of_day, cluster, count(*) as payments, count(distinct customer_id) as accounts, sum(amount) / 100 as amount_major, round(avg(score), 6) as mean_score, max(score) as max_score, count_if(is_fraud) as flagged_fraud, round(max(cl_ring_risk), 6) as ring_risk, min("day") as first_day, max("day") as last_day, round(sum(amount) / 100 * avg(score), 4) as exposure
 from test join resolved using (payment_id) left join risk using (as_of_day, cluster) where arm = 'graph' and cluster is not null group by 1, 2 order by exposure desc, as_of_day, cluster limit 25""")
def ring_leaderboard(spark, sf_dir, of=COMPONENTS, scores=None):
    rows = scored(spark, sf_dir, scores=scores).where("arm = 'graph'").select("payment_id", "score").join(_clustered(spark, sf_dir, of), "payment_id").where("cluster is not null")
    per = rows.groupBy("as_of_day", "cluster").agg(
        F.count(F.lit(1)).alias("payments"), F.count_distinct("customer_id").alias("accounts"), (F.sum("amount") / 100).alias("amount_major"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("max_score"), F.count_if("is_fraud").alias("flagged_fraud"),
        F.round(F.max("cl_ring_risk"), 6).alias("ring_risk"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.round(F.sum("amount") / 100 * F.avg("score"), 4).alias("exposure"),
    )
    return per.orderBy(F.desc("exposure"), "as_of_day", "cluster").limit(25)


@query(R(CLUSTERS, True) + f""" select as_of_day, cluster, p.customer_id, count(*) as payments, coalesce(sum(amount), 0) / 100 as amount_major, max(account_age_days) as account_age_days, min("day") as first_day, count_if(status = 'failed') as declines from conf p join clusters c on c.customer_id = p.customer_id and p."day" >= c.as_of_day - {G.window_days} and p."day" < c.as_of_day group by 1, 2, 3""")
def evidence_members(spark, sf_dir, of=COMPONENTS):
    return explain.evidence_members(table(spark, sf_dir, "payments"), clusters_of(spark, sf_dir, of), G.window_days)


@query(R(CLUSTERS, True) + """ select as_of_day, cluster, link_type, value, count(*) as accounts, round(coalesce(any_value(weight), 0), 6) as weight, any_value(weight) is null as pruned from win join clusters using (as_of_day, customer_id) left join weights using (as_of_day, link_type, value) group by 1, 2, 3, 4 having count(*) >= 2""")
def evidence_identifiers(spark, sf_dir, of=COMPONENTS):
    return rounded(explain.evidence_identifiers(table(spark, sf_dir, "runs"), clusters_of(spark, sf_dir, of), table(spark, sf_dir, "weights")), "weight")


@query(R(CLUSTERS, True) + " select c.as_of_day, c.cluster, src, dst, round(weight, 6) as weight from edges e join clusters c on c.as_of_day = e.as_of_day and c.customer_id = e.src join clusters d on d.as_of_day = e.as_of_day and d.customer_id = e.dst and d.cluster = c.cluster")
def evidence_edges(spark, sf_dir, of=COMPONENTS):
    return rounded(explain.evidence_edges(table(spark, sf_dir, "edges"), clusters_of(spark, sf_dir, of)), "weight")


def _packets(spark, sf_dir, of):
    return rounded(explain.evidence_packets(table(spark, sf_dir, f"{of}resolved"), evidence_members(spark, sf_dir, of), evidence_identifiers(spark, sf_dir, of), evidence_edges(spark, sf_dir, of)), "amount_major", digits=2)


@query()
def evidence_packets(spark, sf_dir):
    return _packets(spark, sf_dir, COMMUNITIES)


@query(R(RESOLVED, True) + f""", acts as (select as_of_day, cluster, p.customer_id, count(*) as payments, coalesce(sum(amount), 0) / 100 as amount_major, count_if(status = 'failed') as declines from conf p join clusters c on c.customer_id = p.customer_id and p."day" >= c.as_of_day - {G.window_days} and p."day" < c.as_of_day group by 1, 2, 3),
m as (select as_of_day, cluster, count(*) as member_count, sum(payments)::bigint as payments, round(sum(amount_major), 2) as amount_major, sum(declines)::bigint as declines from acts group by 1, 2),
shared as (select as_of_day, cluster, link_type, value, count(*) as accounts, any_value(weight) is null as pruned from win join clusters using (as_of_day, customer_id) left join weights using (as_of_day, link_type, value) group by 1, 2, 3, 4 having count(*) >= 2),
i as (select as_of_day, cluster, count_if(not pruned) as shared_identifiers, count_if(pruned) as pruned_identifiers, max(accounts) as widest_sharing from shared group by 1, 2),
e as (select c.as_of_day, c.cluster, count(*) as edges, round(max(weight), 6) as max_weight from edges e join clusters c on c.as_of_day = e.as_of_day and c.customer_id = e.src join clusters d on d.as_of_day = e.as_of_day and d.customer_id = e.dst and d.cluster = c.cluster group by 1, 2)
select payment_id, as_of_day, cluster, case when g_match = 1 then 'own payments in this cluster' else 'a shared identifier' end as attachment, member_count, payments, amount_major, declines, coalesce(shared_identifiers, 0) as shared_identifiers, coalesce(pruned_identifiers, 0) as pruned_identifiers, coalesce(widest_sharing, 0) as widest_sharing, coalesce(edges, 0) as edges, max_weight
 from resolved join m using (as_of_day, cluster) left join i using (as_of_day, cluster) left join e using (as_of_day, cluster)""")
def component_evidence_packets(spark, sf_dir):
    """The packets of whole components, which SQL can find."""
    return _packets(spark, sf_dir, COMPONENTS)


_BLOCK_ROUNDED = ("g_weighted_degree", "g_max_edge_weight", "g_mean_edge_weight", "mean_edge_weight", "max_edge_weight", "density", *_BEHAVIOUR, *_SIGNALS, "cl_ring_risk")


@query(R(RISK + RESOLVED[len(CLUSTERS) :], True) + f""", ends as (select as_of_day, src as customer_id, weight from edges union all select as_of_day, dst, weight from edges),
degrees as (select as_of_day, customer_id, count(weight) as g_degree, coalesce(sum(weight), 0) as g_weighted_degree, coalesce(max(weight), 0) as g_max_edge_weight, coalesce(avg(weight), 0) as g_mean_edge_weight from nodes left join ends using (as_of_day, customer_id) group by 1, 2),
block as (select r.*, d.* exclude (as_of_day, customer_id), h.* exclude (as_of_day, cluster, total_weight), b.* exclude (as_of_day, cluster), k.* exclude (as_of_day, cluster), (r.cluster is not null)::int as g_in_cluster, 0 as g_snapshot_lag
 from resolved r join conf p on p.payment_id = r.payment_id left join degrees d on d.as_of_day = r.as_of_day and d.customer_id = p.customer_id left join cohesion h on h.as_of_day = r.as_of_day and h.cluster = r.cluster left join behaviour b on b.as_of_day = r.as_of_day and b.cluster = r.cluster left join risk k on k.as_of_day = r.as_of_day and k.cluster = r.cluster)
select * replace ({_r(*_BLOCK_ROUNDED)}) from block""")
def component_graph_features(spark, sf_dir):
    """The graph block over whole components, which SQL can find."""
    return rounded(table(spark, sf_dir, "component_graph_block"), *_BLOCK_ROUNDED)


@query(R(PAIRS) + " select distinct link_type, value, case when length(value) <= 7 then value[1:3] || '…' else value[1:3] || '…' || right(value, 3) end as masked from pairs")
def masked_identifiers(spark, sf_dir):
    return identifier_pairs(spark, sf_dir).select("link_type", "value", explain.mask(F.col("value")).alias("masked")).distinct()


@query()
def merchant_notes(spark, sf_dir, scores=None):
    """The payment's decision notes: drafted from the facts of its alert and verified."""
    from coterie.plans.notes import notes

    return notes(spark, sf_dir, scores)


@query(R(CLUSTERS, True) + """ select 'tie without a payment in its window' as "check", count_if(w.value is null) as violations, count(*) as rows from members m left join win w using (as_of_day, link_type, value, customer_id)
 union all select 'clustered account without a payment in its window', count_if(n.customer_id is null), count(*) from clusters c left join nodes n on n.as_of_day = c.as_of_day and n.customer_id = c.customer_id
 union all select 'immature label in training', count_if(label_available_day > 150), count(*) from conf where split in ('train', 'val') and coalesce(label_matured, false) union all select 'clock after day', count_if(created_at // 86400 > "day"), count(*) from conf""")
def causality_violations(spark, sf_dir, of=COMPONENTS):
    """How many ties, clustered accounts, labels and clocks break the order of time; all but the last must be none."""
    t = lambda n: table(spark, sf_dir, n)
    g = profile(spark, sf_dir)[1]
    pairs = identity.identifier_pairs(t("payments"), g.links)
    return checks.violations(t("payments"), pairs, t("members"), clusters_of(spark, sf_dir, of), g.window_days, split_in(spark, sf_dir), max(CONFIG.maturity.as_of, g.last_as_of + 1))


@query(R(CONF) + " select payment_id, label_available_day from conf where split in ('train', 'val') and not coalesce(label_matured, false)")
def immature_training_rows(spark, sf_dir):
    p = payments(spark, sf_dir, "day", "label_matured", "label_available_day")
    return p.where(split_in(spark, sf_dir).isin("train", "val") & ~F.coalesce("label_matured", F.lit(False))).select("payment_id", "label_available_day")


@query()
def gbt_scores(spark, sf_dir):
    from coterie.plans.models import gbt_scores as run

    return run(spark, sf_dir)


@query()
def group_occlusion(spark, sf_dir):
    from coterie.plans.models import group_occlusion as run

    return run(spark, sf_dir)


@query()
def alert_reasons(spark, sf_dir):
    from coterie.plans.models import alert_reasons as run

    return run(spark, sf_dir)


def judged(spark: SparkSession, sf_dir: str, name: str, scores: DataFrame | None) -> DataFrame:
    """The query ``name``, over the given scores and the communities where it reads scores or clusters."""
    q = QUERIES[name]
    takes = inspect.signature(q).parameters
    return q(spark, sf_dir, **({"scores": scores} if "scores" in takes else {}), **({"of": COMMUNITIES} if "of" in takes else {}))
