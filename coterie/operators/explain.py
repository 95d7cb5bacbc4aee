"""Why a payment was scored as it was: reference values, evidence, and notes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coterie.operators import catalogue
from coterie.operators.clusters import window_rows
from coterie.operators.evaluation import exact_quantiles


def mask(value: Column, keep: int = 3) -> Column:
    """The ends of an identifier without its 'type::' prefix; of a short one only its start."""
    text = F.regexp_replace(value, "^.*?::", "")
    short = F.length(text) <= keep * 2 + 1
    return F.when(short, F.concat(F.substring(text, 1, keep), F.lit("…"))).otherwise(F.concat(F.substring(text, 1, keep), F.lit("…"), F.right(text, F.lit(keep))))


def honest_reference(rows: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...] = (), accuracy: int | None = None) -> DataFrame:
    """(feature, center, scale, level): what an honest payment looks like.

    Numeric features have their median and the median distance from it, or the
    distance of the quartiles, or 1 where those are 0. Categorical ones have
    their most frequent level, the smallest on ties, nulls as '__none__'. The
    quantiles are exact, or approximate of the given accuracy, which is cheaper.
    """
    def quantiles(df: DataFrame, shares: tuple[float, ...]) -> DataFrame:
        if accuracy is None:
            return exact_quantiles(df, shares)
        return df.groupBy("feature").agg(F.percentile_approx("value", F.array(*map(F.lit, shares)), accuracy).alias("q"))

    long = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in numeric)))).where("value is not null and not isnan(value)")
    center = quantiles(long, (0.25, 0.5, 0.75)).select("feature", F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
    away = long.join(F.broadcast(center), "feature").select("feature", F.abs(F.col("value") - F.col("center")).alias("value"))  # a row per feature
    out = center.join(F.broadcast(quantiles(away, (0.5,)).select("feature", F.col("q")[0].alias("mad"))), "feature").select("feature", "center", F.coalesce(F.nullif("mad", F.lit(0.0)), F.nullif("iqr", F.lit(0.0)), F.lit(1.0)).alias("scale"), F.lit(None).cast("string").alias("level"))
    if categorical:
        levels = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit("__none__")).alias("level")) for c in categorical))))
        mode = levels.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(F.min_by("level", F.struct(-F.col("n"), "level")).alias("level"))
        out = out.unionByName(mode.select("feature", F.lit(None).cast("double").alias("center"), F.lit(None).cast("double").alias("scale"), "level"))
    return out


def robust_z(rows: DataFrame, reference: DataFrame, numeric: tuple[str, ...]) -> DataFrame:
    """(payment_id, feature, value, z): how many scales a value lies from the honest center."""
    long = rows.select("payment_id", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in numeric)))).where("value is not null")
    z = F.abs(F.col("value") - F.col("center")) / F.col("scale")
    return long.join(F.broadcast(reference.where("center is not null")), "feature").select("payment_id", "feature", "value", z.alias("z"))


def evidence_members(payments: DataFrame, clusters: DataFrame, window_days: int) -> DataFrame:
    """Per cluster and customer what it did in the window; the customer is masked by the caller's view."""
    rows = window_rows(payments.select("customer_id", "day", "amount", "account_age_days", "status"), clusters, window_days)
    return rows.groupBy("as_of_day", "cluster", "customer_id").agg(
        F.count(F.lit(1)).alias("payments"), (F.coalesce(F.sum("amount"), F.lit(0.0)) / 100).alias("amount_major"), F.max("account_age_days").alias("account_age_days"), F.min("day").alias("first_day"), F.count_if(F.col("status") == "failed").alias("declines")
    )


def evidence_identifiers(runs: DataFrame, clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """Identifiers used by two or more members of a cluster, with their weight, or as pruned with weight 0."""
    spans = clusters.groupBy("customer_id").agg(F.min("as_of_day").alias("lo"), F.max("as_of_day").alias("hi"))
    held = runs.join(spans, "customer_id").select("link_type", "value", "customer_id", F.greatest("from_day", "lo").alias("f"), F.least("to_day", "hi").alias("t")).where("f <= t")
    days = held.select("link_type", "value", "customer_id", F.explode(F.sequence("f", "t")).alias("as_of_day"))
    shared = days.join(clusters, ["as_of_day", "customer_id"]).groupBy("as_of_day", "cluster", "link_type", "value").agg(F.count(F.lit(1)).alias("accounts")).where("accounts >= 2")
    out = shared.join(weights.select("as_of_day", "link_type", "value", "weight"), ["as_of_day", "link_type", "value"], "left")
    return out.withColumn("pruned", F.col("weight").isNull()).withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def evidence_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(as_of_day, cluster, src, dst, weight) of the edges inside clusters."""
    of = lambda end: clusters.select("as_of_day", F.col("customer_id").alias(end), F.col("cluster").alias(f"c_{end}"))
    inner = edges.join(of("src"), ["as_of_day", "src"]).join(of("dst"), ["as_of_day", "dst"]).where("c_src = c_dst")
    return inner.select("as_of_day", F.col("c_src").alias("cluster"), "src", "dst", "weight")


def evidence_packets(resolved: DataFrame, members: DataFrame, identifiers: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per payment in a cluster: how it is attached, and what the evidence of its cluster adds up to.

    What there is in detail stays in the tables ``members``, ``identifiers``
    and ``edges``, keyed by (as_of_day, cluster), however large a cluster is.
    """
    keys, n = ["as_of_day", "cluster"], F.count(F.lit(1))
    m = members.groupBy(*keys).agg(n.alias("member_count"), F.sum("payments").alias("payments"), F.sum("amount_major").alias("amount_major"), F.sum("declines").alias("declines"))
    i = identifiers.groupBy(*keys).agg(F.count_if(~F.col("pruned")).alias("shared_identifiers"), F.count_if("pruned").alias("pruned_identifiers"), F.max("accounts").alias("widest_sharing"))
    e = edges.groupBy(*keys).agg(n.alias("edges"), F.max("weight").alias("max_weight"))
    attached = F.when(F.col("g_match") == 1, "own payments in this cluster").otherwise("a shared identifier")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = resolved.where("cluster is not null").join(m, keys).join(i, keys, "left").join(e, keys, "left")
    return out.select("payment_id", *keys, attached.alias("attachment"), "member_count", "payments", "amount_major", "declines", zero("shared_identifiers"), zero("pruned_identifiers"), zero("widest_sharing"), zero("edges"), "max_weight")


def nested_evidence(packets: DataFrame, members: DataFrame, identifiers: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """The packets of a few payments with their details as lists, all masked.

    A list shows the ``most`` greatest entries; the packet tells how many there
    are. This is for views of single payments: details are ranked per payment.
    """
    keys = ["as_of_day", "cluster"]

    def listed(rows: DataFrame, name: str, order: list[Column], *fields) -> DataFrame:
        near = packets.select("payment_id", *keys).join(rows, keys)
        top = near.withColumn("rank", F.row_number().over(Window.partitionBy("payment_id").orderBy(*order))).where(F.col("rank") <= most)
        entries = top.groupBy("payment_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("entry")))).alias("l"))
        return entries.select("payment_id", F.transform("l", lambda x: x["entry"]).alias(name))

    d = F.desc
    parts = (
        listed(members, "members", [d("amount_major"), F.col("customer_id")], mask(F.col("customer_id"), 5).alias("customer"), "payments", "amount_major", "account_age_days", "first_day", "declines"),
        listed(identifiers, "identifiers", [d("weight"), d("accounts"), F.col("value")], "link_type", mask(F.col("value")).alias("masked"), "accounts", "weight", "pruned"),
        listed(edges, "ties", [d("weight"), F.col("src"), F.col("dst")], mask(F.col("src"), 5).alias("a"), mask(F.col("dst"), 5).alias("b"), F.round("weight", 3).alias("weight")),
    )
    out = packets
    for p in parts:
        out = out.join(p, "payment_id", "left")
    return out


def alert_queue(scored: DataFrame, exposure: int = 200, per_type: int = 60, honest: int = 60, clustered: int = 80, types: tuple[str, ...] = ("card_testing", "refund_abuse", "bust_out")) -> DataFrame:
    """The payments an analyst sees first: the greatest exposure of all, of each ring type, of honest and of clustered payments.

    Each stratum is a top-k, which keeps k rows per partition.
    """
    order = (F.desc("exposure"), F.asc("payment_id"))
    top = lambda where, k: scored.where(where).orderBy(*order).limit(k)
    parts = [top(F.lit(True), exposure), *(top(F.col("ring_type") == t, per_type) for t in types), top(F.col("y") == 0, honest), top(F.col("g_in_cluster") > 0, clustered)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["payment_id"])


def top_per_type(scored: DataFrame, k: int = 4) -> DataFrame:
    """The k highest scored fraud payments of each ring type and the k highest scored honest ones; of fraud overall where no type is known."""
    kind = F.when(F.col("y") == 0, "honest").when(F.coalesce(F.col("ring_type"), F.lit("none")) == "none", "fraud").otherwise(F.col("ring_type"))
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "payment_id")
    return scored.withColumn("kind", kind).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _written(unit: Column, value: Column) -> Column:
    """A value as a sentence writes it: whole numbers without decimals, shares in percent, money in major units."""
    plain = F.when(value == F.round(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return F.when(unit == "share", F.concat(F.format_number(value * 100, 0), F.lit("%"))).when(unit == "money", F.format_number(value / 100, 2)).otherwise(plain)


def quotes(z: DataFrame) -> DataFrame:
    """``z`` (payment_id, feature, value, z) of the features with a sentence, with group, place, text and number.

    A value that reads as 0 says nothing and is left out. The sentences, a row
    each, are broadcast.
    """
    rows = [(s.feature, catalogue.group_of(s.feature), i, s.one, s.many, s.unit) for i, s in enumerate(catalogue.SENTENCES)]
    said = z.sparkSession.createDataFrame(rows, "feature string, `group` string, place int, one string, many string, unit string")
    out = z.join(F.broadcast(said), "feature").withColumn("number", _written(F.col("unit"), F.col("value")))
    out = out.where(~F.col("number").isin("0", "0%", "0.00", "-0")).withColumn("text", F.when(F.col("value") == 1, F.replace("one", F.lit("{n}"), "number")).otherwise(F.replace("many", F.lit("{n}"), "number")))
    return out.drop("one", "many", "unit")


def narrate(contributions: DataFrame, z: DataFrame, in_cluster: DataFrame, graph_groups: frozenset[str], top: int = 3, least: float = 0.01, abnormal: float = 3.0, floor: float = 0.5) -> DataFrame:
    """(payment_id, reasons, summary, caveat, graph_driven): the groups that drive a score, in words.

    Contributions under ``least`` are no reasons. Without a cluster the groups
    of the graph are left out and a caveat says so. Of a group the first
    feature at least ``abnormal`` scales from normal is quoted, else the most
    deviant one from ``floor`` on, else only its label. Reasons that read the
    same are given once. A payment has a row even if nothing is left.

    ``contributions`` has payment_id, group, contribution; ``z`` payment_id,
    feature, value, z; ``in_cluster`` payment_id, clustered (boolean).
    """
    quoted = quotes(z.where(F.col("z") >= floor))
    ranked = F.struct((F.col("z") < abnormal).alias("later"), F.when(F.col("z") >= abnormal, F.col("place").cast("double")).otherwise(-F.col("z")).alias("key"), "text")
    best = quoted.groupBy("payment_id", "group").agg(F.min(ranked).alias("b")).select("payment_id", "group", F.col("b.text").alias("text"))
    kept = contributions.where(F.col("contribution") >= least).withColumn("from_graph", F.col("group").isin(*graph_groups)).withColumn("label", F.col("group")).join(in_cluster, "payment_id").where("clustered or not from_graph").join(best, ["payment_id", "group"], "left")
    kept = kept.withColumn("detail", F.coalesce("text", "label"))
    order = Window.partitionBy("payment_id").orderBy(F.desc("contribution"), "group")
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    once = Window.partitionBy("payment_id", "detail").orderBy("rank")
    kept = kept.withColumn("n", F.row_number().over(once)).where("n = 1")
    reason = F.struct("rank", F.col("group"), "label", F.round("contribution", 4).alias("contribution"), "detail", F.col("text").isNull().alias("generic"), "from_graph")
    graph = F.sum(F.when(F.col("from_graph"), F.col("contribution")).otherwise(0.0))
    per = kept.groupBy("payment_id").agg(F.array_sort(F.collect_list(reason)).alias("reasons"), (graph / F.sum("contribution") > 0.5).alias("graph_driven"))
    out = in_cluster.join(per, "payment_id", "left")
    said = F.filter("reasons", lambda r: ~r["generic"])
    words = F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda r: r["detail"]), "; ")).otherwise(F.array_join(F.transform("reasons", lambda r: r["detail"]), ", "))
    return out.select(
        "payment_id", F.coalesce("reasons", F.array().cast("array<struct<rank:int,group:string,label:string,contribution:double,detail:string,generic:boolean,from_graph:boolean>>")).alias("reasons"),
        F.when(F.col("reasons").isNull(), "no single driver").otherwise(F.concat(F.lit("driven by "), words)).alias("summary"),
        F.when(~F.col("clustered"), "no linked accounts were known; the score rests on the payment alone").alias("caveat"), F.coalesce("graph_driven", F.lit(False)).alias("graph_driven"),
    )


# ---- notes ----

#: What a reader calls one and more of the links.
LINK_NOUNS = {"card_fingerprint": ("card", "cards"), "device_fingerprint": ("device", "devices"), "shipping_address_hash": ("delivery address", "delivery addresses"), "contact": ("phone number", "phone numbers"), "email_root": ("mail address", "mail addresses"), "ip": ("network address", "network addresses")}
#: Beginnings of words that accuse.
ACCUSING = ("fraud", "crim", "theft", "thie", "steal", "stole", "guilt", "scam", "crook", "launder", "swindl")
OPEN, CLOSE = "Payment {payment} over {amount} is {decision}.", "A program decided this. Answer this note and a person will look at it again."
NOTHING = "Nothing single stands out."


def link_points(identifiers: DataFrame, most: int = 4) -> DataFrame:
    """(as_of_day, cluster, links): what ties a cluster, one sentence per type of link, the widest sharing first.

    ``links`` has text and numbers. Pruned identifiers are no evidence. A list
    holds an entry per type of link at most.
    """
    keys = ["as_of_day", "cluster"]
    per = identifiers.where(~F.col("pruned")).groupBy(*keys, "link_type").agg(F.count(F.lit(1)).alias("n"), F.max("accounts").alias("widest"))
    noun = lambda i: F.coalesce(*(F.when(F.col("link_type") == t, words[i]) for t, words in LINK_NOUNS.items()), F.col("link_type"))
    single = F.concat(F.lit("a "), noun(0), F.lit(" is used by "), "widest", F.lit(" accounts"))
    several = F.concat("n", F.lit(" "), noun(1), F.lit(" are shared, one of them by "), "widest", F.lit(" accounts"))
    point = F.struct((-F.col("widest")).alias("o"), "link_type", F.when(F.col("n") == 1, single).otherwise(several).alias("text"), F.array(F.col("n").cast("string"), F.col("widest").cast("string")).alias("numbers"))
    all_points = per.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("links"))
    return all_points.select(*keys, F.transform(F.slice("links", 1, most), lambda x: F.struct(x["text"].alias("text"), x["numbers"].alias("numbers"))).alias("links"))


@dataclass
class Facts:
    """All that a note may claim: its points in words, and every number in them as it is written."""

    payment_id: str
    amount: str
    decision: str
    points: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)


def draft(facts: Facts) -> str:
    """A note that says what the facts hold and no more."""
    lines = [OPEN.format(payment=facts.payment_id, amount=facts.amount, decision=facts.decision)]
    lines += [f"* {p}" for p in facts.points] or [NOTHING]
    return "\n".join([*lines, CLOSE])


def verify(text: str, facts: Facts) -> list[str]:
    """What is wrong with a note; empty if nothing is.

    The reference and the numbers of the facts are taken out where they stand
    as a whole; digits that are left belong to no fact.
    """
    problems = [] if facts.payment_id in text else ["no reference to the payment"]
    rest = text
    for slot in sorted({facts.payment_id, facts.amount, *facts.numbers} - {""}, key=len, reverse=True):
        rest = re.sub(rf"(?<![\w.,]){re.escape(slot)}(?!\w|[.,]\d)", " ", rest)
    problems += [f"{word} is in no fact" for word in rest.split() if any(c.isdigit() for c in word)]
    return problems + [f"accusing: {m}" for m in re.findall(rf"\b(?:{'|'.join(ACCUSING)})\w*", text.lower())]


def write_note(facts: Facts, writer=None) -> dict:
    """The writer's note if it passes, else the drafted one, with why the other was rejected."""
    rejected = None
    if writer is not None:
        text = writer(facts)
        rejected = verify(text, facts)
        if not rejected:
            return {"text": text, "source": "writer", "rejected_because": None}
    return {"text": draft(facts), "source": "template", "rejected_because": rejected}
