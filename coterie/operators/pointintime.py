"""Features of a payment from strictly earlier payments of the same key.

A key that holds a third of all rows must not become one task. Rows are
therefore windowed by (key, span of time): trailing counts take the rows
shortly before a span along, running values add what the spans before it
carried over. Rows with a null key have no history: counts of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR, DAY = 3600, 86400
#: Trailing windows of each key, in seconds, with the short names of the features.
VELOCITY = {
    "customer_id": ("customer", {"1h": HOUR, "24h": DAY, "7d": 7 * DAY}),
    "device_fingerprint": ("device", {"1h": HOUR, "24h": DAY, "7d": 7 * DAY}),
    "card_fingerprint": ("card", {"1h": HOUR, "24h": DAY}),
    "ip": ("ip", {"1h": HOUR, "24h": DAY}),
    "shipping_address_hash": ("addr", {"24h": DAY, "7d": 7 * DAY}),
}
SPAN = 14 * DAY


def trailing_counts(df: DataFrame, key: str, windows: dict[str, int], span: int = SPAN, only: Column | None = None) -> DataFrame:
    """(payment_id, each window's name): rows of the same key with t - w <= t' < t.

    Rows of the same second are not counted, nor is the row itself. With
    ``only``, just the rows that fulfil it count and are counted for; all
    others get 0. Rows with a null key or time get 0.
    """
    widest = max(windows.values())
    reach = -(-widest // span)
    own = F.floor(F.col("created_at") / span)
    keyed = df.select("payment_id", key, "created_at", (F.lit(True) if only is None else F.coalesce(only, F.lit(False))).alias("counts"))
    usable = F.col(key).isNotNull() & F.col("created_at").isNotNull() & F.col("counts")
    # a row also stands in the later spans whose windows can reach back to it
    last = F.least(own + reach, F.floor((F.col("created_at") + widest) / span))
    rows = keyed.where(usable).select("payment_id", key, "created_at", own.alias("own"), F.explode(F.sequence(own, last)).alias("span"))
    w = Window.partitionBy(key, "span").orderBy("created_at")
    counted = rows.select("payment_id", "own", "span", *(F.count(F.lit(1)).over(w.rangeBetween(-s, -1)).alias(n) for n, s in windows.items())).where("own = span")
    zeros = keyed.where(~usable).select("payment_id", *(F.lit(0).cast("bigint").alias(n) for n in windows))
    return counted.select("payment_id", *windows).unionByName(zeros)


def running(df: DataFrame, key: str, sums: dict[str, Column], span: int = SPAN) -> DataFrame:
    """(payment_id, prior_n, prev_at, each sum): of the earlier rows of the same key.

    Earlier means before in (created_at, payment_id), so of rows of one second
    those with a smaller id count. ``prev_at`` is the time of the row before.
    Within a span of time rows are numbered and summed by a window; the spans
    before it, a few rows per key, are summed on their own and joined.
    """
    rows = df.where(F.col(key).isNotNull() & F.col("created_at").isNotNull()).select(
        "payment_id", F.col(key).alias("_key"), F.col("created_at").alias("_at"), F.floor(F.col("created_at") / span).alias("_span"), *(c.cast("double").alias(f"_v_{n}") for n, c in sums.items())
    )
    before = Window.partitionBy("_key", "_span").orderBy("_at", "payment_id")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select(
        "payment_id", "_key", "_span",
        (F.row_number().over(before) - 1).alias("_n_in"),
        F.lag("_at").over(before).alias("_prev_in"),
        *(F.coalesce(F.sum(f"_v_{n}").over(earlier), F.lit(0.0)).alias(f"_in_{n}") for n in sums),
    )
    per_span = rows.groupBy("_key", "_span").agg(F.count(F.lit(1)).alias("_n"), F.max("_at").alias("_last"), *(F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums))
    carried = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = per_span.select("_key", "_span", F.sum("_n").over(carried).alias("_n_base"), F.max("_last").over(carried).alias("_prev_base"), *(F.sum(f"_v_{n}").over(carried).alias(f"_base_{n}") for n in sums))
    return inside.join(base, ["_key", "_span"]).select(
        "payment_id",
        (F.col("_n_in") + F.coalesce("_n_base", F.lit(0))).alias("prior_n"),
        F.coalesce("_prev_in", "_prev_base").alias("prev_at"),
        *((F.col(f"_in_{n}") + F.coalesce(f"_base_{n}", F.lit(0.0))).alias(n) for n in sums),
    )


def first_of_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """The payment_ids that are the first of their pair (a, b), by an aggregation that combines before its shuffle."""
    first = F.min(F.struct("created_at", "payment_id")).alias("first")
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("created_at").isNotNull()).groupBy(a, b).agg(first).select("first.payment_id")


def flagged(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean column ``name``: whether its payment_id is among ``ids``."""
    return df.join(ids.withColumn(name, F.lit(True)), "payment_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def prior_distinct(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(payment_id, name): distinct non-null ``b`` under ``a`` among earlier rows."""
    return running(flagged(df, first_of_pair(df, a, b), "is_first"), a, {name: F.col("is_first").cast("int")}).select("payment_id", F.col(name).cast("bigint").alias(name))


def scalar_columns() -> list[Column]:
    """Features of the row itself."""
    c = F.col
    return [c("amount"), F.log1p("amount").alias("log_amount"), ((c("created_at") % DAY) / HOUR).alias("hour_of_day"), (c("day") % 7).alias("day_of_week"), c("account_age_days"), (c("amount") < 5000).cast("int").alias("is_micro_ticket")]


def scalars(df: DataFrame) -> DataFrame:
    """Features of the row itself, by payment."""
    return df.select("payment_id", *scalar_columns())


#: Pairs whose prior distinct counts are features: (under, what, name).
DISTINCT = (
    ("customer_id", "card_fingerprint", "prior_distinct_cards_customer"),
    ("customer_id", "device_fingerprint", "prior_distinct_devices_customer"),
    ("device_fingerprint", "card_fingerprint", "prior_distinct_cards_device"),
    ("device_fingerprint", "customer_id", "prior_distinct_customers_device"),
    ("shipping_address_hash", "customer_id", "prior_distinct_customers_address"),
)


def refunds_known(df: DataFrame) -> DataFrame:
    """(payment_id, prior_customer_refunds): earlier payments of the customer whose refund day has come.

    Refunds are events of their own: each counts from its refund day on. Per
    customer and day the refunds so far are a running sum over days, and a
    payment takes the value of the last such day that is not after its own.
    """
    refunds = df.where("customer_id is not null and refund_day >= 0").groupBy("customer_id", F.greatest("refund_day", "day").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = df.where("customer_id is not null and day is not null").select("customer_id", "day").distinct().withColumn("n", F.lit(0).cast("bigint")).withColumn("asked", F.lit(True))
    both = refunds.withColumn("asked", F.lit(False)).unionByName(days)
    so_far = Window.partitionBy("customer_id").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("refunds", F.sum("n").over(so_far)).where("asked").select("customer_id", "day", "refunds")
    # a refund on the day of its own payment is not of an earlier payment
    own = F.when((F.col("refund_day") >= 0) & (F.greatest("refund_day", "day") <= F.col("day")), 1).otherwise(0)
    return df.select("payment_id", "customer_id", "day", own.alias("own")).join(known, ["customer_id", "day"]).select("payment_id", (F.col("refunds") - F.col("own")).alias("prior_customer_refunds"))


#: The order of the keys in the combined plan; refunds are a kind of their own, by day.
KINDS = (*VELOCITY, "refunds")
LONGEST = 7 * DAY
_MEASURES = ("n", "failed", "amount", "seen_a", "seen_b")


def _key_events(df: DataFrame) -> DataFrame:
    """All that happens under a key, in one table: (kind, key, at, tie, marker, payment_id, measures, prev, trail, trail_new).

    A payment is an event under each of its keys. The first payment of a pair
    of ``DISTINCT`` is one more, marked event under the pair's first key, and
    sorts behind the payment itself. Refunds are events of their customer on
    their day, ahead of the payments that ask for them.
    """
    c, zero = F.col, F.lit(0.0)
    kind = {k: i for i, k in enumerate(KINDS)}
    timed = df.where("created_at is not null")
    keys = F.array(*(F.struct(F.lit(kind[k]).alias("kind"), F.col(k).alias("key")) for k in VELOCITY))
    failed = F.coalesce((c("status") == "failed").cast("double"), zero)
    paid = timed.select(F.inline(keys), c("created_at").alias("at"), "payment_id", failed.alias("failed"), F.coalesce("amount", zero).alias("amount")).where("key is not null")
    paid = paid.select("kind", "key", "at", c("payment_id").alias("tie"), F.lit(0).alias("marker"), "payment_id", F.lit(1.0).alias("n"), "failed", "amount", zero.alias("seen_a"), zero.alias("seen_b"), c("at").alias("prev"), F.lit(1).alias("trail"), F.lit(0).alias("trail_new"))

    # the pairs of one key are told apart as its first and second
    place: list[tuple[int, str]] = []
    for a, _, _ in DISTINCT:
        place.append((kind[a], "seen_a" if (kind[a], "seen_a") not in place else "seen_b"))
    new_card = next(i for i, (a, b, _) in enumerate(DISTINCT) if (a, b) == ("device_fingerprint", "card_fingerprint"))
    pairs = F.array(*(F.struct(F.lit(i).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b, _) in enumerate(DISTINCT)))
    first = timed.select(F.inline(pairs), "created_at", "payment_id").where("a is not null and b is not null").groupBy("pair", "a", "b").agg(F.min(F.struct("created_at", "payment_id")).alias("first"))
    of_pair = lambda want: F.when(c("pair").isin([i for i, (_, p) in enumerate(place) if p == want]), 1.0).otherwise(0.0).alias(want)
    kind_of = F.element_at(F.array(*(F.lit(k) for k, _ in place)), c("pair") + 1)
    marked = first.select(
        kind_of.alias("kind"), c("a").alias("key"), c("first.created_at").alias("at"), c("first.payment_id").alias("tie"), F.lit(1).alias("marker"), c("first.payment_id").alias("payment_id"), zero.alias("n"), zero.alias("failed"), zero.alias("amount"),
        of_pair("seen_a"), of_pair("seen_b"), F.lit(None).cast("bigint").alias("prev"), F.lit(0).alias("trail"), (c("pair") == new_card).cast("int").alias("trail_new"),
    )

    due = F.when(c("refund_day") >= 0, F.greatest("refund_day", "day"))
    asks = F.array(F.struct(due.alias("on"), F.lit(0).alias("marker")), F.struct(c("day").alias("on"), F.lit(1).alias("marker")))
    refunds = df.where("customer_id is not null").select(c("customer_id").alias("key"), "payment_id", F.inline(asks)).where("on is not null")
    refunds = refunds.select(
        F.lit(kind["refunds"]).alias("kind"), "key", (c("on").cast("bigint") * DAY).alias("at"), F.lit("").alias("tie"), "marker", "payment_id", (1.0 - c("marker")).alias("n"), zero.alias("failed"), zero.alias("amount"), zero.alias("seen_a"), zero.alias("seen_b"),
        F.lit(None).cast("bigint").alias("prev"), F.lit(0).alias("trail"), F.lit(0).alias("trail_new"),
    )
    return paid.unionByName(marked).unionByName(refunds)


def tabular_features(df: DataFrame, span: int = SPAN) -> DataFrame:
    """All features of the tabular block, one row per payment. ``df`` is read several times: give a written table.

    Every key's events go through one shuffle by (kind, key, span of time).
    What the spans before carried over joins them as one more row at the head
    of its span, rows shortly before a span are copied into it for the
    trailing counts, and one aggregation by payment puts the results together.
    """
    c = F.col
    events = _key_events(df).withColumn("span", F.floor(c("at") / span))
    key = ("kind", "key")
    per_span = events.groupBy(*key, "span").agg(*(F.sum(m).alias(m) for m in _MEASURES), F.max("prev").alias("prev"))
    carried = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    head = per_span.select(
        *key, F.lit(-(2**62)).alias("at"), F.lit("").alias("tie"), F.lit(-1).alias("marker"), F.lit(None).cast("string").alias("payment_id"), *(F.coalesce(F.sum(m).over(carried), F.lit(0.0)).alias(m) for m in _MEASURES), F.max("prev").over(carried).alias("prev"), F.lit(0).alias("trail"), F.lit(0).alias("trail_new"), "span", F.lit(False).alias("own")
    )
    reach = F.least(c("span") + -(-LONGEST // span), F.floor((c("at") + LONGEST) / span))
    last = F.when((c("trail") + c("trail_new")) > 0, reach).otherwise(c("span"))
    placed = events.withColumn("at_span", F.explode(F.sequence("span", last))).withColumn("own", c("span") == c("at_span"))
    placed = placed.select(*key, "at", "tie", "marker", "payment_id", *(F.when(c("own"), c(m)).otherwise(0.0).alias(m) for m in _MEASURES), F.when(c("own"), c("prev")).alias("prev"), "trail", "trail_new", c("at_span").alias("span"), "own")
    group = Window.partitionBy(*key, "span")
    before = group.orderBy("at", "tie", "marker").rowsBetween(Window.unboundedPreceding, -1)
    within = lambda seconds: group.orderBy("at").rangeBetween(-seconds, -1)
    seen = placed.unionByName(head).select(
        "kind", "marker", "payment_id", "own", "trail_new", *(F.sum(m).over(before).alias(m) for m in _MEASURES), F.max("prev").over(before).alias("prev"),
        *(F.coalesce(F.sum("trail").over(within(s)), F.lit(0)).alias(f"t_{n}") for n, s in (("1h", HOUR), ("24h", DAY), ("7d", 7 * DAY))),
        *(F.coalesce(F.sum("trail_new").over(within(s)), F.lit(0)).alias(f"new_{n}") for n, s in (("24h", DAY), ("7d", 7 * DAY))),
    ).where("own")

    number = {k: i for i, k in enumerate(KINDS)}

    def take(kind: str, column: str, marker: int = 0, more: Column | None = None) -> Column:
        here = (c("kind") == number[kind]) & (c("marker") == marker)
        return F.max(F.when(here if more is None else here & more, c(column)))

    whole = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    columns = {
        "prior_n": take("customer_id", "n"), "failures": take("customer_id", "failed"), "amounts": take("customer_id", "amount"), "prev_customer": take("customer_id", "prev"), "prev_device": take("device_fingerprint", "prev"), "refunds_due": take("refunds", "n", 1),
        **{f"new_cards_on_device_{n}": whole(take("device_fingerprint", f"new_{n}", 1, c("trail_new") == 1)) for n in ("24h", "7d")},
        **{f"vel_{short}_{n}": whole(take(k, f"t_{n}")) for k, (short, windows) in VELOCITY.items() for n in windows},
    }
    used: set[str] = set()
    for a, _, name in DISTINCT:
        columns[name] = whole(take(a, "seen_b" if a in used else "seen_a"))
        used.add(a)
    per = seen.groupBy("payment_id").agg(*(x.alias(n) for n, x in columns.items()))

    # a refund on the day of its own payment is not of an earlier payment
    own_refund = F.when((c("refund_day") >= 0) & (F.greatest("refund_day", "day") <= c("day")), 1).otherwise(0)
    levels = (F.coalesce(x, F.lit("__none__")).alias(x) for x in ("method", "card_network", "card_type", "card_issuer", "city"))
    own = df.select("payment_id", "created_at", own_refund.alias("own_refund"), *scalar_columns(), *levels)
    out = own.join(per, "payment_id", "left")
    zeros = [n for n in columns if n.startswith(("vel_", "new_")) or n in [name for *_, name in DISTINCT]]
    n = F.nullif("prior_customer_payments", F.lit(0))
    return (
        out.withColumns({z: F.coalesce(z, F.lit(0).cast("bigint")) for z in zeros})
        .withColumn("prior_customer_payments", whole(c("prior_n")))
        .withColumn("prior_customer_refunds", whole(c("refunds_due") - c("own_refund")))
        .withColumns(
            {
                "prior_customer_failures": F.coalesce("failures", F.lit(0.0)),
                "prior_customer_failure_rate": F.coalesce(c("failures") / n, F.lit(0.0)),
                "prior_customer_refund_rate": F.coalesce(c("prior_customer_refunds") / n, F.lit(0.0)),
                "amount_z_vs_customer": F.when(c("amounts") / n > 0, c("amount") / (c("amounts") / n)).otherwise(1.0),
                "seconds_since_prev_customer": c("created_at") - c("prev_customer"),
                "seconds_since_prev_device": c("created_at") - c("prev_device"),
            }
        )
        .drop("prior_n", "failures", "amounts", "prev_customer", "prev_device", "created_at", "refunds_due", "own_refund")
    )
