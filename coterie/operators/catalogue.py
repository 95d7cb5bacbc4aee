"""What each model feature tells: of whom, about what, and in which sentence.

Subject and aspect of a feature follow from its name by the rules below; the
features of one subject and aspect make one reason group. A feature with a
sentence can be quoted. Analysts and merchants read the same sentences.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Who a feature tells about, by the first pattern its name matches.
SUBJECTS = (
    (r"^src_", "source"),
    (r"^g_", "links"),
    (r"^(cl_|clsig_|size$|edges$|density$|mean_edge|max_edge)", "cluster"),
    (r"^vel_ip", "connection"),
    (r"^vel_card", "card"),
    (r"(^vel_addr|_address$)", "address"),
    (r"(^vel_device|_device$|on_device)", "device"),
    (r"(^vel_customer|_customer$|^prior_customer|^account)", "account"),
    (r"", "payment"),
)
#: What a feature tells, by the first pattern its name matches.
ASPECTS = (
    (r"^src_", "counters"),
    (r"fail|decline", "declines"),
    (r"refund", "refunds"),
    (r"amount|ticket", "amounts"),
    (r"distinct|new_cards|(card|customer|issuer)s_per|fanout|concentration", "sharing"),
    (r"account_age|signup|first_seen|new_account|fresh|cohort", "age"),
    (r"^vel_|seconds|burst|active|day_span|last_seen|payments", "tempo"),
    (r"hour|day_of", "moment"),
    (r"^(method|card_|city)", "means"),
    (r"", "ties"),
)


def _first(rules: tuple[tuple[str, str], ...], name: str) -> str:
    return next(word for pattern, word in rules if re.search(pattern, name))


def group_of(name: str) -> str:
    """The reason group of a feature, as 'aspect of subject'."""
    return f"{_first(ASPECTS, name)} of {_first(SUBJECTS, name)}"


def from_graph(group: str) -> bool:
    return group.endswith((" of links", " of cluster"))


def groups(names: list[str]) -> dict[str, list[str]]:
    """The features of each reason group; each feature stands in exactly one."""
    out: dict[str, list[str]] = {}
    for n in names:
        out.setdefault(group_of(n), []).append(n)
    return out


@dataclass(frozen=True)
class Sentence:
    """How the value ``{n}`` of a feature is told, of one and of more; ``unit`` is count, ratio, share or money."""

    feature: str
    one: str
    many: str
    unit: str = "count"


#: Features that can be quoted; within a group those that come first are tried first.
SENTENCES = (
    Sentence("vel_device_24h", "this device paid once in the day before", "this device paid {n} times in the day before"),
    Sentence("vel_customer_24h", "this account paid once in the day before", "this account paid {n} times in the day before"),
    Sentence("vel_card_24h", "this card paid once in the day before", "this card paid {n} times in the day before"),
    Sentence("vel_ip_24h", "this connection paid once in the day before", "this connection paid {n} times in the day before"),
    Sentence("vel_addr_7d", "one order went to this address in the week before", "{n} orders went to this address in the week before"),
    Sentence("new_cards_on_device_24h", "a card was new on this device in the day before", "{n} cards were new on this device in the day before"),
    Sentence("prior_distinct_cards_device", "one card had paid from this device", "{n} cards had paid from this device"),
    Sentence("prior_distinct_customers_device", "one account had used this device", "{n} accounts had used this device"),
    Sentence("prior_distinct_cards_customer", "this account had paid by one card", "this account had paid by {n} cards"),
    Sentence("prior_distinct_devices_customer", "this account had used one device", "this account had used {n} devices"),
    Sentence("prior_distinct_customers_address", "one account had ordered to this address", "{n} accounts had ordered to this address"),
    Sentence("prior_customer_failures", "a payment of this account had failed", "{n} payments of this account had failed"),
    Sentence("prior_customer_refunds", "a payment of this account had been refunded", "{n} payments of this account had been refunded"),
    Sentence("prior_customer_payments", "this account had paid once", "this account had paid {n} times"),
    Sentence("account_age_days", "the account is one day old", "the account is {n} days old"),
    Sentence("amount_z_vs_customer", "the amount is what this account pays on average", "the amount is {n} times what this account pays on average", "ratio"),
    Sentence("amount", "the amount is {n}", "the amount is {n}", "money"),
    Sentence("g_degree", "a detail is shared with one other account", "details are shared with {n} other accounts"),
    Sentence("cl_customers", "one account is tied by shared details", "{n} accounts are tied by shared details"),
    Sentence("cl_cards_per_device", "the tied accounts used one card per device", "the tied accounts used {n} cards per device", "ratio"),
    Sentence("cl_customers_per_address", "the tied accounts have an address each", "{n} of the tied accounts come on each address", "ratio"),
    Sentence("cl_failure_rate", "all payments of the tied accounts failed", "{n} of the payments of the tied accounts failed", "share"),
    Sentence("cl_payments_per_active_day", "the tied accounts pay once on a day", "the tied accounts pay {n} times on a day", "ratio"),
    Sentence("cl_signup_span", "the tied accounts were opened within a day", "the tied accounts were opened within {n} days"),
)
