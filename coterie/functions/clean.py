"""Column expressions for identifiers and codes as feeds deliver them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, as the inside of a character class.
SPACE = r"\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Prefix of each identifier column.
PREFIX = {"card_fingerprint": "cfp", "device_fingerprint": "dev", "shipping_address_hash": "addr"}


def identifier_pattern(prefix: str) -> str:
    return rf'^[{SPACE}"]*(?i:{prefix})_([A-Za-z0-9]{{14}})[{SPACE}"]*$'


def identifier_body(name: str) -> Column:
    """The 14 characters of a real identifier in column ``name``, else null."""
    return F.nullif(F.regexp_extract(F.col(name), identifier_pattern(PREFIX[name]), 1), F.lit(""))


def identifier(name: str) -> Column:
    """The bare identifier with a lower-case prefix; null for anything that is not one."""
    return F.concat(F.lit(PREFIX[name] + "_"), identifier_body(name))


def code(col: Column | str) -> Column:
    """A code in lower case without surrounding white space; null stays null."""
    return F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, rf"^[{SPACE}]+|[{SPACE}]+$", ""))


def account_age() -> Column:
    """Days since sign-up, 0 at least; a missing day counts as age 0."""
    return F.greatest(F.col("day") - F.col("signup_day"), F.lit(0))
