"""Tokens and pseudonyms: realistic replacements that are a function of the value.

A replacement is picked by a keyed digest of (scope, value), so equal values of
one scope get equal replacements in every table, task and run without a shared
mapping store.  One SHA-256 per value feeds all parts through its 52-bit slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pools
from .digests import keyed_digest, slice52

UNIQUE_DIGITS = 32  # hex digits appended where two values must never share a token (128 bits)

# Exact column names that make a token a person's name.
NAME_COLUMNS = ("first_name", "last_name", "full_name", "emergency_contact_name", "beneficiary_name")
ROW_NAME_COLUMNS = ("first_name", "last_name", "full_name")


def pick(pool: Sequence[str], digest: Column, slot: int = 0) -> Column:
    position = F.pmod(slice52(digest, slot), F.lit(len(pool))) + 1
    words = F.split(F.lit("|".join(pool)), r"\|")  # folded to one constant array by the optimizer
    return F.element_at(words, position.cast("int"))


def first_name(digest: Column) -> Column:
    return pick(pools.FIRST_NAMES, digest, 0)


def last_name(digest: Column) -> Column:
    return pick(pools.LAST_NAMES, digest, 1)


def full_name(digest: Column) -> Column:
    return F.concat(first_name(digest), F.lit(" "), last_name(digest))


def email(digest: Column) -> Column:
    number = F.pmod(slice52(digest, 2), F.lit(10000)).cast("string")
    return F.concat(
        F.lower(first_name(digest)), F.lit("."), F.lower(last_name(digest)), number,
        F.lit("@"), pick(pools.MAIL_DOMAINS, digest, 3),
    )


def phone(digest: Column) -> Column:
    """``+91`` and ten digits, the first between 6 and 9."""
    lead = (F.pmod(slice52(digest, 0), F.lit(4)) + 6).cast("string")
    rest = F.lpad(F.pmod(slice52(digest, 1), F.lit(1_000_000_000)).cast("string"), 9, "0")
    return F.concat(F.lit("+91 "), lead, rest)


def pincode(digest: Column) -> Column:
    return (F.pmod(slice52(digest, 0), F.lit(900_000)) + 100_000).cast("string")


def city(digest: Column) -> Column:
    return pick(pools.CITIES, digest, 0)


def state(digest: Column) -> Column:
    return pick(pools.STATES, digest, 0)


def address(digest: Column) -> Column:
    number = (F.pmod(slice52(digest, 2), F.lit(999)) + 1).cast("string")
    return F.concat(
        number, F.lit(" "), pick(pools.STREETS, digest, 1), F.lit(", "), city(digest)
    )


def word(digest: Column) -> Column:
    return pick(pools.WORDS, digest, 0)


TOKEN_BUILDERS = {
    "first_name": first_name,
    "last_name": last_name,
    "full_name": full_name,
    "email": email,
    "phone": phone,
    "city": city,
    "state": state,
    "pincode": pincode,
    "address": address,
    "word": word,
}


def token_kind(pii_type: str | None, column_name: str) -> str:
    """Which builder a tokenized column gets; the first matching test wins."""
    kind, low = (pii_type or "").upper(), column_name.lower()
    if kind == "FULL_NAME" or column_name in NAME_COLUMNS:
        return column_name if column_name in ("first_name", "last_name") else "full_name"
    if kind == "EMAIL" or "email" in low:
        return "email"
    if kind in ("PHONE", "INDIAN_PHONE") or "phone" in low or "contact" in low:
        return "phone"
    if column_name in ("city", "state", "pincode"):
        return column_name
    if kind == "LOCATION":
        return "city"
    if kind == "ADDRESS" or "address" in low:
        return "address"
    return "word"


def pseudonym_kind(pii_type: str | None, column_name: str) -> str:
    kind, low = (pii_type or "").upper(), column_name.lower()
    if kind == "FULL_NAME" or "name" in low:
        return "full_name"
    if kind == "EMAIL" or "email" in low:
        return "email"
    return "word"


def with_unique_tail(text: Column, digest: Column) -> Column:
    """Make a pool token injective by appending half of its digest."""
    return F.concat(text, F.lit("-"), F.right(digest, F.lit(UNIQUE_DIGITS)))


def build(kind: str, text: Column, key: str, scope: str, unique: bool = False) -> Column:
    digest = keyed_digest(text, key, scope)
    token = TOKEN_BUILDERS[kind](digest)
    return with_unique_tail(token, digest) if unique else token


def row_name(kind: str, row_key: Column, key: str, table_name: str) -> Column:
    """Name parts of one row agree: all are derived from the row's key, not from the value."""
    return TOKEN_BUILDERS[kind](keyed_digest(row_key, key, f"{table_name}#row"))
