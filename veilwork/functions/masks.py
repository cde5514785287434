"""Masking expressions: hide part of a value, keep its shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which masker a column gets.  Tested in this order; an entry
# matches when the PII type equals the first or the column name contains the second.
MASKER_ORDER = (
    ("AADHAAR", "aadhaar"),
    ("PAN", "pan"),
    ("GSTIN", "gstin"),
    ("CREDIT_CARD", "credit"),
    ("BANK_ACCOUNT", "account"),
    ("DRIVING_LICENSE", "license"),
    ("UAN", "uan"),
)


def compact(text: Column) -> Column:
    """Drop blanks and hyphens."""
    return F.regexp_replace(text, r"[\s-]", "")


def hide_all(text: Column) -> Column:
    return F.repeat(F.lit("X"), F.length(text))


def hide_tail(text: Column, n: int) -> Column:
    """Replace the last ``n`` characters of the compact text; hide short values whole."""
    clean = compact(text)
    size = F.length(clean)
    return F.when(
        size >= n, F.concat(F.substr(clean, F.lit(1), size - n), F.lit("X" * n))
    ).otherwise(hide_all(clean))


def keep_tail(text: Column, n: int) -> Column:
    """Keep only the last ``n`` characters of the compact text."""
    clean = compact(text)
    size = F.length(clean)
    return F.when(
        size >= n, F.concat(F.repeat(F.lit("X"), size - n), F.right(clean, F.lit(n)))
    ).otherwise(hide_all(clean))


def mask_aadhaar(text: Column) -> Column:
    """Hide the last four digits; values written with blanks come back in groups of four."""
    masked = hide_tail(text, 4)
    grouped = F.rtrim(F.regexp_replace(masked, "(.{4})", "$1 "))
    regroup = text.contains(" ") & (F.length(compact(text)) >= 4)
    return F.when(regroup, grouped).otherwise(masked)


MASKERS: dict[str, Callable[[Column], Column]] = {
    "AADHAAR": mask_aadhaar,
    "PAN": lambda t: hide_tail(t, 4),
    "GSTIN": lambda t: hide_tail(t, 5),
    "CREDIT_CARD": lambda t: keep_tail(t, 4),
    "BANK_ACCOUNT": lambda t: keep_tail(t, 4),
    "DRIVING_LICENSE": lambda t: hide_tail(t, 4),
    "UAN": lambda t: hide_tail(t, 4),
}


def masker_for(pii_type: str | None, column_name: str) -> str | None:
    """Name of the masker of a column, or ``None`` for the hide-everything default."""
    kind, low = (pii_type or "").upper(), column_name.lower()
    for name, fragment in MASKER_ORDER:
        if kind == name or fragment in low:
            return name
    return None


def mask(text: Column, pii_type: str | None, column_name: str) -> Column:
    name = masker_for(pii_type, column_name)
    return MASKERS[name](text) if name else hide_all(text)


def edge_mask(text: Column) -> Column:
    """First and last character around ``***``; for an e-mail only inside the local part."""

    def edges(part: Column) -> Column:
        last = F.when(F.length(part) > 1, F.right(part, F.lit(1))).otherwise(F.lit(""))
        return F.concat(F.left(part, F.lit(1)), F.lit("***"), last)

    pieces = F.split(text, "@")
    mail = F.concat(edges(F.get(pieces, 0)), F.lit("@"), F.get(pieces, 1))
    return F.when(text.contains("@"), mail).otherwise(edges(text))


def preview_email(text: Column) -> Column:
    """Review preview of an e-mail: two leading characters and the domain."""
    pieces = F.split(text, "@")
    local, domain = F.get(pieces, 0), F.get(pieces, 1)
    shown = F.when(F.length(local) > 2, F.left(local, F.lit(2))).otherwise(F.lit(""))
    return F.when(F.size(pieces) == 2, F.concat(shown, F.lit("***@"), domain)).otherwise(
        F.lit("***")
    )


def preview_token(text: Column) -> Column:
    return F.concat(F.lit("[TOK_"), F.upper(F.left(text, F.lit(3))), F.lit("_948]"))
