"""Generalization and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def generalize_kind(pii_type: str | None, column_name: str) -> str:
    """Category of a column.  An address type is tested before the pin code name."""
    kind, low = (pii_type or "").upper(), column_name.lower()
    if column_name in ("city", "state"):
        return column_name
    if kind == "ADDRESS":
        return "location"
    if "pincode" in low:
        return "pincode"
    if kind == "DATE_OF_BIRTH" or "date_of_birth" in low or "dob" in low:
        return "birth"
    return "other"


def generalize(
    text: Column, pii_type: str | None, column_name: str, year: Column | None = None
) -> Column:
    """Category of a value.  ``year`` (of a real date) spares formatting the date first."""
    kind = generalize_kind(pii_type, column_name)
    if kind == "pincode":
        region = F.concat(F.left(text, F.lit(3)), F.lit("XXX"))
        return F.when(F.length(text) >= 3, region).otherwise(F.lit("XXXXXX"))
    if kind == "birth" and year is not None:
        return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-XX-XX"))
    if kind == "birth":
        start = F.concat(F.left(text, F.lit(4)), F.lit("-XX-XX"))
        return F.when(F.length(text) >= 4, start).otherwise(F.lit("XXXX-XX-XX"))
    fixed = {"city": "CITY", "state": "STATE", "location": "LOCATION", "other": "GENERALIZED"}
    return F.lit(fixed[kind])


def redact() -> Column:
    return F.lit("REDACTED")
