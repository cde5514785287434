"""Pattern rules: identifiers as whole values, and leaks anywhere in a text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier rules in detector order.  ``on`` names the form of the
# value that is tested: as written, upper-cased, or without blanks and hyphens.
# Whole-value rules are anchored with \A and \z: ``$`` would accept a trailing newline.


@dataclass(frozen=True)
class ValueRule:
    name: str
    confidence: float
    on: str
    regex: str
    technique: str


VALUE_RULES = (
    ValueRule("aadhaar", 0.95, "raw", r"\A\d{4}[\s-]?\d{4}[\s-]?\d{4}\z", "masking"),
    ValueRule("pan", 0.98, "upper", r"\A[A-Z]{5}[0-9]{4}[A-Z]\z", "masking"),
    ValueRule("indian_phone", 0.90, "compact", r"\b(\+91[-\s]?|91)?[6-9]\d{9}\b", "tokenization"),
    ValueRule(
        "gstin", 0.95, "upper", r"\A[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\z", "masking"
    ),
    ValueRule("indian_passport", 0.60, "upper", r"\A[A-Z][0-9]{7}\z", "masking"),
    ValueRule(
        "driving_license",
        0.75,
        "upper",
        r"\A(?:[A-Z]{2}[0-9]{2}[A-Z0-9]+|DL[-\s]?[0-9]{2}[-\s]?[0-9]{11})\z",
        "masking",
    ),
    ValueRule("voter_id", 0.80, "upper", r"\A[A-Z]{3}[0-9]{7}\z", "masking"),
    ValueRule("uan", 0.85, "raw", r"\A\d{12}\z", "masking"),
)
COMPACT_AADHAAR = r"\A\d{12}\z"

# Column-name context and its effect on the confidence.
AADHAAR_NAMES = ("aadhaar", "uid", "uidai")
UAN_NAMES = ("uan", "epfo", "pf", "provident")
BOOST, PENALTY, CEILING = 0.10, 0.30, 0.99

TECHNIQUE_OF = {rule.name: rule.technique for rule in VALUE_RULES}

# Leak patterns, searched anywhere in a text.
LEAK_PATTERNS = {
    "AADHAAR": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    "PAN": r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"\b(?:\+?91)?[ -]?[6-9]\d{4}[ -]?\d{5}\b",
    "GSTIN": r"\b\d{2}[A-Z]{5}\d{4}[A-Z]{1}[A-Z\d]{1}[Z]{1}[A-Z\d]{1}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,16}\b",
}


def any_of(text: Column, parts: tuple[str, ...] | list[str]) -> Column:
    """True when the text contains one of the parts."""
    test = text.contains(parts[0])
    for part in parts[1:]:
        test = test | text.contains(part)
    return test


def rule_matches(rule: ValueRule, value: Column) -> Column:
    stripped = F.regexp_replace(value, "[ -]", "")
    if rule.name == "aadhaar":
        return value.rlike(rule.regex) | stripped.rlike(COMPACT_AADHAAR)
    subject = {"raw": value, "upper": F.upper(value), "compact": stripped}[rule.on]
    return subject.rlike(rule.regex)


def rule_confidence(rule: ValueRule, column_name: Column | None) -> Column:
    base = F.lit(rule.confidence)
    if column_name is None or rule.name not in ("aadhaar", "uan"):
        return base
    low = F.lower(column_name)
    own, other = (
        (AADHAAR_NAMES, UAN_NAMES) if rule.name == "aadhaar" else (UAN_NAMES, AADHAAR_NAMES)
    )
    raised = F.least(F.lit(CEILING), base + F.lit(BOOST))
    lowered = F.greatest(F.lit(0.0), base - F.lit(PENALTY))
    return F.when(any_of(low, own), raised).when(any_of(low, other), lowered).otherwise(base)


def matches_of(value: Column, column_name: Column | None = None) -> Column:
    """All identifier matches of a value: ``array<struct<ord, pii_type, confidence>>``."""
    found = [
        F.when(
            rule_matches(rule, value),
            F.struct(
                F.lit(order).alias("ord"),
                F.lit(rule.name).alias("pii_type"),
                rule_confidence(rule, column_name).alias("confidence"),
            ),
        )
        for order, rule in enumerate(VALUE_RULES)
    ]
    return F.array_compact(F.array(*found))


def best_match(value: Column, column_name: Column | None = None) -> Column:
    """The most confident match; the earlier detector wins a tie; null when nothing matches."""
    ranked = F.transform(
        matches_of(value, column_name),
        lambda m: F.struct(
            m["confidence"].alias("confidence"), (-m["ord"]).alias("rank"), m["pii_type"].alias("pii_type")
        ),
    )
    return F.array_max(ranked)


# What a text must hold for a pattern to be worth trying; each is implied by the pattern itself.
# A run of four digits is part of every match of five patterns; a card number may be written digit
# by digit.  The guard is one cheap search that all patterns of a text share.
_FOUR_DIGITS, _ONE_DIGIT = r"[0-9]{4}", r"[0-9]"


def _worth_trying(text: Column, pattern: str) -> Column:
    if pattern == "EMAIL":
        return text.contains("@")
    return text.rlike(_ONE_DIGIT if pattern == "CREDIT_CARD" else _FOUR_DIGITS)


def leak_hit(text: Column, pattern: str) -> Column:
    """True when the text holds the pattern."""
    return _worth_trying(text, pattern) & text.rlike(LEAK_PATTERNS[pattern])


def leak_count(text: Column, pattern: str) -> Column:
    """Number of occurrences of the pattern in the text."""
    count = F.regexp_count(text, F.lit(LEAK_PATTERNS[pattern]))
    return F.when(_worth_trying(text, pattern), count).otherwise(F.lit(0))
