"""Technique registry: from a column rule to the expression that rewrites the column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import digests, generalize, masks, noise, tokens


@dataclass(frozen=True)
class ColumnRule:
    """One row of a policy."""

    table_name: str
    column_name: str
    technique: str = "NO_CHANGE"
    pii_type: str | None = None
    is_pii: bool = True
    is_primary_key: bool = False
    fk_table: str | None = None
    fk_column: str | None = None
    referenced: bool = False  # another column refers to this one
    root_name: str | None = None  # column name at the end of the chain of references

    @property
    def is_key(self) -> bool:
        return self.is_primary_key or self.fk_table is not None or self.referenced

    @property
    def kind_name(self) -> str:
        """The column name that chooses the kind of replacement."""
        return self.root_name or self.column_name

    @property
    def scope(self) -> str:
        """Equal values of one scope get equal replacements: an FK shares its target's scope."""
        if self.fk_table is not None:
            return f"{self.fk_table}.{self.fk_column}"
        return f"{self.table_name}.{self.column_name}"


@dataclass(frozen=True)
class Settings:
    """Run-wide choices.  The secret is always passed in; there is no default."""

    secret: str = field(repr=False)
    strict: bool = True  # unknown or key-merging techniques raise instead of passing values through
    keyed_hash: bool = False  # HASHING with the secret, safe for small domains
    row_names: bool = False  # first, last and full name of a row agree
    date_noise_days: float | None = None
    key: str = field(default="", repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "key", digests.derive_key(self.secret))


@dataclass(frozen=True)
class Site:
    """What a builder sees: the column, its type, its rule and its row."""

    value: Column
    dtype: T.DataType
    rule: ColumnRule
    settings: Settings
    row_key: Column | None = None  # text that identifies the row
    scale: Column | None = None  # noise scale

    @property
    def text(self) -> Column:
        return digests.text_of(self.value, self.dtype)

    @property
    def shown(self) -> Column:
        """The value as text for display-only techniques; any type is fine."""
        return self.value.cast("string")


Builder = Callable[[Site], Column]
_REGISTRY: dict[str, Builder] = {}

DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
TIME_TYPES = tuple(t().simpleString() for t in DATES)

# Techniques that leave a column as it is.
KEEP = ("NO_CHANGE", "NONE", "PASSTHROUGH")


def register_technique(name: str) -> Callable[[Builder], Builder]:
    """Add a technique; the builder must return a ``Column`` expression."""

    def add(builder: Builder) -> Builder:
        _REGISTRY[name.upper()] = builder
        return builder

    return add


def known_techniques() -> tuple[str, ...]:
    return (*KEEP, *_REGISTRY)


@register_technique("HASHING")
def _hashing(site: Site) -> Column:
    if site.settings.keyed_hash:
        return digests.keyed_digest(site.text, site.settings.key)
    return digests.sha256_hex(site.text)


@register_technique("MASKING")
def _masking(site: Site) -> Column:
    return masks.mask(site.shown, site.rule.pii_type, site.rule.column_name)


@register_technique("TOKENIZATION")
def _tokenization(site: Site) -> Column:
    rule, settings = site.rule, site.settings
    if (
        settings.row_names
        and site.row_key is not None
        and not rule.is_key
        and rule.column_name in tokens.ROW_NAME_COLUMNS
    ):
        return tokens.row_name(rule.column_name, site.row_key, settings.key, rule.table_name)
    kind = tokens.token_kind(rule.pii_type, rule.kind_name)
    if kind == "word" and not isinstance(site.dtype, T.StringType):
        if rule.is_key and settings.strict:
            raise ValueError(f"no token form for key {rule.scope}; use HASHING")
        return site.value
    return tokens.build(kind, site.text, settings.key, rule.scope, unique=rule.is_key)


@register_technique("PSEUDONYMIZATION")
def _pseudonymization(site: Site) -> Column:
    rule = site.rule
    kind = tokens.pseudonym_kind(rule.pii_type, rule.kind_name)
    scope = f"{rule.scope}#pseudonym"
    return tokens.build(kind, site.text, site.settings.key, scope, unique=rule.is_key)


@register_technique("GENERALIZATION")
def _generalization(site: Site) -> Column:
    year = F.year(site.value) if isinstance(site.dtype, DATES) else None
    return generalize.generalize(site.shown, site.rule.pii_type, site.rule.column_name, year)


@register_technique("REDACTION")
def _redaction(site: Site) -> Column:
    return generalize.redact()


@register_technique("DIFFERENTIAL_PRIVACY")
def _noise(site: Site) -> Column:
    rule = site.rule
    if site.row_key is None:
        raise ValueError(f"noise on {rule.table_name}.{rule.column_name} needs a row key")
    text = F.concat(
        F.lit(f"{site.settings.key}|{rule.table_name}.{rule.column_name}|"), site.row_key
    )
    if isinstance(site.dtype, DATES):
        if site.settings.date_noise_days is None:
            raise ValueError(
                f"noise on date column {rule.table_name}.{rule.column_name}: set date_noise_days"
            )
        return noise.shift_date(site.value, text, site.settings.date_noise_days, not isinstance(site.dtype, T.DateType))
    number = site.value.try_cast("double")
    return noise.add_noise(number, text, site.scale, rule.pii_type, rule.column_name)


# Techniques under which two key values may become one.
MERGING = ("MASKING", "GENERALIZATION", "REDACTION", "DIFFERENTIAL_PRIVACY")


def needs_scale(rule: ColumnRule, dtype: T.DataType) -> bool:
    return (rule.technique or "NO_CHANGE").strip().upper() == "DIFFERENTIAL_PRIVACY" and not isinstance(dtype, DATES)


def rewrite(site: Site) -> Column:
    """The expression of one column: null and empty values pass through, NaN counts as null."""
    rule, settings = site.rule, site.settings
    technique = (rule.technique or "NO_CHANGE").strip().upper()
    if technique in KEEP:
        return site.value
    builder = _REGISTRY.get(technique)
    if builder is None:
        if settings.strict:
            raise ValueError(f"unknown technique {technique!r} on {rule.scope}")
        return site.value
    if rule.is_key and technique in MERGING and settings.strict:
        raise ValueError(f"{technique} would merge values of key {rule.scope}")
    replaced = builder(site)
    if technique == "DIFFERENTIAL_PRIVACY":
        return replaced  # null stays null through the arithmetic; text that is no number becomes null
    if replaced is site.value:
        return replaced
    if isinstance(site.dtype, T.StringType):
        return F.when(site.value.isNull() | (site.value == ""), site.value).otherwise(replaced)
    present = site.value.isNotNull()
    if isinstance(site.dtype, T.DoubleType | T.FloatType):
        present = present & ~F.isnan(site.value)
    return F.when(present, replaced)


def destination_type(source_type: str, technique: str | None) -> str:
    """Type name of a column after the technique; dates and times under noise stay what they are."""
    name = (technique or "NO_CHANGE").strip().upper()
    if name in KEEP or name == "DIFFERENTIAL_PRIVACY" and source_type.strip().lower() in TIME_TYPES:
        return source_type
    return "NUMERIC" if name == "DIFFERENTIAL_PRIVACY" else "TEXT"


def destination_type_column(source_type: Column, technique: Column) -> Column:
    """The same rule over a policy table."""
    name = F.upper(F.trim(F.coalesce(technique, F.lit("NO_CHANGE"))))
    moved = (name == "DIFFERENTIAL_PRIVACY") & F.lower(F.trim(source_type)).isin(*TIME_TYPES)
    return (
        F.when(name.isin(*KEEP) | moved, source_type)
        .when(name == "DIFFERENTIAL_PRIVACY", F.lit("NUMERIC"))
        .otherwise(F.lit("TEXT"))
    )
