"""Apply a policy to a table: one projection, whatever the number of columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import noise
from ..functions.techniques import ColumnRule, Settings, Site, needs_scale, rewrite

RULE_FIELDS = ("table_name", "column_name", "technique", "pii_type", "is_pii", "is_pk", "fk_table", "fk_column")


def rules_from(policy: DataFrame, table_name: str | None = None, strict: bool = False) -> list[ColumnRule]:
    """Policy rows as rules.  Bounded by the number of columns of the schema, never by data rows.

    Chains of foreign keys are resolved over the whole policy, also where the
    rules of one table are asked for: its columns must be replaced as their
    roots in other tables are.
    """
    rows = policy.select(*RULE_FIELDS).collect()
    rules = resolve_scopes(
        (
            ColumnRule(
                row["table_name"],
                row["column_name"],
                row["technique"],
                row["pii_type"],
                bool(row["is_pii"]),
                bool(row["is_pk"]),
                row["fk_table"],
                row["fk_column"],
            )
            for row in rows
        ),
        strict,
    )
    return [r for r in rules if table_name is None or r.table_name == table_name]


def resolve_scopes(rules: Iterable[ColumnRule], strict: bool = False) -> list[ColumnRule]:
    """Follow chains of foreign keys so that every column of a chain is replaced as the root is.

    A chain shares the root's scope, the column name and type that choose the
    kind of token, and the key flag: a referenced column counts as a key, unique
    or primary.  With ``strict``, a column whose technique differs from its
    root's is refused, because the keys would no longer meet.
    """
    rules = list(rules)
    declared = {(r.table_name, r.column_name): r for r in rules}
    referenced = {(r.fk_table, r.fk_column) for r in rules if r.fk_table}
    target = {
        (r.table_name, r.column_name): (r.fk_table, r.fk_column) for r in rules if r.fk_table
    }

    def root(start: tuple[str, str]) -> tuple[str, str]:
        seen, here = {start}, start
        while here in target and target[here] not in seen:
            here = target[here]
            seen.add(here)
        return here

    resolved = []
    for r in rules:
        if r.fk_table:
            table, column = root((r.table_name, r.column_name))
            r = replace(r, fk_table=table, fk_column=column)
            top = declared.get((table, column))
            if top is not None:
                mine, other = ((x.technique or "NO_CHANGE").strip().upper() for x in (r, top))
                if strict and mine != other:
                    raise ValueError(f"{r.table_name}.{r.column_name} has {mine}, its reference {table}.{column} has {other}")
                r = replace(r, pii_type=top.pii_type, root_name=column)
        if (r.table_name, r.column_name) in referenced:
            r = replace(r, referenced=True)
        resolved.append(r)
    return resolved


def row_text(columns: Iterable[str]) -> Column:
    """Text that identifies a row: its key columns around an unprintable separator, null as empty."""
    parts: list[Column] = []
    for name in columns:
        parts += [F.lit("\u0001"), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    return F.concat(*parts[1:])


def noise_scales(df: DataFrame, rules: Iterable[ColumnRule]) -> DataFrame:
    """One row holding the noise scale of every noisy column, in one aggregate."""
    types = {f.name: f.dataType for f in df.schema.fields}
    noisy = [r for r in rules if r.column_name in types and needs_scale(r, types[r.column_name])]
    return df.agg(
        *[noise.noise_scale(F.col(r.column_name).try_cast("double")).alias(r.column_name) for r in noisy]
    )


def frozen_scales(df: DataFrame, rules: Iterable[ColumnRule]) -> dict[str, float]:
    """The scales as numbers (one aggregate row), to be stored with a run and reused by its stream."""
    rules = list(rules)
    types = {f.name: f.dataType for f in df.schema.fields}
    if not any(r.column_name in types and needs_scale(r, types[r.column_name]) for r in rules):
        return {}
    return noise_scales(df, rules).first().asDict()


def apply_policy(
    df: DataFrame,
    table_name: str,
    rules: Iterable[ColumnRule],
    settings: Settings,
    row_key: Iterable[str] = (),
    scales: Mapping[str, float] | None = None,
) -> DataFrame:
    """Rewrite every column that has a rule; columns without one pass unchanged.

    The result is a single ``select`` over the scan.  Noise scales come from an
    uncorrelated scalar subquery (one aggregate row, no join); a stream passes
    the scales of its batch run instead.  ``row_key`` defaults to the primary
    key columns of the policy.
    """
    own = {r.column_name: r for r in resolve_scopes(rules, settings.strict) if r.table_name == table_name}
    if not own:
        return df
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = list(row_key) or [name for name, r in own.items() if r.is_primary_key]
    identity = row_text(keys) if keys else None
    noisy = [n for n, r in own.items() if n in types and needs_scale(r, types[n])]
    if noisy and scales is None:
        spread = noise_scales(df, own.values())
        holder = spread.select(F.struct(*noisy)).scalar()
        scale_of = {name: holder[name] for name in noisy}
    else:
        scale_of = {name: F.lit(float(scales[name])) for name in noisy}
    columns = []
    for name, dtype in types.items():
        value = F.col(name)
        if name in own:
            site = Site(value, dtype, own[name], settings, identity, scale_of.get(name))
            value = rewrite(site)
        columns.append(value.alias(name))
    return df.select(*columns)


def preview(
    df: DataFrame,
    table_name: str,
    rules: Iterable[ColumnRule],
    settings: Settings,
    row_key: Iterable[str] = (),
    limit: int = 5,
    scales: Mapping[str, float] | None = None,
) -> DataFrame:
    """Before and after, side by side, for the first rows by key (the review view)."""
    own = [r for r in resolve_scopes(rules, settings.strict) if r.table_name == table_name]
    keys = list(row_key) or [r.column_name for r in own if r.is_primary_key]
    if not keys:
        raise ValueError(f"a preview of {table_name} needs a row key: without an order its rows are not defined")
    sample = df.orderBy(*keys).limit(limit)
    shown = [r.column_name for r in own if r.column_name in df.columns]
    both = sample.select("*", *[F.col(c).alias(f"{c}__before") for c in shown])
    done = apply_policy(both, table_name, own, settings, keys, scales)
    order = [n for c in df.columns for n in ((f"{c}__before", c) if c in shown else (c,))]
    return done.select(*order)
