"""Registration of queries and small SQL helpers for their reference statements."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.digests import HEX_SLICE, derive_key
from ..functions.techniques import Settings
from ..session import keep_methods_compiled
from ..sources.tables import read_table, spread_small

SECRET = "query-secret"  # an argument of the registered queries, not a credential
SETTINGS = Settings(SECRET)
KEY = derive_key(SECRET)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The input tables of one scale, read lazily by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._folder = spark, folder
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = read_table(self.spark, self._folder, name)
        return self._read[name]

    def spread(self, name: str) -> DataFrame:
        """A table for row-wise heavy work: every core gets a share even of a small file."""
        return spread_small(getattr(self, name))


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    def add(build: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(keep_methods_compiled(spark), folder))

        run.__name__ = name
        run.__doc__ = build.__doc__
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return add


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL helpers (DuckDB dialect) -----------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s52(digest: str, slot: int = 0) -> str:
    return f"('0x' || substr({digest}, {1 + HEX_SLICE * slot}, {HEX_SLICE}))::ubigint::bigint"


def pick(pool: Sequence[str], digest: str, slot: int = 0) -> str:
    words = ", ".join(q(w) for w in pool)
    return f"([{words}])[({s52(digest, slot)} % {len(pool)}) + 1]"


def keyed(text: str, scope: str) -> str:
    prefix = KEY + (f"|{scope}|" if scope else "")
    return f"sha256({q(prefix)} || ({text}))"


def laplace(text: str, scale: str) -> str:
    u = f"(({s52(f'sha256({text})')} + 0.5::double) / 4503599627370496.0::double - 0.5::double)"
    return f"(-({scale}) * sign({u}) * ln(1.0::double - 2.0::double * abs({u})))"


def compact(text: str) -> str:
    return rf"regexp_replace({text}, '[\s-]', '', 'g')"


def hide_tail(text: str, n: int) -> str:
    c = compact(text)
    return (
        f"CASE WHEN length({c}) >= {n} THEN left({c}, length({c}) - {n}) || {q('X' * n)} "
        f"ELSE repeat('X', length({c})) END"
    )


def keep_tail(text: str, n: int) -> str:
    c = compact(text)
    return (
        f"CASE WHEN length({c}) >= {n} THEN repeat('X', length({c}) - {n}) || right({c}, {n}) "
        f"ELSE repeat('X', length({c})) END"
    )


def keep_blank(text: str, expression: str) -> str:
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN {text} ELSE {expression} END"


def has_any(text: str, parts: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in parts) + ")"


def first_of(tests: Sequence[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN {test} THEN {result}" for test, result in tests)
    return f"CASE {whens} ELSE {default} END"
