"""Periodic runs of words by recompression.

A text becomes a string of word numbers.  ``Grammar`` shrinks it level by level:
stretches of one repeated symbol become one symbol each (block compression),
then pairs whose symbols fall on different sides of a partition of the alphabet
(pair compression); equal contexts get equal symbols on every level.  ``lce``
reads common extensions off the levels: it climbs while the symbols above are
equal and steps down where they differ, so an extension costs a few steps a
level however long it is.

A run of period ``p`` and at least ``4 * p`` words equals itself ``p`` words on
over at least ``3 * p`` places in a row.  So it meets the grid of that spacing,
and the grids of all periods have ``n/3 + n/6 + n/9 + ...`` places together.  Every
grid place whose word recurs ``p`` on is extended in both directions by the
grammar, exactly; what is long enough is a run, and of equal stretches the
smallest period stands.  By the theorem of Fine and Wilf a stretch of four
periods has no other maximal stretch with a multiple of its smallest period.

Several texts share a grammar, parted by symbols that occur once.  Memory grows
with the texts of one chunk or with one long text, not with the table.  Rows
are independent; extra columns are not read unless they are kept.  Null and
empty texts have no runs and collapse to the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from veilwork.llm.shared import WORD, table, whole
from veilwork.llm.words import MIXER, SPACES, chunks, mixed, words_of

REPEATS = 4  # a run has at least so many periods
LEAST = 6  # ... and at least so many words
CHUNK_BYTES = 4 << 20  # texts that share a grammar
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Level(NamedTuple):
    symbols: np.ndarray
    up: np.ndarray  # node above each symbol
    down: np.ndarray  # first symbol below each node of the next level, and the end
    block: bool  # nodes above are blocks of one symbol


class Grammar:
    """Levels of a string by alternate block and pair compression.

    Symbols below zero are borders: each must occur once, and nothing is
    compressed across them.  A border must stand at both ends.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels: list[Level] = []
        self.next = int(symbols.max(initial=-1)) + 1
        while True:
            symbols = self._blocks(symbols)
            if not np.any((symbols[1:] >= 0) & (symbols[:-1] >= 0)):
                break
            symbols = self._pairs(symbols)
        self.top = symbols

    def _lift(self, symbols: np.ndarray, heads: np.ndarray, made: np.ndarray, block: bool) -> np.ndarray:
        up = np.cumsum(heads) - 1
        down = np.append(np.flatnonzero(heads), len(symbols))
        self.levels.append(Level(symbols, up, down, block))
        return made

    def _name(self, keys: np.ndarray) -> np.ndarray:
        """New symbols, one for each distinct key."""
        distinct, names = np.unique(keys, return_inverse=True)
        names = names + self.next
        self.next += len(distinct)
        return names

    def _blocks(self, symbols: np.ndarray) -> np.ndarray:
        heads = np.append(True, symbols[1:] != symbols[:-1])
        if heads.all():
            return symbols
        at = np.flatnonzero(heads)
        counts = np.diff(np.append(at, len(symbols)))
        made, long = symbols[at], counts > 1
        made[long] = self._name(made[long] * (len(symbols) + 1) + counts[long])
        return self._lift(symbols, heads, made, True)

    def _pairs(self, symbols: np.ndarray) -> np.ndarray:
        """Join neighbours on different sides, in the order of sides that joins more of them."""
        salt = np.uint64((len(self.levels) + 1) * int(MIXER) % (1 << 64))
        side = (mixed(symbols.astype(np.uint64) + salt) & np.uint64(1)).astype(bool)
        free = (symbols[:-1] >= 0) & (symbols[1:] >= 0)
        one, other = free & ~side[:-1] & side[1:], free & side[:-1] & ~side[1:]
        at = np.flatnonzero(one if one.sum() >= other.sum() else other)
        heads = np.ones(len(symbols), bool)
        heads[at + 1] = False
        made = symbols.copy()
        made[at] = self._name(symbols[at] << 32 | symbols[at + 1])
        return self._lift(symbols, heads, made[heads], False)

    def mirrored(self) -> Grammar:
        """The grammar of the reversed string."""
        back = object.__new__(Grammar)
        back.next, back.top, back.levels = self.next, self.top[::-1], []
        for symbols, up, down, block in self.levels:
            nodes = len(down) - 1
            back.levels.append(Level(symbols[::-1], nodes - 1 - up[::-1], len(symbols) - down[::-1], block))
        return back

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common extensions to the right from the places ``a`` and ``b`` (``a != b``)."""
        start, a, b = a, a.astype(np.int64), b.astype(np.int64)
        reached = np.zeros(len(a), np.int64)  # level at which a query turned down
        rising = np.arange(len(a))
        for k, level in enumerate(self.levels):
            reached[rising] = k
            rising = rising[self._align(level, a, b, rising)]
            x, y = level.up[a[rising]], level.up[b[rising]]
            above = self.levels[k + 1].symbols if k + 1 < len(self.levels) else self.top
            same = above[x] == above[y]
            rising = rising[same]
            a[rising], b[rising] = x[same], y[same]
            if not len(rising):
                break
        reached[rising] = len(self.levels)
        for k in range(int(reached.max(initial=-1)), -1, -1):
            falling = np.flatnonzero(reached >= k)
            symbols = self.levels[k].symbols if k < len(self.levels) else self.top
            going = falling
            while True:
                going = going[symbols[a[going]] == symbols[b[going]]]
                if not len(going):
                    break
                step = self._step(self.levels[k], a[going], b[going]) if k < len(self.levels) else 1
                a[going] += step
                b[going] += step
            if k:
                down = self.levels[k - 1].down
                a[falling], b[falling] = down[a[falling]], down[b[falling]]
        return a - start

    @staticmethod
    def _step(level: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray | int:
        """Symbols to pass at once where both are equal: the rest of the shorter block, or one."""
        if not level.block:
            return 1
        return np.minimum(level.down[level.up[a] + 1] - a, level.down[level.up[b] + 1] - b)

    @classmethod
    def _align(cls, level: Level, a: np.ndarray, b: np.ndarray, rising: np.ndarray) -> np.ndarray:
        """Pass equal symbols until both places begin a node above; false where symbols differ first."""
        aligned = np.zeros(len(rising), bool)
        open_ = np.arange(len(rising))
        while len(open_):
            x, y = a[rising[open_]], b[rising[open_]]
            fits = (level.down[level.up[x]] == x) & (level.down[level.up[y]] == y)
            aligned[open_[fits]] = True
            open_, x, y = open_[~fits], x[~fits], y[~fits]
            equal = level.symbols[x] == level.symbols[y]
            open_, x, y = open_[equal], x[equal], y[equal]
            step = cls._step(level, x, y)
            a[rising[open_]] = x + step
            b[rising[open_]] = y + step
        return aligned


def candidates(symbols: np.ndarray, longest: int, repeats: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places and periods at which a word recurs one period on."""
    places, periods = [], []
    for p in range(1, longest // repeats + 1):
        spacing = max(least, repeats * p) - p
        here, there = symbols[:-p:spacing], symbols[p::spacing]
        hit = np.flatnonzero((here == there) & (here >= 0)) * spacing
        if len(hit):
            places.append(hit)
            periods.append(np.full(len(hit), p, np.int64))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(places), np.concatenate(periods)) if places else (empty, empty)


def runs_of(symbols: np.ndarray, longest: int, repeats: int = REPEATS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs of a bordered string, by start and period.

    ``longest`` bounds the length between two borders.  ``repeats`` must be
    two or more for the grid to meet every run.
    """
    at, period = candidates(symbols, longest, repeats, least)
    if not len(at):
        return at, at, at
    grammar = Grammar(symbols)
    end = at + period + grammar.lce(at, at + period)
    back = len(symbols) - at  # the place before ``at`` in the reversed string
    start = at - grammar.mirrored().lce(back, back - period)
    length = end - start
    found = length >= np.maximum(least, repeats * period)
    start, length, period = start[found], length[found], period[found]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapsed(words, kept: np.ndarray, rows: int) -> pa.Array:
    """The kept words of every row, joined by one space."""
    counts = np.bincount(words.row[kept], minlength=rows)
    ends = np.append(0, np.cumsum(counts))
    lists = pa.LargeListArray.from_arrays(pa.array(ends), words.text.filter(pa.array(kept)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def _runs_in(texts: pa.Array, repeats: int, least: int) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed text of every row."""
    words, rows = words_of(texts, SPACES), len(texts)
    n = len(words.row)
    starts = np.searchsorted(words.row, np.arange(rows + 1))  # first word of every row
    ids = words.text.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(0, np.int64)
    symbols = np.empty(n + rows + 1, np.int64)
    borders = starts + np.arange(rows + 1)
    symbols[borders] = -1 - np.arange(rows + 1)
    symbols[np.arange(n) + words.row + 1] = ids
    start, length, period = runs_of(symbols, int(np.diff(starts).max(initial=0)), repeats, least)
    row = np.searchsorted(borders, start, side="right") - 1
    change = np.zeros(n + 1, np.int64)
    first = start - row - 1  # without the borders before
    np.add.at(change, first + period, 1)
    np.add.at(change, first + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype(np.int32)
    columns = [pa.array(x) for x in (start - borders[row] - 1, length, period)]
    runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
    return runs, _collapsed(words, kept, rows)


def find_runs(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", repeats: int = REPEATS, least: int = LEAST,
) -> DataFrame:
    """The ``keep`` columns, ``runs`` (word numbers from 0, by start and period) and the ``collapsed`` text.

    A run is a longest stretch of at least ``least`` words and ``repeats``
    times its smallest period.  The collapsed text has the first period of
    every run only; its words are joined by one space.
    """
    if repeats < 2:
        raise ValueError("runs have at least two periods")
    kept = docs.select(*keep).schema
    schema = StructType([*kept.fields, *_parse_datatype_string(f"runs {RUNS}, collapsed string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, batch.num_columns - 1, CHUNK_BYTES):
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *_runs_in(part.column(len(kept)), repeats, least)], names=schema.names)

    return docs.select(*keep, docs[text]).mapInArrow(run, schema)


def with_planted_runs(doc_id: Column, words: Column) -> Column:
    """The words of every tenth document from a place on repeat with a period; both follow from the id."""
    g = F.floor(F.crc32(doc_id.cast("string")) / 10)
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    period = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.concat(F.slice(words, F.lit(1), a), tail)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Number of runs, the longest run, and digests of the runs and of the collapsed text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    words = F.when(chosen, F.regexp_extract_all(whole("text"), F.lit(WORD), F.lit(0)))
    planted = F.concat_ws(" ", with_planted_runs(F.col("doc_id"), F.col("words")))
    docs = docs.withColumn("words", words)
    docs = docs.select("doc_id", F.when(F.size("words") > 0, planted).otherwise(F.col("text")).alias("text"))
    found = find_runs(docs)
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.p")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
