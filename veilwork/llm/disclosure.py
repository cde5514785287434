"""Sanitisation of personal data by what terms disclose.

Identifiers of four kinds (e-mail and IP addresses, card and phone numbers) are
found by their form.  Their values are the protected entities.  Corpus
co-occurrence then tells which ordinary terms reveal an entity although they
are no identifiers: the corpus is cut into units (lines, long ones into
stretches of ``UNIT_WORDS`` words), and with ``n`` units, of which ``n_c`` hold the
entity, ``n_t`` the term and ``n_ct`` both,

    information(c) = log2(n / n_c)        disclosed(c, t) = log2(n * n_ct / (n_c * n_t))

A term that discloses at least the share ``disclosure`` of an entity's information
is sensitive wherever it stands, also where the entity itself is missing.  It is
generalised to its form (number, code, name or word) if that form discloses less
than the threshold, else removed.  Estimates rest on ``support`` different units at
least, so that copies of one text do not make all its words sensitive.

All counts cover all documents.  A hot entity or term is counted map-side before
rows meet.  What is broadcast are bit tables of a fixed size; a wrong bit costs a
look-up, the joins behind it are exact.  Occurrences meet their terms by
shuffle, whatever their number.

Null and empty texts have no spans.  Positions are code points, ends exclusive.
Rows are kept one by one, also equal ones and those without an id; columns of
other names are read only if they are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from veilwork.llm.shared import table, written
from veilwork.llm.words import MIXER, NO_ALNUM, Words, among, bit_table, byte_set, chunks, hashes, mixed, slot_of, words_of

UNIT_WORDS = 32
DISCLOSURE = 0.95  # share of an entity's information that a term may not reach
SUPPORT = 3  # different units in which a term and an entity meet, at least
BITS = 23  # bit tables of one megabyte
KINDS = ("email", "ip", "card", "phone")  # fixed order of the kinds
TERM = "term"
SHAPES = ("number", "code", "name", "word")
DIGIT, UPPER = byte_set((0x30, 0x39)), byte_set((0x41, 0x5A))
MARKED = "array<struct<start:int,rank:int,end:int,kind:string,action:string>>"
FOUND = "array<struct<start:int,end:int,term:string,shape:int>>"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


# --- identifiers by their form ----------------------------------------------------------------------------------


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses; each ``@`` is looked at once, so long runs of letters cost no more than others."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        local = text[done:at]
        start = done + len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        done = at
        if domain:
            yield start, domain.end()
            at = done = domain.end()


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def identifiers(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of all identifiers, by start and kind; kinds may overlap."""
    if not text:
        return []
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(kind: int, value: str) -> str:
    """The value as it is counted: numbers by their digits, addresses in lower case."""
    return f"{KINDS[kind]}:{_NO_DIGIT.sub('', value) if kind > 1 else value.lower()}"


# --- terms and units of a chunk ---------------------------------------------------------------------------------


class Units:
    """The terms of a chunk of texts, the unit of each, and their places in code points."""

    def __init__(self, texts: pa.Array):
        words: Words = words_of(texts, NO_ALNUM)
        n = len(words.row)
        self.row, self.coded = words.row, pc.ascii_lower(words.text).dictionary_encode()
        self.ids = self.coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.terms = self.coded.dictionary
        self.keys = hashes(self.terms)
        line = np.searchsorted(np.flatnonzero(words.data == 10), words.start)
        new = np.ones(n, bool)
        new[1:] = (line[1:] != line[:-1]) | (words.row[1:] != words.row[:-1])
        heads = np.flatnonzero(new)
        in_line = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
        self.unit = np.cumsum(in_line % UNIT_WORDS == 0) - 1
        points = np.append(0, np.cumsum((words.data & 0xC0) != 0x80))
        before = points[words.offsets[words.row]]
        self.start, self.end = points[words.start] - before, points[words.end] - before
        digits = np.append(0, np.cumsum(DIGIT[words.data]))
        digits = digits[words.end] - digits[words.start]
        upper = UPPER[words.data[words.start]] if n else new
        self.shape = np.where(digits == words.end - words.start, 0, np.where(digits > 0, 1, np.where(upper, 2, 3)))

    def digest(self) -> np.ndarray:
        """A hash of the words of every unit, in their order."""
        heads = np.flatnonzero(np.append(True, self.unit[1:] != self.unit[:-1])) if len(self.unit) else np.zeros(0, int)
        place = np.arange(len(self.unit)) - heads[self.unit] if len(self.unit) else self.unit
        return np.add.reduceat(mixed(self.keys[self.ids] + place.astype(np.uint64) * MIXER), heads) if len(heads) else np.zeros(0, np.uint64)

    def words_between(self, row: int, start: int, end: int) -> tuple[int, int]:
        """First and last (exclusive) number of the words of a row that touch a span."""
        low, high = np.searchsorted(self.row, [row, row + 1])
        return low + np.searchsorted(self.end[low:high], start, side="right"), low + np.searchsorted(self.start[low:high], end)


def entity_units(docs: DataFrame) -> DataFrame:
    """``(entity, unit, terms)`` of every unit with an identifier; words of identifiers are no terms."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 0):
                texts = part.column(0).to_pylist()
                spans = [identifiers(t) for t in texts]
                held = [i for i, s in enumerate(spans) if s]
                if not held:
                    continue
                units = Units(part.column(0).take(pa.array(held)))
                own, inside = set(), np.zeros(len(units.ids), bool)
                for row, i in enumerate(held):
                    for start, kind, end in spans[i]:
                        low, high = units.words_between(row, start, end)
                        inside[low:high] = True
                        own.add((entity(kind, texts[i][start:end]), int(units.unit[low])))
                digest = units.digest().astype(np.int64)
                terms = units.terms.to_pylist()
                keys = units.keys.astype(np.int64).tolist()
                bounds = np.searchsorted(units.unit, np.arange(len(digest) + 1))
                rows = []
                for name, u in sorted(own):
                    at = [j for j in range(bounds[u], bounds[u + 1]) if not inside[j]]
                    rows.append((name, int(digest[u]), [{"term": terms[units.ids[j]], "key": keys[units.ids[j]], "shape": int(units.shape[j])} for j in at]))
                names, digests, lists = zip(*rows, strict=True)
                kinds = pa.list_(pa.struct([("term", pa.string()), ("key", pa.int64()), ("shape", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(digests, pa.int64()), pa.array(lists, kinds)], names=["entity", "unit", "terms"])

    return docs.select("text").mapInArrow(run, "entity string, unit long, terms array<struct<term:string,key:bigint,shape:int>>")


def unit_counts(docs: DataFrame, wanted, bits: int) -> DataFrame:
    """``(what, name, n)``: units with each term whose bit is set, with each shape, and of all."""

    def run(batches):
        bits_set = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            for part in chunks(batch, 0):
                units = Units(part.column(0))
                if not len(units.ids):
                    continue
                asked = among(bits_set, (units.keys >> np.uint64(24)) & np.uint64((1 << bits) - 1))
                here = asked[units.ids]
                pairs = np.unique(units.unit[here] * len(asked) + units.ids[here]) % len(asked)
                counts = np.bincount(pairs, minlength=len(asked))
                at = np.flatnonzero(counts)
                shapes = np.bincount(np.unique(units.unit * len(SHAPES) + units.shape) % len(SHAPES), minlength=len(SHAPES))
                what = ["term"] * len(at) + ["shape"] * len(SHAPES) + ["units"]
                names = units.terms.take(pa.array(at)).to_pylist() + list(SHAPES) + [""]
                n = [*counts[at].tolist(), *shapes.tolist(), int(units.unit[-1]) + 1]
                yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(names, pa.string()), pa.array(n, pa.int64())], names=["what", "name", "n"])

    return docs.select("text").mapInArrow(run, "what string, name string, n long").groupBy("what", "name").agg(F.sum("n").alias("n"))


def sensitive_terms(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, bits: int = BITS) -> DataFrame:
    """``(term, key, action, entities, share)``: the terms over the threshold, written.

    ``action`` is ``generalise`` or ``remove``, ``entities`` the number of entities
    that the term discloses and ``share`` the largest share of information.
    """
    spark = docs.sparkSession
    units = written(entity_units(docs))
    held = units.groupBy("entity").agg(F.count("*").alias("n_c"))
    terms = units.select("entity", "unit", F.explode(F.array_distinct("terms")).alias("t")).select("entity", "unit", "t.*")
    by_unit = terms.groupBy("entity", "unit", "term", "key").agg(F.max("shape").alias("shape"))
    n_units = units.groupBy("entity", "unit").agg(F.count("*").alias("copies"))
    met = by_unit.join(n_units, ["entity", "unit"]).groupBy("entity", "term", "key")
    met = met.agg(F.sum("copies").alias("n_ct"), F.count("*").alias("units"), F.max("shape").alias("shape")).where(F.col("units") >= support)
    met = written(met)
    wanted = spark.sparkContext.broadcast(bit_table(met.select(slot_of(F.col("key"), bits).alias("slot")), bits))
    counted = written(unit_counts(docs, wanted, bits))
    totals = {(r["what"], r["name"]): r["n"] for r in counted.where(F.col("what") != "term").collect()}  # five rows
    n = totals.get(("units", ""), 0)
    of_shape = F.array(*[F.lit(totals.get(("shape", s), 0)) for s in SHAPES])
    shaped = units.select("entity", "unit", F.explode(F.array_distinct(F.transform("terms", lambda t: t["shape"]))).alias("shape"))
    shaped = shaped.groupBy("entity", "shape").agg(F.count("*").alias("n_cs"))
    information = F.log2(F.lit(float(max(n, 1))) / F.col("n_c"))
    told = lambda both, alone: F.log2(F.lit(float(max(n, 1))) * both / (F.col("n_c") * F.greatest(alone, F.lit(1))))
    by_term = counted.where(F.col("what") == "term").select(F.col("name").alias("term"), F.col("n").alias("n_t"))
    judged = met.join(held, "entity").join(by_term, "term").where(F.col("n_c") < n).join(shaped, ["entity", "shape"])
    judged = judged.withColumns(
        {"share": told(F.col("n_ct"), F.col("n_t")) / information, "wide": told(F.col("n_cs"), F.get(of_shape, F.col("shape"))) / information}
    ).where(F.col("share") >= disclosure)
    action = F.when(F.max("wide") >= disclosure, "remove").otherwise("generalise")
    return written(judged.groupBy("term", "key").agg(action.alias("action"), F.count("*").alias("entities"), F.max("share").alias("share")))


# --- marking ----------------------------------------------------------------------------------------------------


def marked(docs: DataFrame, keep: tuple[str, ...], wanted, bits: int) -> DataFrame:
    """The ``keep`` columns, ``base`` spans and the words outside them whose bit is set (``found``)."""
    kept = docs.select(*keep).schema
    schema = StructType([*kept.fields, *_parse_datatype_string(f"__base {MARKED}, __found {FOUND}").fields])
    types = [pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("action", pa.string())]))]
    types.append(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("shape", pa.int32())])))

    def run(batches):
        bits_set = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            for part in chunks(batch, len(kept)):
                column = part.column(len(kept))
                spans = [identifiers(t) for t in column.to_pylist()]
                base = [[{"start": s, "rank": k, "end": e, "kind": KINDS[k], "action": "generalise"} for s, k, e in row] for row in spans]
                found = [[] for _ in spans]
                if bits_set.any():
                    units = Units(column)
                    asked = among(bits_set, (units.keys >> np.uint64(24)) & np.uint64((1 << bits) - 1))
                    at = np.flatnonzero(asked[units.ids])
                    inside = np.zeros(len(units.ids), bool)
                    for row in np.unique(units.row[at]):
                        for start, _, end in spans[row]:
                            low, high = units.words_between(row, start, end)
                            inside[low:high] = True
                    at = at[~inside[at]]
                    words = units.terms.take(pa.array(units.ids[at])).to_pylist()
                    places = zip(units.row[at].tolist(), units.start[at].tolist(), units.end[at].tolist(), words, units.shape[at].tolist(), strict=True)
                    for row, start, end, term, shape in places:
                        found[row].append({"start": start, "end": end, "term": term, "shape": shape})
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(base, types[0]), pa.array(found, types[1])], names=schema.names)

    return docs.select(*keep, docs["text"]).mapInArrow(run, schema)


def sanitise(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, bits: int = BITS,
) -> DataFrame:
    """The ``keep`` columns and ``spans``: identifiers and sensitive terms, by start and kind.

    A span is ``(start, rank, end, kind, action)``; ``rank`` numbers the kinds, the
    kind of a term is ``term``.  ``replaced`` applies spans to a text.
    """
    spark = docs.sparkSession
    source = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    terms = sensitive_terms(source.select("text"), disclosure, support, bits)
    wanted = spark.sparkContext.broadcast(bit_table(terms.select(slot_of(F.col("key"), bits).alias("slot")), bits))
    names = tuple(f"__k{i}" for i in range(len(keep)))
    found = written(marked(source, names, wanted, bits).withColumn("__row", F.monotonically_increasing_id()))
    words = found.select("__row", F.explode("__found").alias("f")).select("__row", "f.*")
    shape = F.get(F.array(*[F.lit(s) for s in SHAPES]), F.col("shape"))
    span = F.struct(
        "start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(TERM).alias("kind"),
        F.when(F.col("action") == "remove", "remove").otherwise(shape).alias("action"),
    )
    more = words.join(terms.select("term", "action"), "term").groupBy("__row").agg(F.collect_list(span).alias("__more"))
    spans = F.array_sort(F.concat("__base", F.coalesce("__more", F.array().cast(MARKED))))
    return found.join(more, "__row", "left").select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], spans.alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span gone: identifiers become ``<kind>``, generalised terms ``<form>``, others nothing.

    Where identifiers overlap, the first stands for all of them.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        mark = F.when(s["action"] == "remove", "").otherwise(F.concat(F.lit("<"), F.when(s["kind"] == TERM, s["action"]).otherwise(s["kind"]), F.lit(">")))
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.when(s["start"] < state["at"], F.struct(state["out"].alias("out"), F.greatest(state["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(state["out"], between, mark).alias("out"), s["end"].alias("at"))
        )

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def op12_disclosure(spark, sf_dir: str) -> DataFrame:
    """Identifiers by kind, a digest of their spans, and all spans with the sensitive terms, of every document."""
    found = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of_kind, KINDS), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
