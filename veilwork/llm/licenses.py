"""License scans: an exact set-similarity join of text blocks with notice templates.

A block is a line and, as notices are wrapped, as many words of the lines after
it as the longest template has, less one: a notice that begins in the line lies
in its block, however it is broken.  Lines without words are passed over.

A block matches a template if it holds at least ``threshold`` of the template's
distinct words.  ``token_order`` counts how many documents of the corpus
hold each template word; the words are ordered by that count, rarest first.  A match of a template with ``m`` words needs ``need = ceil(threshold *
m)`` common words, so it must hold one of the template's ``m - need + 1``
rarest words (prefix filter), at least ``need`` words (length filter), and
enough words after the first common one in both lists (positional filter).
Survivors are verified on the whole sets.  The filters only save work: no block
that meets the threshold is lost.

Short templates (``WHOLE_BELOW`` distinct words and fewer) must be held whole: one
word tells licences apart that are alike in all others.  Where a block holds
a template and another one with all its words and more, the larger one counts.

Besides, the places of base phrases (consecutive words) are found over the
whole text.  Everything is Spark expressions.  The templates are a parameter of
the caller and few, so their index is a literal table.

Null and empty texts have no words, no labels and score 0.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.shared import table, whole

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

WHOLE_BELOW = 16  # templates of at most so many distinct words must be held whole

# Opening sentences and usual short forms of public licence notices.  What follows a slash
# tells templates of one licence apart.
TEMPLATES = {
    "agpl-3": "GNU Affero General Public License, version 3",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "bsd/short": "under the BSD License",
    "cc-by": "Creative Commons Attribution 4.0 International License",
    "cc-by/short": "Licensed under CC BY 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-nc/long": "Creative Commons Attribution NonCommercial 4.0 International License",
    "cc-by-nc-nd": "Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License",
    "cc-by-nc-nd/short": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-nc-sa": "Creative Commons Attribution NonCommercial ShareAlike 4.0 International License",
    "cc-by-nc-sa/short": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nd": "Creative Commons Attribution NoDerivatives 4.0 International License",
    "cc-by-nd/short": "Licensed under CC BY-ND 4.0",
    "cc-by-sa": "Creative Commons Attribution ShareAlike 4.0 International License",
    "cc-by-sa/short": "Licensed under CC BY-SA 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    "gpl-2": "GNU General Public License, version 2",
    "gpl-3": "GNU General Public License, version 3",
    "lgpl-2.1": "GNU Lesser General Public License, version 2.1",
    "lgpl-3": "GNU Lesser General Public License, version 3",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files",
    "mit/short": "under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-2.0/short": "Mozilla Public License, version 2.0",
}


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and everything else as it is.

    ``lower`` is several times faster than ``translate``.  It changes other
    letters too, but neither word boundaries nor ASCII words with one exception,
    the Kelvin sign, which it would turn into ``k``; so that is taken out first.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\ufffd")))


def words_of(text: Column) -> Column:
    """The words of a lowered text; only its ends can leave empty parts when it is cut at the gaps."""
    return F.array_remove(F.split(text, GAP, -1), "")


def _template_lists(templates: dict[str, str]) -> dict[str, list[str]]:
    import re

    cut = {k: re.findall("[0-9a-z\u0080-\U0010ffff]+", v.translate(str.maketrans(UPPER, LOWER))) for k, v in templates.items()}
    return {k: v for k, v in cut.items() if v}


def _template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: sorted(set(v)) for k, v in _template_lists(templates).items()}


def _literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def blocks(docs: DataFrame, any_of: list[str], longest: int, known_of: list[str], shortest: int) -> DataFrame:
    """``(doc_id, words)`` of the blocks that hold one of ``any_of``; ``longest``: words of the longest template.

    Texts that hold none of them, or fewer than ``shortest`` of ``known_of``, are not cut.
    """
    wanted, known = _literal(any_of), _literal(known_of)
    bodies = docs.select("doc_id", lowered(whole("text")).alias("body")).withColumn("all", words_of(F.col("body")))
    bodies = bodies.where(F.arrays_overlap("all", wanted) & (F.size(F.array_intersect(known, "all")) >= shortest))
    cut = F.filter(F.transform(F.split("body", "\n", -1), words_of), lambda w: F.size(w) > 0)

    def run(lines: Column) -> Column:
        # the lines kept have a word at least, so that many of them are enough
        more = lambda i: F.slice(F.flatten(F.slice(lines, i + 1, longest)), 1, longest - 1)
        each = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.concat(F.get(lines, i - 1), more(i)))
        return F.when(F.size(lines) > 0, each)

    found = bodies.select("doc_id", F.explode(F.transform(F.array(cut), run)[0]).alias("words"))
    return found.where(F.arrays_overlap("words", wanted))


def token_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' words by the number of documents of the whole corpus that hold them, rarest first.

    One row per word of the templates reaches the driver.
    """
    vocabulary = sorted({w for words in _template_words(templates).values() for w in words})
    counted = (
        docs.select(F.explode(F.array_intersect(_literal(vocabulary), words_of(lowered(whole("text"))))).alias("word"))
        .groupBy("word").count().collect()
    )
    seen = {r["word"]: r["count"] for r in counted}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def larger_templates(templates: dict[str, str]) -> dict[str, list[str]]:
    """For every template those with all its words and more."""
    sets = {k: set(v) for k, v in _template_words(templates).items()}
    return {a: [b for b in sets if sets[a] < sets[b]] for a in sets}


def needed(size: int, threshold: float, whole_below: int) -> int:
    """Common words that a template of ``size`` distinct words asks for."""
    return size if size <= whole_below else max(1, math.ceil(threshold * size - 1e-9))


def prefix_index(templates: dict[str, str], order: list[str], threshold: float, whole_below: int = 0) -> list[tuple]:
    """Rows ``(word, label, place, size, need, ordered words)`` for the prefix of each template."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, words in _template_words(templates).items():
        ordered = sorted(words, key=rank.__getitem__)
        need = needed(len(ordered), threshold, whole_below)
        rows += [(w, label, i, len(ordered), need, ordered) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    return rows


def template_matches(docs: DataFrame, templates: dict[str, str], threshold: float = 0.8, whole_below: int = 0, best_of_kin: bool = False) -> DataFrame:
    """``(doc_id, label, containment)`` of every block that meets the threshold (one row per block and label).

    Templates of at most ``whole_below`` words must be held whole.  With
    ``best_of_kin`` a template does not count in a block that a template with
    all its words and more matches too.
    """
    spark = docs.sparkSession
    order = token_order(docs, templates)
    rows = prefix_index(templates, order, threshold, whole_below)
    if not rows:
        return docs.select("doc_id", F.lit("").alias("label"), F.lit(0.0).alias("containment")).where(F.lit(False))
    index = spark.createDataFrame(rows, "word string, label string, place int, size int, need int, template array<string>")
    rare = sorted({r[0] for r in rows})
    # the block's words that templates know, in the global order (array_intersect keeps the order of its first argument)
    shortest, longest = min(r[4] for r in rows), max(map(len, _template_lists(templates).values()))
    known = blocks(docs, rare, longest, order, shortest).select("doc_id", F.array_intersect(_literal(order), "words").alias("known"))
    probes = known.where(F.size("known") >= shortest).select("doc_id", "known", F.posexplode("known").alias("at", "word"))
    hits = probes.join(F.broadcast(index), "word")  # the index has a fixed size: the words of the given templates
    first = F.element_at(F.array_intersect("template", "known"), 1) == F.col("word")
    bound = 1 + F.least(F.col("size") - F.col("place") - 1, F.size("known") - F.col("at") - 1)
    common = F.size(F.array_intersect("template", "known"))
    met = (
        hits.where((F.size("known") >= F.col("need")) & (bound >= F.col("need")) & first)
        .where(common >= F.col("need"))
        .select("doc_id", "known", "label", (common / F.col("size")).alias("containment"))
    )
    if not best_of_kin:
        return met.drop("known")
    # blocks of one document with the same known words are judged alike
    each = met.groupBy("doc_id", "known").agg(F.collect_set(F.struct("label", "containment")).alias("met"))
    kin = F.create_map(*[c for k, v in larger_templates(templates).items() for c in (F.lit(k), _literal(v))])
    names = F.transform("met", lambda m: m["label"])
    each = each.withColumn("names", names)
    best = F.filter("met", lambda m: ~F.arrays_overlap(F.element_at(kin, m["label"]), F.col("names")))
    return each.select("doc_id", F.inline(best))


def phrase_places(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Add ``n_words, n_base, first_word, last_word, base_labels`` (an array) to the rows.

    The words are joined by single spaces and the phrases searched as whole
    words.  The spaces before a match count the words before it.
    """
    out = docs.withColumn("__words", words_of(lowered(whole("text")))).withColumn("n_words", F.size("__words").cast("long"))
    heads = _literal(sorted({p.split()[0] for p in phrases}))
    joined = F.when(F.arrays_overlap("__words", heads), F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")))
    out = out.withColumn("__joined", F.coalesce(joined, F.lit(" "))).drop("__words")
    places = {}
    for k, phrase in enumerate(phrases):
        parts = F.split("__joined", f"(?<= ){phrase}(?= )", -1)
        places[f"__p{k}"] = F.when(F.contains("__joined", F.lit(f" {phrase} ")), F.transform(parts, lambda x: F.regexp_count(x, F.lit(" "))))
    out = out.withColumns(places)
    count, first, last, found = F.lit(0), [], [], []
    for k, (phrase, label) in enumerate(phrases.items()):
        p, length = F.col(f"__p{k}"), len(phrase.split())
        count = count + F.coalesce(F.size(p) - 1, F.lit(0))
        first.append(F.element_at(p, 1) - 1)
        # the last part begins with the space after the phrase and ends with the space after the last word
        last.append(F.when(p.isNotNull(), F.col("n_words") - (F.element_at(p, -1) - 1) - length))
        found.append(F.when(p.isNotNull(), F.lit(label)))
    many = lambda f, c: f(*c) if len(c) > 1 else c[0]
    return out.withColumns(
        {
            "n_base": count.cast("long"),
            "first_word": many(F.least, first).cast("long"),
            "last_word": many(F.greatest, last).cast("long"),
            "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))),
        }
    ).drop("__joined", *places)


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = BASE, threshold: float = 0.8, whole_below: int = WHOLE_BELOW,
) -> DataFrame:
    """One row per document row: places of base phrases, labels of phrases and templates, best score.

    The score is 1 if a base phrase occurs, else the highest containment of a
    matched template, else 0.  Rows that share a document id share the labels
    of all of them.
    """
    # one row per matching document before the join: few labels, reduced map-side
    matched = template_matches(docs, templates, threshold, whole_below, True).groupBy("doc_id").agg(
        F.collect_set(F.substring_index("label", "/", 1)).alias("__labels"), F.max("containment").alias("__best")
    )
    based = phrase_places(docs.select("doc_id", "text"), phrases).drop("text").withColumnRenamed("doc_id", "__id")
    both = based.join(matched, F.col("__id").eqNullSafe(matched["doc_id"]), "left").drop("doc_id").withColumnRenamed("__id", "doc_id")
    labels = F.array_union("base_labels", F.coalesce("__labels", F.array().cast("array<string>")))
    return both.withColumns(
        {
            "labels": F.array_sort(labels),
            "score": F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("__best", F.lit(0.0))),
        }
    ).drop("__labels", "__best")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """License labels and phrase places of every document."""
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


_KIN = larger_templates(TEMPLATES)
_LONGEST = max(map(len, _template_lists(TEMPLATES).values()))
_TEMPLATE_SQL = ", ".join(
    f"('{k}', {v!r}, {needed(len(v), 0.8, WHOLE_BELOW)}, {_KIN[k]!r}::VARCHAR[])" for k, v in _template_words(TEMPLATES).items()
)
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents),
t(label, tw, need, kin) AS (VALUES {_TEMPLATE_SQL}),
w AS (SELECT doc_id, body, list_filter(regexp_split_to_array(body, '{GAP}'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT doc_id, len(ws) AS n, ws, list_filter(range(len(ws)), lambda i: ws[i+1] = 'cc' AND ws[i+2] = 'by') AS a,
  list_filter(range(len(ws)), lambda i: ws[i+1] = 'general' AND ws[i+2] = 'public' AND ws[i+3] = 'license') AS b,
  list_filter(range(len(ws)), lambda i: ws[i+1] = 'all' AND ws[i+2] = 'rights' AND ws[i+3] = 'reserved') AS c FROM w),
q AS (SELECT doc_id, n, list_concat(a, b, c) AS ps, list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END,
  CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base FROM p),
c AS (SELECT doc_id, ws, list_filter(list_transform(string_split(body, chr(10)),
  lambda x: len(list_filter(regexp_split_to_array(x, '{GAP}'), lambda y: y <> ''))), lambda k: k > 0) AS ns FROM w),
l AS (SELECT doc_id, ws, ns, unnest(range(1, len(ns) + 1)) AS i FROM c),
b AS (SELECT doc_id, i, ws[coalesce(list_sum(ns[1:i - 1]), 0)::BIGINT + 1 : list_sum(ns[1:i])::BIGINT + {_LONGEST - 1}] AS block FROM l),
m AS (SELECT doc_id, i, label, kin, len(list_intersect(tw, block)) / len(tw) AS c FROM b, t WHERE len(list_intersect(tw, block)) >= need),
n AS (SELECT doc_id, i, list(label) AS labels FROM m GROUP BY ALL),
k AS (SELECT m.doc_id, split_part(label, '/', 1) AS label, c FROM m JOIN n ON n.doc_id = m.doc_id AND n.i = m.i
  WHERE NOT list_has_any(kin, labels)),
g AS (SELECT doc_id, list(label) AS ls, max(c) AS best FROM k GROUP BY ALL)
SELECT q.doc_id, n AS n_words, len(ps) AS n_base, list_min(ps) AS first_word, list_max(ps) AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(ls, [])))), ',') AS labels,
  CASE WHEN len(ps) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM q LEFT JOIN g ON q.doc_id = g.doc_id
"""
