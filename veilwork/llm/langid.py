"""Language identification with a blended-spectrum string kernel.

A text is the set of its letter n-grams of lengths 1 to 3 (presence, not
counts); two texts are as similar as the cosine of their sets.  The kernel is
approximated by Nyström features over landmark texts, and a one-versus-rest
kernel ridge regression is solved in that feature space.  Scoring counts, for
each text, the n-grams it shares with every landmark, from lists of the
landmarks that hold an n-gram, and multiplies with the regression weights.

Texts are read whole, in lower case; every letter of any script counts, and
everything that is no letter is one common gap symbol.  Training uses at most
``per_language`` labelled texts of every labelled language; the texts with the
smallest digest of their id are taken.

Null texts and texts without letters get ``und`` and score 0.  Without labelled
texts every text gets ``und``.  Equal responses go to the first language by
code point.  Repeated rows are scored one by one, each the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.shared import small_batches, table, unused, written

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
BITS = 21  # a code point and one more fit; three of them fit into one signed number
TOGETHER = 256  # texts of one matrix product


@dataclass
class Model:
    """Everything that scoring needs; its size depends on the landmarks only."""

    languages: list[str]
    grams: np.ndarray  # sorted n-grams that landmarks have
    starts: np.ndarray  # where the list of an n-gram begins in ``holders``, and the end of the last
    holders: np.ndarray  # places of the landmarks that hold an n-gram, one list after the other
    landmark_sizes: np.ndarray
    weights: np.ndarray | None = None  # landmarks x languages: Nyström map times ridge solution


@cache
def symbols() -> np.ndarray:
    """For every code point its own symbol if it is a letter, else the gap symbol 1."""
    table = np.ones(0x110000, np.int64)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    letters = np.array([ord(c) for c in LETTER.findall(every)])
    table[letters] = letters + 1
    return table


def gram_set(text: str) -> np.ndarray:
    """The sorted distinct n-grams of a text.  No symbol is 0, so grams of different lengths differ."""
    codes = symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    pairs = codes[:-1] << BITS | codes[1:]
    return np.unique(np.concatenate([codes, pairs, pairs[:-1] << BITS | codes[2:]]))


def landmark_model(texts: list[tuple[str, str]], languages: list[str]) -> Model:
    """N-grams of the landmark texts, each with the landmarks that hold it."""
    sets = [gram_set(t) for _, t in texts]
    every, holders = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    grams, starts = np.unique(every[order], return_index=True)
    return Model(languages, grams, np.r_[starts, len(every)], holders[order], np.array([len(s) for s in sets], np.float32))


def shared_grams(model: Model, found: np.ndarray) -> np.ndarray:
    """How many of a text's n-grams each landmark holds."""
    at = np.minimum(np.searchsorted(model.grams, found), len(model.grams) - 1)
    at = at[model.grams[at] == found]
    begin, length = model.starts[at], model.starts[at + 1] - model.starts[at]
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return np.bincount(model.holders[np.repeat(begin, length) + inside], minlength=len(model.landmark_sizes))


def kernel(model: Model, texts: list[str]) -> np.ndarray:
    """Kernel values of texts and landmarks."""
    rows = np.zeros((len(texts), len(model.landmark_sizes)), np.float32)
    sizes = np.ones(len(texts), np.float32)
    for i, t in enumerate(texts):
        if t:
            found = gram_set(t)
            rows[i], sizes[i] = shared_grams(model, found), len(found)
    return rows / np.sqrt(sizes[:, None] * model.landmark_sizes[None, :])


def training_rows(docs: DataFrame, per_language: int) -> tuple[DataFrame, list[str]]:
    """``(lang, text, place)`` of the training texts, and the languages.

    One row per language reaches the driver.
    """
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    counts = usable.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    draw, steps = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), 1 << 30
    # a digest below the threshold: about twice as many as are needed, whatever the size
    share = lambda n: min(1.0, 2.0 * per_language / n + 50 / n)
    bounds = {"lang": [r["lang"] for r in counts], "below": [int(share(r["count"]) * steps) + 1 for r in counts]}
    # from Arrow, not from rows: those would start Python workers of their own on the executors
    below = docs.sparkSession.createDataFrame(pa.table(bounds, pa.schema({"lang": pa.string(), "below": pa.int64()})))
    order = W.partitionBy("lang").orderBy(draw, "doc_id", F.xxhash64("text"))
    # one row per language, which the driver holds anyway
    chosen = usable.join(F.broadcast(below), "lang").where(draw < F.col("below")).select("doc_id", "lang", "text")
    return chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select("lang", "text", "place"), languages


def fit(docs: DataFrame, per_language: int = 250, landmarks: int = 16, ridge: float = 1e-2) -> Model | None:
    """Choose landmarks, map the training texts through them on the executors, and solve the ridge system.

    The driver holds the landmark texts (``landmarks`` per language), sums over
    pairs of landmarks, and the kernel values of some training texts at a time.
    """
    sample, languages = training_rows(docs, per_language)
    if not languages:
        return None
    sample = written(sample)
    texts = [(r["lang"], r["text"]) for r in sample.where(F.col("place") <= landmarks).orderBy("lang", "place").collect()]
    texts = [(a, b) for a, b in texts if LETTER.search(b)]
    if not texts:
        return None
    model = landmark_model(texts, languages)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(frames):
        m = shared.value
        for frame in frames:
            for i in range(0, len(frame), TOGETHER):
                part = frame.iloc[i : i + TOGETHER]
                yield pd.DataFrame({"lang": part.lang, "place": part.place, "k": list(kernel(m, part.text.tolist()))})

    small_batches(docs.sparkSession)
    n, place = len(model.landmark_sizes), {x: i for i, x in enumerate(languages)}
    products, goals, total = np.zeros((n, n)), np.zeros((n, len(languages))), 0
    rows = sample.mapInPandas(features, "lang string, place int, k array<float>").orderBy("lang", "place").toLocalIterator()
    while part := list(islice(rows, 4 * TOGETHER)):
        k = np.array([r["k"] for r in part], np.float64)
        products += k.T @ k
        np.add.at(goals.T, [place[r["lang"]] for r in part], k)
        total += len(part)
    among = kernel(model, [t for _, t in texts])
    values, vectors = np.linalg.eigh(among.astype(np.float64))
    good = values > 1e-6 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])
    solution = np.linalg.solve(nystrom.T @ products @ nystrom + ridge * total * np.eye(nystrom.shape[1]), nystrom.T @ goals)
    model.weights = (nystrom @ solution).astype(np.float32)
    return model


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score`` (the winner's response, cut to 0 to 1).

    A kept column of such a name keeps it; the new one gets an underscore more.
    A text that is kept goes to Python once.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kept = docs.select(*keep)
    schema = StructType([*kept.schema.fields, StructField(unused("lang_pred", keep), StringType()), StructField(unused("score", keep), DoubleType())])
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)
    at = keep.index(text) if text in keep else len(keep)

    def score(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(at)
            for start in range(0, max(1, batch.num_rows), TOGETHER):
                part = texts.slice(start, TOGETHER).to_pylist()
                names, scores = [UNKNOWN] * len(part), np.zeros(len(part))
                known = [i for i, t in enumerate(part) if m and t and LETTER.search(t)]
                if known:
                    response = kernel(m, [part[i] for i in known]) @ m.weights
                    best = response.argmax(1)
                    scores[known] = np.clip(response[np.arange(len(known)), best], 0, 1)
                    for i, b in zip(known, best, strict=True):
                        names[i] = m.languages[b]
                columns = [batch.column(i).slice(start, TOGETHER) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    read = kept if text in keep else docs.select(*keep, docs[text].alias(unused("__text", keep)))
    return read.mapInArrow(score, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a fifth of them is held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, fit(docs))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
