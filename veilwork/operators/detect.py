"""Detection of personal data by column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import TECHNIQUE_OF, any_of, matches_of
from .integrity import union_all

# Column-name parts that mark a column as personal when no detector did.
SAFETY_NET_NAMES = (
    "name", "email", "phone", "ssn", "aadhaar", "pan", "salary", "address", "city", "state",
    "pin", "dob", "birth", "card", "account",
)
AGREEMENT_BONUS, CEILING, LONE_RULE_PENALTY = 0.05, 0.99, 0.15
ORDER_SLOTS = 16  # more than there are detectors


def long_form(
    df: DataFrame, table_name: str, position: Column, columns: Sequence[str] | None = None
) -> DataFrame:
    """``(table_name, column_name, position, value)``: one row per cell, narrow, no shuffle.

    ``position`` orders the values of a column (first seen wins ties); give the
    row key of a whole table, or the row number of a sample.
    """
    chosen = list(columns or df.columns)
    texts = df.select(position.alias("position"), *[F.col(c).cast("string").alias(c) for c in chosen])
    cells = texts.unpivot(["position"], chosen, "column_name", "value")
    return cells.select(F.lit(table_name).alias("table_name"), "column_name", "position", "value")


def long_forms(tables: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    return union_all(long_form(df, name, position) for name, (df, position) in tables.items())


def first_values(cells: DataFrame, n: int) -> DataFrame:
    """The first ``n`` cells of each column, for sample frames.

    Use on samples only (their size is bounded); whole columns are judged
    without a cut by ``column_verdicts``.
    """
    w = Window.partitionBy("table_name", "column_name").orderBy("position")
    return cells.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def value_matches(cells: DataFrame) -> DataFrame:
    """One row per (cell, identifier pattern) hit."""
    found = F.explode(matches_of(F.col("value"), F.col("column_name"))).alias("m")
    return cells.filter(F.col("value").isNotNull()).select(
        "table_name", "column_name", "position", "value", found
    ).select("table_name", "column_name", "position", "value", "m.ord", "m.pii_type", "m.confidence")


def column_verdicts(cells: DataFrame) -> DataFrame:
    """Verdict per column: most frequent type, the first seen wins ties, mean confidence of the type.

    One pass and two small aggregates after the map-side combine: (column,
    type) and then (column).  Cells without a match form a group of their own,
    so that columns without any match are listed too.  No window and no list of
    values: a column may have any length.
    """
    found = F.explode_outer(matches_of(F.col("value"), F.col("column_name"))).alias("m")
    per_type = (
        cells.select("table_name", "column_name", "position", found)
        .groupBy("table_name", "column_name", F.col("m.pii_type").alias("pii_type"))
        .agg(
            F.count(F.lit(1)).alias("matches"),
            F.avg("m.confidence").alias("confidence"),
            # position and detector order in one number: a fixed-width buffer keeps this a hash aggregate
            F.min(F.col("position").cast("decimal(30,0)") * ORDER_SLOTS + F.col("m.ord")).alias("first_seen"),
        )
    )
    # the winner has most matches, then the earliest first match; the group without a type cannot win
    rank = F.struct("matches", (-F.col("first_seen")).alias("earliest"))
    leader = F.max_by(
        F.struct("pii_type", "matches", "confidence"), F.when(F.col("pii_type").isNotNull(), rank)
    )
    winners = per_type.groupBy("table_name", "column_name").agg(leader.alias("w"))
    technique = F.create_map(*[F.lit(x) for pair in TECHNIQUE_OF.items() for x in pair])
    return winners.select(
        "table_name",
        "column_name",
        F.col("w").isNotNull().alias("is_pii"),
        F.col("w.pii_type").alias("pii_type"),
        F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"),
        technique[F.col("w.pii_type")].alias("technique"),
        F.coalesce("w.matches", F.lit(0)).alias("matches"),
    )


def detection_texts(verdicts: DataFrame) -> DataFrame:
    """Adds the reason sentence of a verdict."""
    hit = F.concat(
        F.lit("Detected "), "pii_type", F.lit(" in "), F.col("matches").cast("string"),
        F.lit(" sample values using India-specific regex patterns"),
    )
    miss = F.lit("No India-specific PII patterns detected in sample values")
    return verdicts.withColumn("reason", F.when(F.col("is_pii"), hit).otherwise(miss))


def merge_detections(external: DataFrame, regex: DataFrame, keys: Sequence[str] = ("table_name", "column_name")) -> DataFrame:
    """Combine an external classifier's answers with the pattern verdicts."""
    e, r = external.alias("e"), regex.alias("r")
    joined = e.join(r, list(keys), "full_outer")
    e_pii = F.coalesce("e.is_pii", F.lit(False))
    r_pii = F.coalesce("r.is_pii", F.lit(False))
    e_conf = F.coalesce("e.confidence", F.lit(0.0))
    r_conf = F.coalesce("r.confidence", F.lit(0.0))
    both = e_pii & r_pii
    return joined.select(
        *keys,
        (e_pii | r_pii).alias("is_pii"),
        F.when(both, F.coalesce("e.pii_type", "r.pii_type"))
        .when(e_pii, F.col("e.pii_type"))
        .when(r_pii, F.col("r.pii_type"))
        .alias("pii_type"),
        F.when(both, F.least(F.lit(CEILING), F.greatest(e_conf, r_conf) + F.lit(AGREEMENT_BONUS)))
        .when(e_pii, e_conf)
        .when(r_pii, F.greatest(F.lit(0.0), r_conf - F.lit(LONE_RULE_PENALTY)))
        .otherwise(F.lit(0.0))
        .alias("confidence"),
        F.when(both, F.coalesce("e.technique", "r.technique"))
        .when(e_pii, F.col("e.technique"))
        .when(r_pii, F.col("r.technique"))
        .otherwise(F.lit("no_change"))
        .alias("technique"),
        F.when(both, "combined").when(e_pii, "external").when(r_pii, "regex").otherwise("combined").alias("method"),
    )


def fill_missing_answers(columns: DataFrame, external: DataFrame, keys: Sequence[str] = ("table_name", "column_name")) -> DataFrame:
    """A column without an external answer is treated as personal until someone says otherwise."""
    answered = external.withColumn("_answered", F.lit(True))
    joined = columns.select(*keys).join(answered, list(keys), "left")
    known = F.coalesce("_answered", F.lit(False))
    return joined.select(
        *keys,
        F.when(known, F.col("is_pii")).otherwise(F.lit(True)).alias("is_pii"),
        F.when(known, F.col("pii_type")).otherwise(F.lit("unknown")).alias("pii_type"),
        F.when(known, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(known, F.col("technique")).otherwise(F.lit("tokenization")).alias("technique"),
    )


def safety_net(detections: DataFrame) -> DataFrame:
    """Flag columns by name when no detector did."""
    low = F.lower("column_name")
    caught = ~F.coalesce("is_pii", F.lit(False)) & any_of(low, SAFETY_NET_NAMES)
    swap = {
        "is_pii": F.lit(True),
        "pii_type": F.upper("column_name"),
        "confidence": F.lit(0.9),
        "technique": F.lit("MASKING"),
    }
    return detections.select(
        *[
            F.when(caught, swap[c]).otherwise(F.col(c)).alias(c) if c in swap else F.col(c)
            for c in detections.columns
        ]
    )


def upper_labels(detections: DataFrame) -> DataFrame:
    """Type and technique in upper case, as the policy expects them."""
    return detections.withColumns(
        {"pii_type": F.upper("pii_type"), "technique": F.upper("technique")}
    )


# --- detectors as plug-ins --------------------------------------------------------------------

Detector = Callable[[DataFrame], DataFrame]
_DETECTORS: dict[str, Detector] = {}
VERDICT = "table_name string, column_name string, is_pii boolean, pii_type string, confidence double, technique string, matches long"


def register_detector(name: str) -> Callable[[Detector], Detector]:
    """Add a detector: from cells (``long_form``) to one verdict per column, in the form of ``VERDICT``."""

    def add(build: Detector) -> Detector:
        _DETECTORS[name] = build
        return build

    return add


def known_detectors() -> tuple[str, ...]:
    return tuple(_DETECTORS)


register_detector("patterns")(column_verdicts)


def expression_detector(pii_type: str, test: Callable[[Column], Column], technique: str, least: float = 0.5) -> Detector:
    """A detector from a test of one value: a column is of the type if a share of its values passes.

    The share is the confidence.  Null and empty values don't count.
    """

    def verdicts(cells: DataFrame) -> DataFrame:
        filled = F.col("value").isNotNull() & (F.col("value") != "")
        counted = cells.groupBy("table_name", "column_name").agg(
            F.count_if(filled).alias("n"), F.count_if(filled & F.coalesce(test(F.col("value")), F.lit(False))).alias("matches")
        )
        share = F.coalesce(F.col("matches") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0))
        hit = (F.col("matches") > 0) & (share >= least)
        return counted.select(
            "table_name", "column_name", hit.alias("is_pii"), F.when(hit, F.lit(pii_type)).alias("pii_type"),
            F.when(hit, share).otherwise(0.0).alias("confidence"), F.when(hit, F.lit(technique)).alias("technique"), "matches",
        )

    return verdicts


def batch_detector(pii_type: str, test: Callable[[Any], Any], technique: str, least: float = 0.5) -> Detector:
    """The same from a test of Arrow arrays: it gets the values of a batch and returns as many booleans.

    For models that are no Spark expression; values go to Python in Arrow batches, counts come back.
    """

    def verdicts(cells: DataFrame) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                hit = pa.array(test(batch.column(2)), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hit], names=["table_name", "column_name", "value"])

        judged = cells.filter("value is not null and value <> ''").select("table_name", "column_name", "value")
        judged = judged.mapInArrow(run, "table_name string, column_name string, value boolean")
        known = cells.select("table_name", "column_name").distinct().withColumn("value", F.lit(None).cast("string"))
        texts = judged.withColumn("value", F.col("value").cast("string")).unionByName(known)
        return expression_detector(pii_type, lambda v: v == "true", technique, least)(texts)

    return verdicts


def detect_with(cells: DataFrame, detectors: Sequence[str] | None = None) -> DataFrame:
    """Verdicts of several detectors merged by one rule, one row per column.

    The verdict of the highest confidence decides, of equal ones that of the
    detector named first.  Every further detector that found the same type adds
    the bonus of agreement, up to the ceiling; a pattern that nobody confirms
    loses the penalty of a lone rule.  ``detectors`` holds the names of all
    that found the column personal, in the order given.
    """
    names = list(_DETECTORS if detectors is None else detectors)
    parts = [
        _DETECTORS[name](cells).select("table_name", "column_name", "is_pii", "pii_type", "confidence", "technique", F.lit(i).alias("place"))
        for i, name in enumerate(names)
    ]
    found = union_all(parts).withColumn("pii_type", F.lower("pii_type"))
    best = F.max_by(
        F.struct("pii_type", "confidence", "technique", "place"), F.when(F.col("is_pii"), F.struct("confidence", (-F.col("place")).alias("p")))
    )
    said = F.array_sort(F.collect_list(F.when(F.col("is_pii"), F.struct("place", "pii_type"))))
    merged = found.groupBy("table_name", "column_name").agg(best.alias("b"), said.alias("said"))
    agreeing = F.size(F.filter("said", lambda s: s["pii_type"] == F.col("b.pii_type"))) - 1
    lone = (F.size("said") == 1) & (F.element_at(F.array(*[F.lit(n) for n in names]), F.col("b.place") + 1) == "patterns") & F.lit(len(names) > 1)
    raised = F.least(F.greatest(F.lit(CEILING), F.col("b.confidence")), F.col("b.confidence") + agreeing * AGREEMENT_BONUS)
    confidence = F.when(lone, F.greatest(F.lit(0.0), F.col("b.confidence") - LONE_RULE_PENALTY)).otherwise(raised)
    return merged.select(
        "table_name", "column_name", F.col("b").isNotNull().alias("is_pii"), F.col("b.pii_type").alias("pii_type"),
        F.when(F.col("b").isNotNull(), confidence).otherwise(0.0).alias("confidence"), F.col("b.technique").alias("technique"),
        F.array_join(F.transform("said", lambda s: F.element_at(F.array(*[F.lit(n) for n in names]), s["place"] + 1)), ",").alias("detectors"),
    )
