"""Column policies: generation, overrides, review status, schema shift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_of
from ..operators.ordered import running_sum, salted_lookup

COLUMN_KEY = ("table_name", "column_name")

# Raw types that say nothing.
NO_TYPE = ("UNKNOWN", "NONE", "NON_PII", "NULL")

# Type by column name, tested in this order.
TYPE_BY_NAME = (
    ("EMAIL", ("email",)),
    ("PHONE", ("phone", "mobile", "contact")),
    ("AADHAAR", ("aadhaar", "uid")),
    ("PAN", ("pan",)),
    ("FULL_NAME", ("name",)),
    ("DATE_OF_BIRTH", ("dob", "birth")),
    ("LOCATION", ("address", "city", "state", "pin", "location")),
    ("FINANCIAL", ("salary", "balance", "amount", "income")),
    ("SSN", ("ssn", "social_security")),
    ("CREDIT_CARD", ("card",)),
    ("IDENTIFIER", ("id",)),
)

# Technique by column name, tested in this order and before the type.
TECHNIQUE_BY_NAME = (
    ("TOKENIZATION", ("email", "phone", "mobile", "contact", "name")),
    ("MASKING", ("aadhaar", "pan", "address", "city", "state", "pin", "location")),
    ("HASHING", ("id", "ssn", "gstin", "account_number")),
    ("DIFFERENTIAL_PRIVACY", ("salary", "balance", "amount", "income", "dob", "birth", "age")),
)

# Technique by type; anything else is masked.
TECHNIQUE_BY_TYPE = (
    ("NO_CHANGE", ("NON_PII", "NONE")),
    ("TOKENIZATION", ("EMAIL", "PHONE", "FULL_NAME", "NAME", "INDIAN_PHONE")),
    (
        "MASKING",
        ("AADHAAR", "PAN", "LOCATION", "ADDRESS", "CITY", "STATE", "PINCODE", "VOTER_ID", "DRIVING_LICENSE"),
    ),
    ("HASHING", ("IDENTIFIER", "SSN", "GSTIN", "BANK_ACCOUNT", "CREDIT_CARD")),
    (
        "DIFFERENTIAL_PRIVACY",
        ("FINANCIAL", "BALANCE", "SALARY", "DATE_OF_BIRTH", "DOB", "AGE", "HEALTH", "MEDICAL"),
    ),
)

# What a technique does, in words.
JUSTIFICATIONS = {
    "TOKENIZATION": "Replace with realistic fake values for usability while protecting privacy",
    "MASKING": "Mask sensitive characters to preserve format while obscuring data",
    "HASHING": "One-way hash for irreversible identification protection",
    "DIFFERENTIAL_PRIVACY": "Add statistical noise to preserve statistical properties",
    "PSEUDONYMIZATION": "Replace with consistent pseudonyms for referential integrity",
    "GENERALIZATION": "Generalize to broader categories for privacy protection",
    "REDACTION": "Complete removal for highly sensitive data",
    "NO_CHANGE": "No anonymization required",
}


def _first(tests: Sequence[tuple[Column, Column]], default: Column) -> Column:
    return F.coalesce(*[F.when(test, result) for test, result in tests], default)


def normalize_type(column_name: Column, raw_type: Column, is_pii: Column) -> Column:
    """PII type of a column: an explicit type wins, else the name decides, else SENSITIVE."""
    low, given = F.lower(column_name), F.upper(raw_type)
    explicit = raw_type.isNotNull() & (raw_type != "") & ~given.isin(*NO_TYPE)
    by_name = [(any_of(low, parts), F.lit(kind)) for kind, parts in TYPE_BY_NAME]
    named = _first([(explicit, given), *by_name], F.lit("SENSITIVE"))
    return F.when(F.coalesce(is_pii, F.lit(False)), named).otherwise(F.lit("NON_PII"))


def default_technique(column_name: Column, pii_type: Column) -> Column:
    """Technique of a personal column: the name decides first, then the type."""
    low, kind = F.lower(column_name), F.upper(pii_type)
    by_name = [(any_of(low, parts), F.lit(t)) for t, parts in TECHNIQUE_BY_NAME]
    no_type = (pii_type.isNull() | (pii_type == ""), F.lit("NO_CHANGE"))
    by_type = [(kind.isin(*kinds), F.lit(t)) for t, kinds in TECHNIQUE_BY_TYPE]
    return _first([*by_name, no_type, *by_type], F.lit("MASKING"))


def reason_text(is_pii: Column, pii_type: Column, technique: Column, confidence: Column) -> Column:
    """Why a column is treated the way it is; the last part names the confidence band."""
    # fixed values: the sentences of a reason and the bounds of its bands
    words = F.create_map(*[F.lit(x) for pair in JUSTIFICATIONS.items() for x in pair])
    conf = F.coalesce(confidence, F.lit(0.0))
    band = (
        F.when(conf >= 0.9, "High confidence detection")
        .when(conf >= 0.7, "Medium confidence detection")
        .otherwise("Lower confidence detection - manual review recommended")
    )
    parts = F.concat_ws(". ", F.concat(F.lit("Column identified as "), pii_type), words[technique], band)
    return F.when(is_pii, F.concat(parts, F.lit("."))).otherwise(
        F.lit("Column identified as non-PII. No anonymization required.")
    )


def generate_policy(detections: DataFrame, catalog: DataFrame, keys: Sequence[str] = COLUMN_KEY) -> DataFrame:
    """One policy row per detected column, with the key flags of the catalog."""
    facts = catalog.select(*keys, "data_type", "is_pk", "fk_table", "fk_column")
    joined = detections.join(facts, list(keys), "left")
    pii = F.coalesce("is_pii", F.lit(False))
    typed = joined.withColumn("_type", normalize_type(F.col("column_name"), F.col("pii_type"), pii))
    technique = F.when(pii, default_technique(F.col("column_name"), F.col("_type"))).otherwise("NO_CHANGE")
    decided = typed.withColumn("_technique", technique)
    given = F.coalesce("confidence", F.when(pii, F.lit(0.9)).otherwise(F.lit(0.0)))
    return decided.select(
        *keys,
        pii.alias("is_pii"),
        F.col("_type").alias("pii_type"),
        F.when(pii & (given == 0.0), F.lit(0.9)).otherwise(given).alias("confidence"),
        F.col("_technique").alias("technique"),
        reason_text(pii, F.col("_type"), F.col("_technique"), F.col("confidence")).alias("reason"),
        F.coalesce("is_pk", F.lit(False)).alias("is_pk"),
        "fk_table",
        "fk_column",
        F.coalesce("data_type", F.lit("UNKNOWN")).alias("data_type"),
        F.lit(False).alias("admin_override"),
        F.lit("").alias("admin_comment"),
    )


def keep_keys_apart(policy: DataFrame, hops: int = 8) -> DataFrame:
    """The policy with one technique along every chain of keys that it rewrites.

    A chain is a referenced column with all columns that reference it, over
    at most ``hops`` tables.  If any of them is to be changed, all are hashed:
    masks and general values would merge keys, and different techniques would
    part them.  Primary keys without references count as chains of one.
    """
    links = policy.filter("fk_table is not null").select(
        F.col("table_name").alias("_ft"), F.col("column_name").alias("_fc"), F.col("fk_table").alias("_tt"), F.col("fk_column").alias("_tc")
    )
    rooted = policy.withColumns({"_t": F.coalesce("fk_table", "table_name"), "_c": F.coalesce("fk_column", "column_name")})
    for _ in range(hops - 1):
        rooted = rooted.join(links, (F.col("_t") == F.col("_ft")) & (F.col("_c") == F.col("_fc")), "left").select(
            *policy.columns, F.coalesce("_tt", "_t").alias("_t"), F.coalesce("_tc", "_c").alias("_c")
        )
    changed = F.col("technique") != "NO_CHANGE"
    is_key = F.coalesce("is_pk", F.lit(False)) | F.col("fk_table").isNotNull()
    chains = rooted.groupBy("_t", "_c").agg(F.bool_or(changed).alias("_any"), F.bool_or(is_key).alias("_key"))
    hashed = F.col("_any") & F.col("_key") & (F.col("technique") != "HASHING")
    reason = reason_text(F.lit(True), F.col("pii_type"), F.lit("HASHING"), F.col("confidence"))
    swaps = {"technique": F.lit("HASHING"), "reason": reason}
    return rooted.join(chains, ["_t", "_c"]).select(
        *[F.when(hashed, swaps[c]).otherwise(F.col(c)).alias(c) if c in swaps else F.col(c) for c in policy.columns]
    )


def policy_totals(policy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns, personal columns and their share."""
    total, pii = F.count(F.lit(1)), F.count_if("is_pii")
    return policy.groupBy(*by).agg(
        total.alias("total_columns"),
        pii.alias("pii_columns"),
        (total - pii).alias("non_pii_columns"),
        F.bround(pii / total * 100, 1).alias("pii_percentage"),
    )


def policy_distributions(policy: DataFrame) -> DataFrame:
    """Counts by technique, by type (personal columns only) and by table in one grouping-sets pass."""
    base = policy.select(
        "technique", F.when(F.col("is_pii"), F.col("pii_type")).alias("pii_type"), "table_name"
    )
    sets = base.groupingSets(
        [("technique",), ("pii_type",), ("table_name",)], "technique", "pii_type", "table_name"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.grouping("technique").alias("g1"),
        F.grouping("pii_type").alias("g2"),
        F.grouping("table_name").alias("g3"),
    )
    kind = F.when(F.col("g1") == 0, "technique").when(F.col("g2") == 0, "pii_type").otherwise("table")
    label = F.when(F.col("g1") == 0, F.col("technique")).when(F.col("g2") == 0, F.col("pii_type")).otherwise(
        F.col("table_name")
    )
    return sets.select(kind.alias("kind"), label.alias("label"), "n").filter("label is not null")


def require_draft(status: str) -> None:
    if status != "DRAFT":
        raise ValueError(f"policy is {status}; only a DRAFT policy can be changed")


def apply_overrides(
    policy: DataFrame,
    overrides: DataFrame,
    keys: Sequence[str] = COLUMN_KEY,
    statuses: DataFrame | None = None,
) -> DataFrame:
    """Technique overrides by a reviewer; the latest override of a column counts.

    ``overrides``: keys, ``new_technique``, ``comment``, ``seq``.  With
    ``statuses`` (``policy_id, status``) only DRAFT policies are changed.
    """
    latest = overrides.groupBy(*keys).agg(
        F.max_by(F.struct("new_technique", "comment"), "seq").alias("o")
    )
    if statuses is not None:
        draft = statuses.filter(F.col("status") == "DRAFT").select("policy_id")
        latest = latest.join(draft, "policy_id", "left_semi")
    joined = policy.join(latest, list(keys), "left")
    hit = F.col("o").isNotNull()
    swaps = {
        "technique": F.when(hit, F.upper("o.new_technique")).otherwise(F.col("technique")),
        "admin_override": hit | F.col("admin_override"),
        "admin_comment": F.when(hit, F.coalesce("o.comment", F.lit(""))).otherwise(F.col("admin_comment")),
    }
    return joined.select(*[swaps[c].alias(c) if c in swaps else F.col(c) for c in policy.columns])


def judge_events(
    events: DataFrame, order: Sequence[str] = ("ts", "event_id"), bucket: Column | None = None
) -> DataFrame:
    """Which review events took effect.

    ``events``: ``policy_id, action (approve / reject / reset), comment`` and the
    order columns.  A decision counts only on a DRAFT policy, a rejection needs
    a comment, a reset only leaves a decided policy.  Whether an event counts
    depends only on its stretch between two resets: the first valid decision of
    a stretch counts, and a reset counts when the stretch before it was decided.
    So no fold over the history is needed, and a policy may have any number of
    events.
    """
    is_reset = F.col("action") == "reset"
    valid = (F.col("action") == "approve") | (
        (F.col("action") == "reject") & (F.coalesce("comment", F.lit("")) != "")
    )
    stretches = running_sum(events, ["policy_id"], list(order), is_reset.cast("int"), "stretch", bucket)
    decided = stretches.filter(valid).groupBy("policy_id", "stretch").agg(
        F.min(F.struct(*order)).alias("_first")
    )
    looked = salted_lookup(
        stretches,
        {"policy_id": F.col("policy_id"), "stretch": F.col("stretch") - is_reset.cast("int")},
        decided,
        ["_first"],
    )
    is_first = F.coalesce(F.struct(*order) == F.col("_first"), F.lit(False))
    accepted = F.when(is_reset, F.col("_first").isNotNull()).otherwise(valid & is_first)
    after = F.when(is_reset, "DRAFT").when(F.col("action") == "approve", "APPROVED").otherwise("REJECTED")
    return looked.select(*events.columns, accepted.alias("accepted"), F.when(accepted, after).alias("status_after"))


def current_status(
    events: DataFrame, order: Sequence[str] = ("ts", "event_id"), bucket: Column | None = None
) -> DataFrame:
    """Status of every policy: that of its last accepted event, DRAFT without one."""
    judged = judge_events(events, order, bucket)
    key = F.when(F.col("accepted"), F.struct(*order))
    return judged.groupBy("policy_id").agg(
        F.coalesce(F.max_by("status_after", key), F.lit("DRAFT")).alias("status")
    )


def require_approved(statuses: DataFrame, policy_id: str) -> None:
    """The approval gate: raise before anything is read or written."""
    row = statuses.filter(F.col("policy_id") == policy_id).select("status").first()
    status = row["status"] if row else "DRAFT"
    if status != "APPROVED":
        raise PermissionError(f"policy {policy_id} is {status}, not APPROVED")


def missing_columns(catalog: DataFrame, policy: DataFrame, keys: Sequence[str] = COLUMN_KEY) -> DataFrame:
    """Live columns the policy does not know."""
    return catalog.join(policy.select(*keys).distinct(), list(keys), "left_anti")


def extend_policy(policy: DataFrame, detections: DataFrame, catalog: DataFrame) -> DataFrame:
    """Policy with the rows of newly found columns appended."""
    fresh = generate_policy(detections, missing_columns(catalog, policy))
    wanted = fresh.join(missing_columns(catalog, policy).select(*COLUMN_KEY), list(COLUMN_KEY), "left_semi")
    return policy.unionByName(wanted)


def status_after_shift(statuses: DataFrame, shifted: DataFrame) -> DataFrame:
    """Policies with new columns go back to DRAFT."""
    hit = shifted.select("policy_id").distinct().withColumn("_shift", F.lit(True))
    return statuses.join(hit, "policy_id", "left").select(
        "policy_id", F.when(F.col("_shift"), F.lit("DRAFT")).otherwise(F.col("status")).alias("status")
    )


def key_report(policy: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Key columns that are rewritten, and whether a foreign key agrees with its target."""
    own = policy.filter((F.col("is_pk") | F.col("fk_table").isNotNull()))
    target = policy.select(
        *[F.col(k).alias(f"_t_{k}") for k in keys],
        F.col("table_name").alias("_t"),
        F.col("column_name").alias("_c"),
        F.col("technique").alias("target_technique"),
    )
    test = (F.col("fk_table") == F.col("_t")) & (F.col("fk_column") == F.col("_c"))
    for k in keys:
        test = test & (F.col(k) == F.col(f"_t_{k}"))
    return (
        own.join(target, test, "left")
        .filter((F.col("technique") != "NO_CHANGE") | (F.col("target_technique") != F.col("technique")))
        .select(
            *keys,
            "table_name",
            "column_name",
            F.when(F.col("is_pk"), "PK").otherwise("FK").alias("key_kind"),
            "technique",
            "target_technique",
            F.coalesce(F.col("technique") != F.col("target_technique"), F.lit(False)).alias("mismatch"),
        )
    )
