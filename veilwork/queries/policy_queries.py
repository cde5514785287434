"""Classification, policies and their risk, over columns declared by the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.techniques import destination_type_column
from ..operators import search, stats
from ..operators.apply import apply_policy, rules_from
from ..plans import classify, policy, risk, validate
from ..sources import policy_docs
from .derived import cte, frame
from .registry import SETTINGS, first_of, has_any, q, query

_LOW = "lower(column_name)"

_TYPE = first_of(
    [
        ("NOT is_pii", "'NON_PII'"),
        (f"pii_type IS NOT NULL AND pii_type <> '' AND upper(pii_type) NOT IN {policy.NO_TYPE}", "upper(pii_type)"),
        *[(has_any(_LOW, parts), q(kind)) for kind, parts in policy.TYPE_BY_NAME],
    ],
    "'SENSITIVE'",
)


def _technique(kind: str) -> str:
    by_type = [(f"upper({kind}) IN ({', '.join(q(k) for k in kinds)})", q(t)) for t, kinds in policy.TECHNIQUE_BY_TYPE]
    return first_of(
        [
            ("NOT is_pii", "'NO_CHANGE'"),
            *[(has_any(_LOW, parts), q(t)) for t, parts in policy.TECHNIQUE_BY_NAME],
            (f"{kind} IS NULL OR {kind} = ''", "'NO_CHANGE'"),
            *by_type,
        ],
        "'MASKING'",
    )


_GEN = f""", typed AS (SELECT *, {_TYPE} AS kind FROM fields),
 pol AS (SELECT *, {_technique("kind")} AS tech FROM typed)
"""


@query(
    "normalize_types",
    cte("fields") + f"SELECT policy_id, column_name, {_TYPE} AS pii_type FROM fields",
)
def normalize_types(t):
    kind = policy.normalize_type(F.col("column_name"), F.col("pii_type"), F.col("is_pii"))
    return frame(t, "fields").select("policy_id", "column_name", kind.alias("pii_type"))


@query(
    "default_techniques",
    cte("fields").replace("fields AS", "f0 AS", 1)
    + f", fields AS (SELECT policy_id, column_name, true AS is_pii, pii_type FROM f0) SELECT policy_id, column_name, {_technique('pii_type')} AS technique FROM fields",
)
def default_techniques(t):
    technique = policy.default_technique(F.col("column_name"), F.col("pii_type"))
    return frame(t, "fields").select("policy_id", "column_name", technique.alias("technique"))


_WORDS = first_of([(f"tech = {q(k)}", q(v)) for k, v in policy.JUSTIFICATIONS.items()], "NULL")


@query(
    "generate_policy",
    cte("fields")
    + _GEN
    + f"""SELECT policy_id, table_name, column_name, is_pii, kind AS pii_type,
    CASE WHEN is_pii AND coalesce(confidence, 0.9::double) = 0 THEN 0.9::double
         ELSE coalesce(confidence, CASE WHEN is_pii THEN 0.9::double ELSE 0.0::double END) END AS confidence,
    tech AS technique,
    CASE WHEN NOT is_pii THEN 'Column identified as non-PII. No anonymization required.'
         ELSE 'Column identified as ' || kind || '. ' || ({_WORDS}) || '. ' ||
           CASE WHEN coalesce(confidence, 0) >= 0.9 THEN 'High confidence detection' WHEN coalesce(confidence, 0) >= 0.7
           THEN 'Medium confidence detection' ELSE 'Lower confidence detection - manual review recommended' END || '.' END AS reason,
    is_pk, fk_table, fk_column, data_type FROM pol""",
)
def generate_policy(t):
    fields = frame(t, "fields")
    keys = ["policy_id", "table_name", "column_name"]
    detections = fields.select(*keys, "is_pii", "pii_type", "confidence")
    done = policy.generate_policy(detections, fields, keys)
    return done.drop("admin_override", "admin_comment")


def _policy(t):
    """The fields as finished policies (technique as declared)."""
    return frame(t, "fields").withColumns({"admin_override": F.lit(False), "admin_comment": F.lit("")})


@query(
    "policy_totals",
    cte("fields")
    + """SELECT policy_id, count(*) AS total_columns, count(*) FILTER (WHERE is_pii) AS pii_columns,
    count(*) FILTER (WHERE NOT is_pii) AS non_pii_columns,
    round_even(count(*) FILTER (WHERE is_pii)::double / count(*) * 100, 1) AS pii_percentage FROM fields GROUP BY policy_id""",
)
def policy_totals(t):
    return policy.policy_totals(_policy(t), ["policy_id"])


@query(
    "policy_distributions",
    cte("fields")
    + """SELECT 'technique' AS kind, technique AS label, count(*) AS n FROM fields GROUP BY technique
    UNION ALL SELECT 'pii_type', pii_type, count(*) FROM fields WHERE is_pii AND pii_type IS NOT NULL GROUP BY pii_type
    UNION ALL SELECT 'table', table_name, count(*) FROM fields GROUP BY table_name""",
)
def policy_distributions(t):
    return policy.policy_distributions(_policy(t))


_DIRECT = f"(upper(coalesce(pii_type, '')) IN {risk.DIRECT_TYPES} OR {has_any(_LOW, risk.DIRECT_NAMES)})"
_QUASI = f"(upper(coalesce(pii_type, '')) IN {risk.QUASI_TYPES} OR {has_any(_LOW, risk.QUASI_NAMES)} OR is_pii)"
_EXPOSED = f""", ex AS (SELECT *, CASE WHEN technique = 'NO_CHANGE' AND {_DIRECT} THEN 'direct'
   WHEN technique = 'NO_CHANGE' AND {_QUASI} THEN 'quasi' WHEN technique = 'DIFFERENTIAL_PRIVACY' THEN 'noise' END AS e FROM fields),
 pts AS (SELECT {{by}}, least(100.0::double, sum(CASE e WHEN 'direct' THEN 25 WHEN 'quasi' THEN 15 WHEN 'noise' THEN 2 ELSE 0 END)
   + CASE WHEN count(*) FILTER (WHERE e = 'quasi') >= 2 THEN 10 ELSE 0 END) AS risk_score FROM ex GROUP BY {{by}})
"""


@query(
    "policy_risk",
    cte("fields")
    + _EXPOSED.format(by="policy_id, table_name")
    + """SELECT policy_id, table_name, risk_score, 100.0::double - risk_score AS privacy_score,
    CASE WHEN risk_score = 0 THEN 'LOW' WHEN risk_score < 50 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
    CASE WHEN risk_score = 0 THEN 'GREEN' WHEN risk_score < 50 THEN 'YELLOW' ELSE 'RED' END AS risk_flag FROM pts""",
)
def policy_risk(t):
    return risk.policy_risk(_policy(t), ["policy_id", "table_name"])


@query(
    "vulnerabilities",
    cte("fields")
    + _EXPOSED.format(by="policy_id")
    + f"""SELECT policy_id, CASE e WHEN 'direct' THEN 'CRITICAL: Direct PII column ''' || table_name || '.' || column_name || ''' ('
       || coalesce(nullif(upper(pii_type), ''), column_name) || ') left un-anonymized (NO_CHANGE).'
     ELSE 'WARNING: Quasi-identifier column ''' || table_name || '.' || column_name || ''' left un-anonymized (NO_CHANGE).' END AS line
    FROM ex WHERE e IN ('direct', 'quasi')
    UNION ALL SELECT policy_id, {q(risk.LINKAGE_LINE)} FROM ex GROUP BY policy_id HAVING count(*) FILTER (WHERE e = 'quasi') >= 2""",
)
def vulnerabilities(t):
    return risk.vulnerabilities(_policy(t), ["policy_id"])


@query(
    "ratio_risk",
    cte("fields")
    + """, s AS (SELECT policy_id, round_even(least(100.0::double, coalesce(count(*) FILTER (WHERE is_pii AND technique = 'NO_CHANGE')::double
      / nullif(count(*) FILTER (WHERE is_pii), 0), 0.0::double) * 100), 1) AS risk_score FROM fields GROUP BY policy_id)
    SELECT policy_id, risk_score, round_even(100.0::double - risk_score, 1) AS privacy_score,
    CASE WHEN risk_score <= 20 THEN 'LOW' WHEN risk_score <= 50 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM s""",
)
def ratio_risk(t):
    return risk.ratio_risk(_policy(t), ["policy_id"])


@query(
    "sensitive_count_risk",
    cte("fields")
    + """SELECT policy_id, table_name, least(100, 2 * count(*) FILTER (WHERE technique <> 'NO_CHANGE'))::double AS risk_score
    FROM fields GROUP BY policy_id, table_name""",
)
def sensitive_count_risk(t):
    lowered = _policy(t).withColumn("technique", F.when(F.col("technique") == "NO_CHANGE", "none").otherwise(F.col("technique")))
    return risk.sensitive_count_risk(lowered, ["policy_id", "table_name"])


@query(
    "review_score",
    cte("fields")
    + """SELECT policy_id, table_name, least(95, greatest(8, floor(sum(CASE technique WHEN 'NO_CHANGE' THEN 30 WHEN 'PERTURBATION' THEN 8
      WHEN 'MASK_EMAIL' THEN 4 WHEN 'HASH_HMAC' THEN 3 WHEN 'TOKENIZATION' THEN 2 WHEN 'REDACTION' THEN 1 ELSE 5 END)::double
      / (30 * count(*)) * 100 + 0.5)))::bigint AS review_score FROM fields GROUP BY policy_id, table_name""",
)
def review_score(t):
    return risk.review_score(_policy(t), ["policy_id", "table_name"])


_OVER = """, o AS (SELECT policy_id, column_name, arg_max(new_technique, seq) AS nt, arg_max(comment, seq) AS nc FROM (
   SELECT policy_id, column_name, 'hashing' AS new_technique, 'first' AS comment, 1 AS seq FROM fields WHERE is_pk
   UNION ALL SELECT policy_id, column_name, 'redaction', 'second', 2 FROM fields WHERE is_pk AND is_pii) GROUP BY ALL)
"""


@query(
    "policy_overrides",
    cte("fields", "reviews")
    + _OVER
    + """, st AS (SELECT policy_id FROM reviews GROUP BY policy_id HAVING count(*) FILTER (WHERE action = 'reset') > 15)
    SELECT f.policy_id, f.table_name, f.column_name, coalesce(upper(o.nt), f.technique) AS technique,
    o.nt IS NOT NULL AS admin_override, coalesce(o.nc, '') AS admin_comment
    FROM fields f LEFT JOIN o ON f.policy_id = o.policy_id AND f.column_name = o.column_name
      AND f.policy_id IN (SELECT policy_id FROM st)""",
)
def policy_overrides(t):
    """Overrides by a reviewer: the latest wins, and only policies in DRAFT change."""
    base = _policy(t)
    keyed = base.filter("is_pk").select("policy_id", "table_name", "column_name", "is_pii")
    first = keyed.drop("is_pii").withColumns({"new_technique": F.lit("hashing"), "comment": F.lit("first"), "seq": F.lit(1)})
    second = (
        keyed.filter("is_pii")
        .drop("is_pii")
        .withColumns({"new_technique": F.lit("redaction"), "comment": F.lit("second"), "seq": F.lit(2)})
    )
    resets = frame(t, "reviews").groupBy("policy_id").agg(F.count_if(F.col("action") == "reset").alias("n"))
    statuses = resets.select("policy_id", F.when(F.col("n") > 15, "DRAFT").otherwise("APPROVED").alias("status"))
    done = policy.apply_overrides(base, first.unionByName(second), ["policy_id", "table_name", "column_name"], statuses)
    return done.select("policy_id", "table_name", "column_name", "technique", "admin_override", "admin_comment")


_FOLD = """list_reduce(list_prepend('DRAFT', list(code ORDER BY ts, event_id)), lambda s, a:
    CASE WHEN a = 'reset' THEN 'DRAFT' WHEN s = 'DRAFT' AND a IN ('APPROVED', 'REJECTED') THEN a ELSE s END)"""
_CODE = "CASE action WHEN 'reset' THEN 'reset' WHEN 'approve' THEN 'APPROVED' ELSE CASE WHEN coalesce(comment, '') <> '' THEN 'REJECTED' ELSE 'void' END END AS code"


@query(
    "policy_status",
    cte("reviews") + f"SELECT policy_id, {_FOLD} AS status FROM (SELECT *, {_CODE} FROM reviews) GROUP BY policy_id",
)
def policy_status(t):
    """Current status of every policy; the reference folds each history event by event."""
    return policy.current_status(frame(t, "reviews"))


@query(
    "policy_transitions",
    cte("reviews")
    + f""", c AS (SELECT *, {_CODE} FROM reviews),
    w AS (SELECT *, coalesce(list(code) OVER (PARTITION BY policy_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS past FROM c),
    f AS (SELECT *, list_reduce(list_prepend('DRAFT', past), lambda s, a:
      CASE WHEN a = 'reset' THEN 'DRAFT' WHEN s = 'DRAFT' AND a IN ('APPROVED', 'REJECTED') THEN a ELSE s END) AS before FROM w)
    SELECT event_id, policy_id, action, ok AS accepted, CASE WHEN ok THEN CASE WHEN code = 'reset' THEN 'DRAFT' ELSE code END END AS status_after
    FROM (SELECT *, CASE WHEN code = 'reset' THEN before <> 'DRAFT' WHEN code = 'void' THEN false ELSE before = 'DRAFT' END AS ok FROM f)""",
)
def policy_transitions(t):
    """Which review events took effect."""
    judged = policy.judge_events(frame(t, "reviews"))
    return judged.select("event_id", "policy_id", "action", "accepted", "status_after")


@query(
    "review_metadata",
    cte("fields")
    + _EXPOSED.format(by="policy_id")
    + """SELECT f.policy_id, count(*) AS total_columns, count(*) FILTER (WHERE is_pii) AS pii_columns, count(*) FILTER (WHERE is_pk) AS admin_overrides,
    any_value(risk_score) AS risk_score,
    any_value(CASE WHEN risk_score = 0 THEN 'GREEN' WHEN risk_score < 50 THEN 'YELLOW' ELSE 'RED' END) AS risk_flag, true AS is_approvable
    FROM fields f JOIN pts ON f.policy_id = pts.policy_id GROUP BY f.policy_id""",
)
def review_metadata(t):
    return risk.review_metadata(_policy(t).withColumn("admin_override", F.col("is_pk")), ["policy_id"])


@query(
    "schema_shift",
    cte("fields")
    + """, known AS (SELECT DISTINCT policy_id, table_name, column_name FROM fields WHERE NOT is_pk)
    SELECT f.policy_id, f.table_name, f.column_name FROM fields f LEFT JOIN known k
    ON f.policy_id = k.policy_id AND f.table_name = k.table_name AND f.column_name = k.column_name WHERE k.column_name IS NULL""",
)
def schema_shift(t):
    """Live columns the policy does not know yet."""
    fields = frame(t, "fields")
    keys = ["policy_id", "table_name", "column_name"]
    return policy.missing_columns(fields.select(*keys), fields.filter("not is_pk"), keys)


@query(
    "shift_status",
    cte("fields", "reviews")
    + f""", st AS (SELECT policy_id, {_FOLD} AS status FROM (SELECT *, {_CODE} FROM reviews) GROUP BY policy_id)
    SELECT policy_id, CASE WHEN policy_id IN (SELECT policy_id FROM fields WHERE is_pk AND NOT is_pii AND data_type = 'date') THEN 'DRAFT' ELSE status END AS status FROM st""",
)
def shift_status(t):
    """Policies whose tables got new columns go back to DRAFT."""
    shifted = frame(t, "fields").filter("is_pk and not is_pii and data_type = 'date'")
    return policy.status_after_shift(policy.current_status(frame(t, "reviews")), shifted)


@query(
    "key_report",
    cte("fields")
    + """, tg AS (SELECT policy_id, table_name, min(technique) AS technique FROM fields WHERE is_pk GROUP BY policy_id, table_name),
    p AS (SELECT policy_id, table_name, column_name, is_pk, technique, CASE WHEN is_pk THEN NULL ELSE fk_table END AS fk FROM fields),
    j AS (SELECT p.*, tg.technique AS tt FROM p LEFT JOIN tg ON p.policy_id = tg.policy_id AND p.fk = tg.table_name WHERE p.is_pk OR p.fk IS NOT NULL)
    SELECT policy_id, table_name, column_name, CASE WHEN is_pk THEN 'PK' ELSE 'FK' END AS key_kind, technique, tt AS target_technique,
    coalesce(technique <> tt, false) AS mismatch FROM j WHERE technique <> 'NO_CHANGE' OR tt <> technique""",
)
def key_report(t):
    """Rewritten keys, and foreign keys whose technique differs from their target's."""
    fields = frame(t, "fields").select("policy_id", "table_name", "column_name", "is_pk", "technique", "fk_table", "fk_column")
    keyless = fields.withColumn("fk_table", F.when(~F.col("is_pk"), F.col("fk_table")))
    # one row per table stands for its key, so that a reference has a single target
    heads = fields.filter("is_pk").groupBy("policy_id", "table_name").agg(F.min("technique").alias("technique"))
    targets = heads.select(
        "policy_id", "table_name", F.lit("id").alias("column_name"), F.lit(False).alias("is_pk"), "technique",
        F.lit(None).cast("string").alias("fk_table"), F.lit(None).cast("string").alias("fk_column"),
    )
    return policy.key_report(keyless.unionByName(targets), ["policy_id"])


def _score(words) -> str:
    return " + ".join(f"contains(n, {q(w)})::int" for w in words)


_IND = ", ".join(f"sum({_score(words)})::bigint AS {k}" for k, words in classify.INDUSTRY_KEYWORDS.items())


@query(
    "industry",
    cte("fields")
    + f""", names AS (SELECT policy_id, lower(column_name) AS n FROM fields UNION ALL SELECT DISTINCT policy_id, lower(table_name) FROM fields),
    s AS (SELECT policy_id, {_IND} FROM names GROUP BY policy_id),
    l AS (UNPIVOT s ON {", ".join(classify.INDUSTRY_KEYWORDS)} INTO NAME industry VALUE score),
    b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY score DESC,
       list_position([{", ".join(q(k) for k in classify.INDUSTRY_KEYWORDS)}], industry)) = 1)
    SELECT policy_id, industry, score, round_even(least(0.7::double, score / 10.0::double), 2) AS confidence,
    {first_of([(f"industry = {q(k)}", q(v)) for k, v in classify.COMPLIANCE_LAWS.items()], "''")} AS compliance_law FROM b""",
)
def industry(t):
    """Industry of every tenant's schema from keyword hits."""
    done = classify.classify(frame(t, "fields"), ["policy_id"])
    return done.withColumn("score", F.col("score").cast("long"))


@query(
    "linkage_tables",
    cte("fields")
    + """SELECT policy_id, table_name FROM fields GROUP BY policy_id, table_name
    HAVING bool_or(regexp_matches(lower(column_name), 'dob|birth|date')) AND bool_or(regexp_matches(lower(column_name), 'zip|pin|postal'))
    AND bool_or(regexp_matches(lower(column_name), 'gender|sex'))""",
)
def linkage_tables(t):
    return validate.linkage_tables(frame(t, "fields"), ["policy_id", "table_name"])


@query(
    "destination_types",
    cte("fields")
    + """SELECT policy_id, column_name, CASE WHEN technique IN ('NO_CHANGE', 'NONE', 'PASSTHROUGH') THEN data_type
    WHEN technique = 'DIFFERENTIAL_PRIVACY' THEN CASE WHEN data_type = 'date' THEN data_type ELSE 'NUMERIC' END ELSE 'TEXT' END AS target_type FROM fields""",
)
def destination_types(t):
    kind = destination_type_column(F.col("data_type"), F.col("technique"))
    return frame(t, "fields").select("policy_id", "column_name", kind.alias("target_type"))


@query(
    "policy_search",
    cte("fields")
    + """SELECT policy_id, table_name, column_name, pii_type FROM fields
    WHERE (contains(lower(column_name), 'pan') OR contains(lower(pii_type), 'pan')) AND pii_type = 'PHONE'""",
)
def policy_search(t):
    return search.search_policy(frame(t, "fields"), "PAN", "PHONE").select("policy_id", "table_name", "column_name", "pii_type")


@query(
    "pii_columns",
    cte("fields") + "SELECT table_name, column_name, pii_type, technique FROM fields WHERE is_pii",
)
def pii_columns(t):
    return search.pii_columns(frame(t, "fields")).select("table_name", "column_name", "pii_type", "technique")


@query("policy_tables", cte("fields") + "SELECT DISTINCT table_name FROM fields")
def policy_tables(t):
    return stats.distinct_tables(frame(t, "fields"))


@query(
    "technique_mix",
    cte("fields")
    + """, c AS (SELECT policy_id, technique, count(*) AS columns FROM fields GROUP BY policy_id, technique)
    SELECT *, round_even(100::double * columns / sum(columns) OVER (PARTITION BY policy_id), 1) AS percentage FROM c""",
)
def technique_mix(t):
    return stats.technique_mix(frame(t, "fields"), ["policy_id"])


@query(
    "technique_mix_overall",
    cte("fields")
    + """, c AS (SELECT technique, count(*) AS columns FROM fields GROUP BY technique)
    SELECT *, round_even(100::double * columns / sum(columns) OVER (), 1) AS percentage FROM c""",
)
def technique_mix_overall(t):
    return stats.technique_mix(frame(t, "fields"))


@query(
    "policy_documents",
    cte("fields")
    + """SELECT seq::varchar AS policy_id,
    CASE WHEN seq % 4 = 3 THEN 'employees' ELSE table_name END AS table_name, column_name,
    CASE WHEN seq % 4 = 0 THEN is_pii ELSE true END AS is_pii,
    CASE seq % 4 WHEN 0 THEN pii_type WHEN 1 THEN upper(column_name) ELSE coalesce(pii_type, 'PII') END AS pii_type,
    CASE seq % 4 WHEN 0 THEN coalesce(confidence, 0.0) WHEN 1 THEN 0.9 ELSE coalesce(confidence, 0.9) END AS confidence,
    CASE WHEN seq % 4 = 1 AND is_pk THEN 'MASKING' ELSE technique END AS technique,
    CASE seq % 4 WHEN 0 THEN data_type WHEN 1 THEN 'Sensitive column ' || column_name ELSE 'Sensitive data column' END AS reason
    FROM fields""",
)
def policy_documents(t):
    """JSON policies in the list, map and nested form (one document per declared column)."""
    return policy_docs.flatten(_documents(t))


_PAPER = """{"policy_metadata": {"owner": "privacy"}, "column_policies": [
  {"table_name": "customer", "column_name": "c_custkey", "is_pii": true, "pii_type": "IDENTIFIER", "anonymization_technique": "hashing", "is_primary_key": true, "ticket": 7},
  {"table_name": "customer", "column_name": "c_mktsegment", "is_pii": true, "pii_type": "OTHER", "anonymization_technique": "masking", "admin_override": true, "admin_comments": "checked"},
  {"table_name": "orders", "column_name": "o_custkey", "is_pii": true, "pii_type": "IDENTIFIER", "anonymization_technique": "HASHING",
   "is_foreign_key": true, "foreign_key_details": {"referred_table": "customer", "referred_columns": ["c_custkey"]}},
  {"table_name": "orders", "column_name": "o_totalprice", "is_pii": false}]}"""


@query(
    "document_run",
    """SELECT sha256(c_custkey::varchar) AS c_custkey, repeat('X', length(c_mktsegment)) AS c_mktsegment, o_orderkey, o_totalprice
    FROM customer JOIN orders ON o_custkey = c_custkey""",
)
def document_run(t):
    """From a policy document to anonymized tables that still join on their keys."""
    policy = policy_docs.policy_rows(t.spark.createDataFrame([("paper", _PAPER)], "policy_id string, doc string"))
    rules = rules_from(policy, strict=True)
    customer = apply_policy(t.customer.select("c_custkey", "c_mktsegment"), "customer", rules, SETTINGS)
    orders = apply_policy(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "orders", rules, SETTINGS)
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice")


@query(
    "document_keys",
    cte("fields")
    + """SELECT seq::varchar AS policy_id, column_name, seq % 4 = 0 AND is_pk AS is_pk,
    CASE WHEN seq % 4 = 0 AND NOT is_pk THEN 'parent' END AS fk_table, CASE WHEN seq % 4 = 0 AND NOT is_pk THEN 'id' END AS fk_column,
    seq % 4 = 0 AND coalesce(confidence, 0) > 0.5 AS admin_override, CASE WHEN seq % 4 = 0 THEN seq END AS ticket FROM fields""",
)
def document_keys(t):
    """Key, override and unknown fields of policy documents survive, entry by entry."""
    found = policy_docs.policy_rows(_documents(t, whole=True))
    return found.select(
        "policy_id", "column_name", "is_pk", "fk_table", "fk_column", "admin_override", F.get_json_object("entry", "$.ticket").cast("long").alias("ticket")
    )


def _documents(t, whole=False):
    f = frame(t, "fields")
    form = F.col("seq") % 4
    entry = F.struct(
        "table_name", "column_name", "is_pii", "pii_type", "confidence",
        F.lower("technique").alias("anonymization_technique"), F.col("data_type").alias("reason"),
        *([
            F.col("is_pk").alias("is_primary_key"), (~F.col("is_pk")).alias("is_foreign_key"),
            F.struct(F.lit("parent").alias("referred_table"), F.array(F.lit("id")).alias("referred_columns")).alias("foreign_key_details"),
            (F.coalesce("confidence", F.lit(0.0)) > 0.5).alias("admin_override"), F.col("seq").alias("ticket"),
        ] if whole else []),
    )
    listed = F.to_json(F.struct(F.array(entry).alias("column_policies")))
    technique = F.struct(F.when(~F.col("is_pk"), F.lower("technique")).alias("technique"))
    by_column = F.create_map(F.col("column_name"), technique)
    mapped = F.to_json(F.struct(F.create_map(F.col("table_name"), by_column).alias("tables")))
    column = F.struct("column_name", "pii_type", "confidence", F.col("technique").alias("anonymization_technique"))
    table = F.struct(F.when(form == 2, F.col("table_name")).alias("table_name"), F.array(column).alias("columns"))
    nested = F.to_json(F.struct(F.array(table).alias("tables")))
    doc = F.when(form == 0, listed).when(form == 1, mapped).otherwise(nested)
    return f.select(F.col("seq").cast("string").alias("policy_id"), doc.alias("doc"))
