"""Policy documents: three JSON shapes flattened to one policy table.

``policy_rows`` gives the whole rows, ready to be applied: key flags, data types
and overrides where a document has them, and every entry as it was written, so
that fields nobody asks for here are not lost.  ``flatten`` is the short view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTPUT = ("policy_id", "table_name", "column_name", "is_pii", "pii_type", "confidence", "technique", "reason")
KEYS = ("is_pk", "fk_table", "fk_column", "data_type", "admin_override", "admin_comment", "entry")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as ``(policy_id, doc)``; the file name is the policy id."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return files.select(name.alias("policy_id"), F.col("value").alias("doc"))


def policy_rows(documents: DataFrame) -> DataFrame:
    """Policy rows of every document: list form first, else the two ``tables`` forms.

    One pass: a document is parsed once as a variant, by the form it has its
    rows become an array of equal structs, and the array is inlined.  ``entry``
    is the JSON text of what the document says about the column.
    """
    doc = documents.withColumn("_v", F.try_parse_json("doc"))
    listed, tables = _get("_v", "$.column_policies", "variant"), _get("_v", "$.tables", "variant")
    first = F.schema_of_variant(_get("_v", "$.column_policies[0]", "variant"))
    has_list = F.coalesce(first.startswith("OBJECT"), F.lit(False))
    shape = F.coalesce(F.schema_of_variant(tables), F.lit(""))
    fallback = F.coalesce(_get("_v", "$.policy_metadata.target_table", "string"), F.lit("employees"))
    as_list = F.when(has_list, listed.try_cast("array<variant>"))
    as_map = F.when(~has_list & shape.startswith("OBJECT"), tables.try_cast("map<string,map<string,variant>>"))
    as_nested = F.when(~has_list & shape.startswith("ARRAY"), tables.try_cast("array<variant>"))
    rows = F.coalesce(
        F.transform(as_list, _listed_row),
        F.flatten(F.transform(F.map_entries(as_map), _mapped_rows)),
        F.flatten(F.transform(as_nested, lambda table: _nested_rows(table, fallback))),
    )
    return doc.select("policy_id", F.inline(rows)).select(*OUTPUT, *KEYS)


def flatten(documents: DataFrame) -> DataFrame:
    """The policy rows without key and override fields."""
    return policy_rows(documents).select(*OUTPUT)


def _get(variant: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(variant, path, kind)


def _row(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _kept(c: Column) -> dict[str, Column]:
    """Key and override fields of an entry; a foreign key counts if its table is named, unless it is denied."""
    referred = _get(c, "$.foreign_key_details.referred_table", "string")
    denied = ~F.coalesce(_get(c, "$.is_foreign_key", "boolean"), F.lit(True))
    referred = F.when(~denied, referred)
    return {
        "is_pk": F.coalesce(_get(c, "$.is_primary_key", "boolean"), F.lit(False)),
        "fk_table": referred,
        "fk_column": F.when(referred.isNotNull(), _get(c, "$.foreign_key_details.referred_columns[0]", "string")),
        "data_type": _get(c, "$.data_type", "string"),
        "admin_override": F.coalesce(_get(c, "$.admin_override", "boolean"), F.lit(False)),
        "admin_comment": F.coalesce(_get(c, "$.admin_comments", "string"), F.lit("")),
        "entry": F.to_json(c),
    }


def _listed_row(c: Column) -> Column:
    return _row(
        table_name=_get(c, "$.table_name", "string"),
        column_name=_get(c, "$.column_name", "string"),
        is_pii=F.coalesce(_get(c, "$.is_pii", "boolean"), F.lit(False)),
        pii_type=_get(c, "$.pii_type", "string"),
        confidence=F.coalesce(_get(c, "$.confidence", "double"), F.lit(0.0)),
        technique=F.upper(F.coalesce(_get(c, "$.anonymization_technique", "string"), F.lit("NO_CHANGE"))),
        reason=_get(c, "$.reason", "string"),
        **_kept(c),
    )


def _mapped_rows(table: Column) -> Column:
    return F.transform(
        F.map_entries(table["value"]),
        lambda c: _row(
            table_name=table["key"],
            column_name=c["key"],
            is_pii=F.lit(True),
            pii_type=F.upper(c["key"]),
            confidence=F.lit(0.9),
            technique=_technique(_get(c["value"], "$.technique", "string")),
            reason=F.concat(F.lit("Sensitive column "), c["key"]),
            **_kept(c["value"]),
        ),
    )


def _nested_rows(table: Column, fallback: Column) -> Column:
    return F.transform(
        _get(table, "$.columns", "array<variant>"),
        lambda c: _row(
            table_name=F.coalesce(_get(table, "$.table_name", "string"), fallback),
            column_name=_get(c, "$.column_name", "string"),
            is_pii=F.coalesce(_get(c, "$.is_pii", "boolean"), F.lit(True)),
            pii_type=F.coalesce(_get(c, "$.pii_type", "string"), F.lit("PII")),
            confidence=F.coalesce(F.nanvl(_get(c, "$.confidence", "double"), F.lit(0.9)), F.lit(0.9)),
            technique=_technique(_get(c, "$.anonymization_technique", "string")),
            reason=F.coalesce(_get(c, "$.reason", "string"), F.lit("Sensitive data column")),
            **_kept(c),
        ),
    )


def _technique(value: Column) -> Column:
    """Upper-cased technique; missing or empty means MASKING."""
    return F.upper(F.coalesce(F.when(value != "", value), F.lit("MASKING")))
