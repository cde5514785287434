"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm.bpe import op1_byte_bpe
from veilwork.llm.collocations import OP11_SQL, op11_collocations
from veilwork.llm.disclosure import op12_disclosure
from veilwork.llm.html_text import op6_html_text
from veilwork.llm.langid import op9_language_id
from veilwork.llm.licenses import OP7_SQL, op7_license_scan
from veilwork.llm.lines import op5_line_dedup
from veilwork.llm.minhash import op4_minhash_dedup
from veilwork.llm.mixing import OP10_SQL, op10_mix_sources
from veilwork.llm.quality import op8_quality_rules
from veilwork.llm.recompression import op13_periodic_runs
from veilwork.llm.suffixes import op3_suffix_dedup
from veilwork.llm.topk import OP2_SQL, op2_exact_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_byte_bpe, op2_exact_topk, op3_suffix_dedup, op4_minhash_dedup, op5_line_dedup, op6_html_text, op7_license_scan,
        op8_quality_rules, op9_language_id, op10_mix_sources, op11_collocations, op12_disclosure, op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op7_license_scan": OP7_SQL, "op10_mix_sources": OP10_SQL, "op11_collocations": OP11_SQL}
