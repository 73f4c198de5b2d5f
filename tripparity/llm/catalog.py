"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripparity.llm.bytecnn import op7_quality_classifier
from tripparity.llm.chatformat import OP13_SQL, op13_chat_format
from tripparity.llm.hardneg import OP12_SQL, op12_hard_negatives
from tripparity.llm.langid import op9_language_id
from tripparity.llm.mixing import op6_mixing
from tripparity.llm.packing import op8_best_fit_packing
from tripparity.llm.periodic import op11_periodic_runs
from tripparity.llm.pii import op4_personal_data
from tripparity.llm.quality_rules import op5_quality_rules
from tripparity.llm.secrets import op3_secret_scan
from tripparity.llm.simhash import op1_simhash_near_dedup
from tripparity.llm.toxicity import op2_toxicity
from tripparity.llm.topk import OP10_SQL, op10_exact_topk

Query = Callable[[SparkSession, str], DataFrame]


def llm_queries() -> dict[str, Query]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_secret_scan": op3_secret_scan,
        "op4_personal_data": op4_personal_data,
        "op5_quality_rules": op5_quality_rules,
        "op6_mixing": op6_mixing,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_language_id": op9_language_id,
        "op10_exact_topk": op10_exact_topk,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_chat_format": op13_chat_format,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {"op10_exact_topk": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_chat_format": OP13_SQL}
