"""Queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from emberline.llm.chat_format import OP3_SQL, op3_chat_format
from emberline.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from emberline.llm.language import op6_language_id
from emberline.llm.licenses import op9_license_scan
from emberline.llm.mixing import op4_pivotal_mixing
from emberline.llm.packing import op5_best_fit_packing
from emberline.llm.repair import op12_dial_repair
from emberline.llm.resharding import op13_flow_resharding
from emberline.llm.simhash import op2_simhash_near_dedup
from emberline.llm.substring_dedup import op10_substring_dedup
from emberline.llm.tiff import op1_tiff_media
from emberline.llm.toxicity import op8_toxicity
from emberline.llm.treap_search import OP11_SQL, op11_treap_search


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tiff_media": op1_tiff_media,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_chat_format": op3_chat_format,
        "op4_pivotal_mixing": op4_pivotal_mixing,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_language_id": op6_language_id,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_license_scan": op9_license_scan,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_treap_search": op11_treap_search,
        "op12_dial_repair": op12_dial_repair,
        "op13_flow_resharding": op13_flow_resharding,
        "pipeline": corpus_pipeline.run,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op11_treap_search": OP11_SQL}
