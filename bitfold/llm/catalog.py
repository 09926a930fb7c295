"""Registered queries of the text preparation operators, and the SQL that checks some of them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from bitfold.llm import exact, language, licenses, mixing, nearcopies, pieces, quality, resampling, secrets, sharding, spelling, suffixes, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language.op1_language_id,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_exact_dedup": exact.op3_exact_dedup,
        "op4_url_filter": urls.op4_url_filter,
        "op5_source_mixing": mixing.op5_source_mixing,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_suffix_dedup": suffixes.op8_suffix_dedup,
        "op9_near_dedup": nearcopies.op9_near_dedup,
        "op10_sentencepiece": pieces.op10_sentencepiece,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_sharding": sharding.op12_sharding,
        "op13_spelling_variants": spelling.op13_spelling_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secrets.op2_sql(),
        "op3_exact_dedup": exact.OP3_SQL,
        "op9_near_dedup": nearcopies.OP9_SQL,
        "op11_importance_resampling": resampling.op11_sql(),
        "op13_spelling_variants": spelling.op13_sql(),
    }
