"""The queries of this folder's operators, and their SQL where SQL can express them (it can't for any: models, hashes, packings)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import op1_simhash_decontamination
from .html import op10_min_cut_html
from .langid import op6_viterbi_language_id
from .licenses import op5_license_classifier
from .neardup import op7_lsh_forest_near_dedup
from .packing import op4_best_fit_packing
from .pii import op2_disclosure_pii
from .quality import op9_likelihood_ratio_quality
from .secrets import op8_ownership_secrets
from .sharding import op3_histogram_sort_shards


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = [
        op1_simhash_decontamination,
        op2_disclosure_pii,
        op3_histogram_sort_shards,
        op4_best_fit_packing,
        op5_license_classifier,
        op6_viterbi_language_id,
        op7_lsh_forest_near_dedup,
        op8_ownership_secrets,
        op9_likelihood_ratio_quality,
        op10_min_cut_html,
    ]
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {}
