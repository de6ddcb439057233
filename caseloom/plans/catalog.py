"""All queries of the core library, gathered from the plan modules.

Results that SQL is compared with are rounded on both sides: two engines add floating
numbers in different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.plans import annotations, extras, metrics, models, packed, pages, partitions, relations, requests, texts

MODULES = (metrics, texts, relations, models, annotations, pages, partitions, requests, extras, packed)
FLAGSHIP = "a1_method_metrics"
DIGITS = 9

#: The floating columns of the queries' SQL.
FLOATS = {
    "a1_method_metrics": "example_jaccard exact_set_accuracy micro_f1 macro_f1",
    "a2_per_label": "precision recall f1",
    "a3_contained": "cpmr mean_contained_recall",
    "a5_scoped_metrics": "example_jaccard exact_set_accuracy micro_f1 macro_f1",
    "a6_threshold_sensitivity": "macro_f1_delta micro_f1_delta exact_set_accuracy_delta example_jaccard_delta",
    "a7_family_macro": "macro_precision macro_recall macro_f1",
    "a8_breadth": "mean_labels median_labels p25_labels p75_labels zero_share",
    "a9_rare_label": "macro_f1_all macro_f1_without change",
    "a10_family_diagnostics": "cpmr mean_contained_recall cpmr_nonempty_reference empty_reference_correct_empty_rate",
    "a11_abstention": "empty_rate mean_labels median_labels",
    "a12_reference_comparison": "mean_jaccard micro_precision micro_recall micro_f1",
    "a13_answerable_comparison": "micro_f1",
    "a14_auxiliary_concordance": "concordance",
    "a15_binary_metrics": "precision recall accuracy f1",
    "a16_agreement": "kappa positive_agreement",
    "a17_gold_metrics": "macro_f1 micro_f1",
    "f35_case_errors": "jaccard",
    "j8_method_deltas": "m3 m4 delta",
    "j9_evaluation_shift": "macro_f1_shift micro_f1_shift example_jaccard_shift",
    "f28_retry_waits": "wait_s",
    "a19_download_diagnostics": "mean p01 p05 p25 p50 p75 p95 p99 lo hi",
    "a20_http_events": "min_s max_s mean_s",
    "a24_usage": "median_value p90_value",
    "a25_usage_rollup": "median_value",
    "a26_token_audit": "p50 p90 p99 within_32 within_64 within_128 within_256 within_512 within_1024 within_2048",
    "a30_availability": "mean_jaccard",
    "a28_average_precision": "average_precision",
    "lineitem_pricing": "avg_price",
    "m01_vocabulary": "idf",
    "m01_weights": "top_weight",
    "m09_bootstrap": "ci_lower ci_upper",
    "m10_paired_bootstrap": "ci_lower ci_upper",
    "w07_best_threshold": "threshold f1",
    "w08_best_configuration": "macro_f1",
    "w11_set_scores": "rarity",
    "l04_retry_states": "total_wait",
    "m06_batch_scores": "mean_score",
}


def rounded(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its floating columns rounded; adding 0 makes a negative zero positive."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = f(spark, sf_dir)
        return got.withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c, t in got.dtypes if t in ("double", "float")})

    return run


def rounded_sql(name: str, sql: str) -> str:
    if name not in FLOATS:
        return sql
    cols = ", ".join(f'round(CAST("{c}" AS DOUBLE), {DIGITS}) + 0.0 AS "{c}"' for c in FLOATS[name].split())
    return f"SELECT * REPLACE ({cols}) FROM ({sql})"


ORACLE = {name: rounded_sql(name, sql) for m in MODULES for name, sql in m.ORACLE.items()}
QUERIES = {name: rounded(f) if name in ORACLE else f for m in MODULES for name, f in m.QUERIES.items()}
