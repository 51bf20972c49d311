"""The numbered queries of this subpackage and the pipeline, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from . import decontamination, exact_dedup, language, licenses, packing, pii, quality, ranked_search, resampling, simhash, suffix_dedup, toxicity, url_filter


def queries() -> dict[str, Callable]:
    return {
        "op1_pii_surrogates": pii.op1_pii_surrogates,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_language_id": language.op4_language_id,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_quality_classifier": quality.op6_quality_classifier,
        "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
        "op13_ranked_search": ranked_search.op13_ranked_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.OP5_SQL, "op9_url_filter": url_filter.OP9_SQL, "op13_ranked_search": ranked_search.OP13_SQL}
