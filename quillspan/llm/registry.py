"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import clusters, decontaminate, fingerprints, line_dedup, mixing, pii, secrets, simhash, spelling, suffix_dedup, token_counts, topk, toxicity


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_source_mix": mixing.op7_source_mix,
        "op2_substring_dedup": suffix_dedup.op2_substring_dedup,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_simhash_components": simhash.op4_simhash_components,
        "op5_token_counts": token_counts.op5_token_counts,
        "op10_pii": pii.op10_pii,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_document_fingerprints": fingerprints.op9_document_fingerprints,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_centroid_clusters": clusters.op12_centroid_clusters,
        "op13_exact_top_products": topk.op13_exact_top_products,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontaminate.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op12_centroid_clusters": clusters.ORACLE, "op13_exact_top_products": topk.ORACLE}
