"""The queries of this subpackage, by their registered names."""

from __future__ import annotations

from . import byte_bpe, centroids, decontaminate, hard_negatives, html_text, licences, lm_scoring, mixing, ngram_join, perplexity, personal_data, secrets, warc

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_warc_revisits": warc.op2_warc_revisits,
    "op3_personal_data": personal_data.op3_personal_data,
    "op4_quality_rules": perplexity.op4_quality_rules,
    "op5_html_text": html_text.op5_html_text,
    "op6_licence_scan": licences.op6_licence_scan,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_lm_scores": lm_scoring.op8_lm_scores,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_centroid_clusters": centroids.op12_centroid_clusters,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

#: DuckDB SQL, where SQL can express a query on whole tables
ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": ngram_join.ORACLE,
    "op2_warc_revisits": warc.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
    "op12_centroid_clusters": centroids.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
