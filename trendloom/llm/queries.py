"""The queries of the corpus operators, by name, and SQL for those that SQL can express."""

from . import centroids, collocations, decontaminate, language, licenses, lm, mixing, neardup, neighbours, quality, secrets, tokens, urls

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality": quality.op5_quality,
    "op6_url_filters": urls.op6_url_filters,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_language_id": language.op8_language_id,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_nearest": neighbours.op10_nearest,
    "op11_centroids": centroids.op11_centroids,
    "op12_lm_scores": lm.op12_lm_scores,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE_SQL = {"op2_mix_sources": mixing.SQL, "op6_url_filters": urls.SQL, "op11_centroids": centroids.SQL, "op13_collocations": collocations.SQL}
