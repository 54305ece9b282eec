"""The training-data queries and their DuckDB twins, by name."""

from __future__ import annotations

from . import centroids, decontaminate, filter_audit, licenses, pieces, secrets, simhash, substrings, telephony, token_counts, toxicity, url_filters, warc

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_telephony": telephony.op2_telephony,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_simhash": simhash.op4_simhash,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_substrings": substrings.op6_substrings,
    "op7_secrets": secrets.op7_secrets,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_warc": warc.op9_warc,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_centroids": centroids.op11_centroids,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_url_filters": url_filters.op13_url_filters,
}

ORACLE = {
    "op1_licenses": licenses.ORACLE_SQL,
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op6_substrings": substrings.ORACLE_SQL,
    "op7_secrets": secrets.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op11_centroids": centroids.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_url_filters": url_filters.ORACLE_SQL,
}
