"""All queries of the subpackage and their SQL."""

from sparktraj.llm import bpe, chosen_path, divergence_audit, filter_audit, language_id, matroska, packing, pii, quality_classifier, quality_rules, secret_scan, token_files, url_filter

_MODULES = (language_id, secret_scan, matroska, token_files, packing, pii, chosen_path, quality_rules, bpe, quality_classifier, url_filter, filter_audit, divergence_audit)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
