"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from . import (
    decontamination,
    divergence_audit,
    exact_dedup,
    html_extraction,
    jaccard_join,
    merkle_audit,
    merkle_manifest,
    mixing,
    quality,
    quotation,
    sharding,
    toxicity,
    url_reputation,
)

_MODULES = (decontamination, exact_dedup, html_extraction, jaccard_join, mixing, toxicity, quotation, sharding, merkle_audit, quality, merkle_manifest, divergence_audit, url_reputation)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
