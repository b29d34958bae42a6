"""Queries of this subpackage, one per operator, and the pipeline."""

from __future__ import annotations

from . import (
    op01_minhash_forest,
    op02_quality_rules,
    op03_sharding,
    op04_url_filters,
    op05_decontamination,
    op06_packing,
    op07_token_files,
    op08_quality_classifier,
    op09_language_id,
    op10_html_extraction,
)

MODULES = (
    op01_minhash_forest,
    op02_quality_rules,
    op03_sharding,
    op04_url_filters,
    op05_decontamination,
    op06_packing,
    op07_token_files,
    op08_quality_classifier,
    op09_language_id,
    op10_html_extraction,
)


def queries() -> dict:
    import corpus_pipeline

    return {m.NAME: m.query for m in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {m.NAME: m.ORACLE for m in MODULES if getattr(m, "ORACLE", None)}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
