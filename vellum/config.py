"""Rules: defaults, and overlays section by section."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

# The defaults of every rule that something reads.
RULES: dict[str, dict[str, Any]] = {
    "typo_check": {"max_typos_total_warning": 10, "critical_keywords": ["TensorFlow", "Pydantic"]},
    "terminology_check": {
        "terms": {"深度学习": ["Deep Learning"], "卷积神经网络": ["CNN"], "数据挖掘": ["Data Mining"], "人工智能": ["AI", "Artificial Intelligence"], "置信度": ["confidence"]},
        "forbidden_variants": {"CNN": ["C.N.N."]},
        "warn_on_mixed_allowed_forms": False,
    },
    "punctuation_check": {"allow_mixed_punctuation": False, "check_citation_position": True, "allow_proof_dot": True, "allow_keywords_colon": True, "skip_math_like": True},
    "citation_check": {"style": "IEEE", "check_reference_matching": True, "allow_mixed_styles": False, "enforce_style": True, "style_inconsistent_severity": "Warning", "style_mismatch_severity": "Warning", "reference_detect_tail_ratio": 0.25},
    "heading_check": {"max_depth": 4, "continuity_check": True, "continuity_severity": "Info", "column_threshold": 200.0},
    "figure_table_check": {"caption_requirement": "bottom", "table_caption_requirement": "top", "min_figure_area_ratio": 0.03},
    "formula_check": {"numbering": "right", "require_numbering": True, "check_reference": True, "missing_severity": "Info", "unreferenced_ratio_threshold": 0.2, "min_unreferenced_count": 3},
    "score_weights": {"critical": 5.0, "warning": 2.0, "info": 0.3},
    "llm_scan": {"enabled": True},
    "rag_eval": {"enabled": True, "top_k": 5},
}


def overlay(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """A section of ``over`` replaces the whole section of ``base``."""
    return base | over


def load_rules(text: str | None) -> dict[str, Any]:
    """Rules from YAML or JSON text over the defaults; text that can't be read changes nothing."""
    import yaml

    try:
        given = yaml.safe_load(text or "") or {}
    except yaml.YAMLError:
        given = {}
    return overlay(RULES, given) if isinstance(given, dict) else RULES


#: Rules of a stored table that are read at once; they are configuration.
STORED = 10_000


def stored_rules(rows: DataFrame, base: dict[str, Any] | None = None) -> dict[str, Any]:
    """Rules of a stored table (rule_id, content: YAML or JSON) over ``base``: a stored section replaces the whole of it.

    Sections whose content can't be read, or isn't a section where ``base`` has one, change nothing.
    """
    import yaml

    base = RULES if base is None else base
    found = rows.select("rule_id", "content").where("rule_id is not null and content is not null").limit(STORED + 1).collect()
    if len(found) > STORED:
        raise ValueError(f"more than {STORED} stored rules")
    over = {}
    for rule_id, content in sorted(map(tuple, found)):
        try:
            section = yaml.safe_load(content)
        except yaml.YAMLError:
            continue
        if section is not None and isinstance(section, dict) >= isinstance(base.get(rule_id), dict):
            over[rule_id] = section
    return overlay(base, over)
