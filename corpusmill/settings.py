"""Settings of models and segmentation: read with fallbacks, checked, written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.enrich import KEYWORD_STRATEGIES
from corpusmill.operators.segment import SegmentConfig

#: Names and defaults; those that may not be empty fall back to their default.
DEFAULTS = {"api_key": "", "base_url": "http://localhost:8000/v1", "model": "default", "qa_evaluator": "lexical_overlap_v1"}
NOT_EMPTY = ("base_url", "model", "qa_evaluator")


def normalized(data: dict | None) -> dict[str, str]:
    """Known names only, as stripped strings; missing ones get their defaults."""
    found = {name: str((data or {}).get(name, default) or "").strip() for name, default in DEFAULTS.items()}
    return {name: value or (DEFAULTS[name] if name in NOT_EMPTY else "") for name, value in found.items()}


def read_settings(path: str | Path) -> dict[str, str]:
    """The file's settings; the defaults where it is missing, broken or no object."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        data = None
    return normalized(data if isinstance(data, dict) else None)


def write_settings(path: str | Path, settings: dict) -> dict[str, str]:
    """Merged into what is there, written beside it and moved into place."""
    path = Path(path)
    merged = normalized(read_settings(path) | settings)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(merged, f, ensure_ascii=False, indent=2)
        f.write("\n")
    os.replace(beside, path)
    return merged


#: Segmentation strategies and what they do.
STRATEGIES = (
    ("smart", "headings, meaning, protected blocks, overlap"),
    ("heading", "headings and lengths only"),
    ("fixed", "512 characters each"),
)


def strategies(spark: SparkSession) -> DataFrame:
    """name, description of the segmentation strategies, and kind `keywords` rows for the keyword strategies."""
    rows = [("segmentation", *s) for s in STRATEGIES] + [("keywords", name, None) for name in sorted(KEYWORD_STRATEGIES)]
    return spark.createDataFrame(rows, "kind string, name string, description string")


def default_config() -> dict[str, object]:
    c = SegmentConfig()
    return {"min_chars": c.min_chars, "target_chars": c.target_chars, "max_chars": c.max_chars, "overlap": c.overlap, "semantic": c.semantic, "threshold": c.threshold, "keyword_strategy": "tfidf"}


def request_error(suffix: Column, min_chars: Column, target_chars: Column, max_chars: Column, overlap: Column, keyword_strategy: Column, suffixes: tuple[str, ...]) -> Column:
    """What is wrong with an upload request (null: nothing): 400 and the reason."""
    strategy = F.lower(F.trim(F.coalesce(keyword_strategy, F.lit(""))))
    return (
        F.when(~F.coalesce(F.lower(suffix).isin(*suffixes), F.lit(False)), F.concat(F.lit("400: unsupported file type: "), F.coalesce(F.nullif(suffix, F.lit("")), F.lit("none"))))
        .when((F.least(min_chars, target_chars, max_chars) <= 0) | (overlap < 0), F.lit("400: lengths must be positive and overlap not negative"))
        .when(~((min_chars <= target_chars) & (target_chars <= max_chars)), F.lit("400: min_chars <= target_chars <= max_chars does not hold"))
        .when((strategy != "") & ~strategy.isin(*KEYWORD_STRATEGIES), F.lit(f"400: keyword strategies are {', '.join(sorted(KEYWORD_STRATEGIES))}"))
    )


def validated(config: SegmentConfig) -> SegmentConfig:
    """The configuration, or a ValueError that says what is wrong with it."""
    if min(config.min_chars, config.target_chars, config.max_chars) <= 0 or config.overlap < 0:
        raise ValueError("lengths must be positive and overlap not negative")
    if not config.min_chars <= config.target_chars <= config.max_chars:
        raise ValueError("min_chars <= target_chars <= max_chars does not hold")
    return config
