"""Settings of the analysis, read from TOML or built in; all of them become literals of a plan."""

from __future__ import annotations

import hashlib
import os
import tomllib
from dataclasses import dataclass, field, replace

from wardline.functions.lexicon import WEIGHTS

TIERS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class Config:
    min_chars: int = 15
    truncate_at: int = 5000
    reject_over: int = 8000
    max_control_ratio: float = 0.05
    medium: int = 30
    high: int = 55
    critical: int = 80
    rules_weight: float = 0.6
    llm_weight: float = 0.4
    disagreement: int = 45
    combo_floor: str = "HIGH"
    hybrid_cap: float = 0.95
    rules_cap: float = 0.75
    fallback_cap: float = 0.55
    llm_enabled: bool = True
    llm_policy: str = "always"
    ambiguous_min: int = 10
    ambiguous_max: int = 75
    retention_days: int = 30
    min_ocr_confidence: float = 0.6
    max_image_bytes: int = 8_000_000
    max_image_pixels: int = 40_000_000
    weights: dict[str, int] = field(default_factory=lambda: dict(WEIGHTS))
    config_hash: str = "builtin"

    def __post_init__(self):
        checks = {
            "tiers must rise from 1 to 100": 0 < self.medium < self.high < self.critical <= 100,
            "the blend's weights must sum to 1": abs(self.rules_weight + self.llm_weight - 1) < 1e-9,
            "the combo floor is MEDIUM or HIGH": self.combo_floor in ("MEDIUM", "HIGH"),
            "limits must rise": 0 < self.min_chars < self.truncate_at <= self.reject_over,
            "the policy is always or ambiguous": self.llm_policy in ("always", "ambiguous"),
            "retention is a day at least": self.retention_days >= 1,
            "every rule needs a weight": set(WEIGHTS) <= set(self.weights),
        }
        for says, holds in checks.items():
            if not holds:
                raise ValueError(says)


#: Where a setting stands in the file.
_PLACES = {
    "limits": {k: k for k in ("min_chars", "truncate_at", "reject_over", "max_control_ratio")},
    "tiers": {k: k for k in ("medium", "high", "critical")},
    "scoring": {"rules_weight": "rules_weight", "llm_weight": "llm_weight", "disagreement_threshold": "disagreement", "combo_floor": "combo_floor", "hybrid_confidence_cap": "hybrid_cap", "rules_only_confidence_cap": "rules_cap", "fallback_confidence_cap": "fallback_cap"},
    "llm": {"enabled": "llm_enabled", "policy": "llm_policy", "ambiguous_min": "ambiguous_min", "ambiguous_max": "ambiguous_max"},
    "retention": {"days": "retention_days"},
    "image": {"max_bytes": "max_image_bytes", "max_pixels": "max_image_pixels", "min_ocr_confidence": "min_ocr_confidence"},
}


def load_config(path: str | None = None) -> Config:
    """Config from a TOML file, or from the file that WARDLINE_CONFIG names; its hash is of the file's bytes."""
    path = path or os.environ.get("WARDLINE_CONFIG")
    if not path:
        return Config()
    with open(path, "rb") as f:
        raw = f.read()
    tree = tomllib.loads(raw.decode("utf-8"))
    found = {ours: tree[part][theirs] for part, names in _PLACES.items() for theirs, ours in names.items() if theirs in tree.get(part, {})}
    weights = tree.get("rules", {}).get("weights")
    return replace(Config(), **found, **({"weights": weights} if weights else {}), config_hash=hashlib.sha256(raw).hexdigest()[:16])
