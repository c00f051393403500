"""Every threshold of the pipeline, in one place."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    min_total_freq: int = 9
    c_value_min: float = 0.0
    ngrams: tuple[int, int] = (2, 3)
    max_tokens: int = 5
    k_year: int = 5
    m: int = 2
    min_groups: int = 2
    last_complete_year: int = 2000
    complete_through: int = 2000
    graph_window: int = 3
    cap: int = 25
    binarize_papers: int = 3
    binarize_lift: float = 2.0
    max_region_share: float = 0.20
    lineage_jaccard: float = 0.30
    profile_papers: int = 20
    profile_top: int = 10
    profile_min_count: int = 3
    attach_overlap: int = 3
    attach_p: float = 1e-3
    merge_gap_years: float = 3.0
    acronym_len: int = 3
    acronym_dominance: float = 0.70
    acronym_min: int = 3
    bootstrap: int = 2000
    power_floor: int = 50
    judge_min_n: int = 30
    judge_flag: float = 0.05

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


def load_config(path: str) -> Config:
    """A YAML file of any of the fields; needs PyYAML."""
    import yaml

    return Config(**(yaml.safe_load(Path(path).read_text()) or {}))
