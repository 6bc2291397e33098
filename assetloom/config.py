"""Thresholds, presets and schemas of item curation."""

from __future__ import annotations

from dataclasses import dataclass, field


def _presets() -> dict[str, tuple[float, float, float, float]]:
    # Weights of sharpness, exposure, aesthetics, face for each scene.
    return {"portrait": (0.25, 0.20, 0.25, 0.30), "landscape": (0.35, 0.30, 0.35, 0.00), "other": (0.30, 0.20, 0.30, 0.20)}


def _ranges() -> dict[str, tuple[float, float]]:
    # Raw ranges of published image-quality scorers.
    return {"musiq": (0.0, 100.0), "musiq-ava": (1.0, 10.0), "musiq-koniq": (0.0, 100.0), "dbcnn": (0.0, 1.0), "brisque": (0.0, 100.0), "clipiqa": (0.0, 1.0), "niqe": (0.0, 100.0)}


#: File name endings of photos, and of raw files that are read on demand.
PHOTO = ("jpeg", "jpg", "png")
RAW = ("arw", "cr2", "cr3", "dng", "nef", "orf", "pef", "raf", "rw2", "sr2")


@dataclass(frozen=True)
class Config:
    """Run parameters; every operator takes them as arguments. The defaults."""

    blur_waste: float = 60.0
    exposure_waste: float = 0.5
    ear_closed: float = 0.20
    eye_prob_closed: float = 0.60
    ear_low: float = 0.10
    ear_open: float = 0.32
    gate_low: float = 0.15
    gate_high: float = 0.33
    burst_gap_ms: float = 1500.0
    hash_threshold: int = 12
    strict_duplicate: int = 4
    score_gap: float = 3.0
    confidence_low: float = 0.6
    dimension_gap: float = 0.05
    max_candidates: int = 5
    keep_star: int = 4
    dup_in_uncertain: bool = True
    forced_scene: str | None = None
    weights: tuple[float, float, float, float] | None = None
    presets: dict = field(default_factory=_presets)
    ranges: dict = field(default_factory=_ranges)
    lower_is_better: tuple[str, ...] = ("brisque", "niqe", "ilniqe")


#: Columns of a snapshot of items, in order; writes keep to them.
ITEM_SCHEMA = "path string, fname string, ts timestamp, mtime timestamp, width int, height int, scene string, scene_conf double, scene_manual string, blur_score double, over_ratio double, under_ratio double, aesthetic double, quality double, eye_open double, eye_close_prob double, is_face boolean, fp bigint, group_id bigint, comp_score double, is_waste boolean, is_best boolean, is_uncertain boolean, is_candidate boolean, is_similar_loser boolean, candidate_rank int, star int, label string, waste_reasons string"
ITEM_COLUMNS = tuple(x.split()[0] for x in ITEM_SCHEMA.split(", "))
