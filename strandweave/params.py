"""All parameters of seeding, chaining, refinement and selection, with their ranges."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """The defaults are those that published results use."""

    k: int = 15
    w: int = 10
    shard_bits: int = 12
    freq_cap: int = 1000
    max_gap: int = 5000
    max_drift: int = 200
    top_k: int = 10
    window_ext: int = 7
    max_ext: int = 40
    match_window: int = 10
    min_match_rate: float = 0.7
    secondary: int = 0
    overlap_tolerance: int = 20
    min_ref_span: int = 40
    min_anchors: int = 3
    min_score_ratio: float = 0.28
    refine: bool = False
    clamp: bool = False

    def __post_init__(self) -> None:
        for name, lo, hi in (("k", 1, 28), ("w", 1, 255), ("shard_bits", 1, 30), ("freq_cap", 1, None), ("max_gap", 1, None), ("max_drift", 0, None), ("top_k", 1, None), ("window_ext", 0, None), ("max_ext", 0, None), ("match_window", 1, None), ("secondary", 0, None), ("min_anchors", 1, None)):
            v = getattr(self, name)
            if v < lo or (hi is not None and v > hi):
                raise ValueError(f"{name} must be in [{lo}, {hi}], not {v}")

    @property
    def mask(self) -> int:
        return (1 << 2 * self.k) - 1
