"""Settings of an analysis; those without a default have to be given."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    event_types: tuple[str, ...]
    minimum_events: int  # complete pairs below which a correlation is missing
    vicinity: int  # places around an event in which regions count as near; the small window is a tenth
    histone_marks: tuple[str, ...]
    #: Defaults of our own.
    correlation_methods: tuple[str, ...] = ("pearson", "spearman")
    control_class: str = "control"
    case_class: str = "case"
    low: float = 1 / 3
    high: float = 2 / 3
    holdout_share: float = 0.1
    global_folds: int = 10
    event_folds: int = 5
    rotations: int = 10
    alpha: float = 0.05
    seed: int = 1234
    lambda_grid: tuple[float, ...] = field(default_factory=lambda: tuple(10 ** (-4 + 0.15 * k) for k in range(21)))

    @property
    def small_window(self) -> int:
        return self.vicinity // 10
