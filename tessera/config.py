"""Settings of the panel, the backtest, the detectors and the news alignment."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelConfig:
    start: str = "1998-01-01"
    months: int = 24
    #: Fixed order; index 0 is the total of the others.
    categories: tuple[str, ...] = ("ALL", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@dataclass(frozen=True)
class GridConfig:
    first_origin: int = 5
    last_origin: int = 22
    max_h: int = 12
    horizons: tuple[int, ...] = (1, 3, 6, 12)
    val: tuple[int, int] = (12, 17)
    test: tuple[int, int] = (18, 23)
    groups: tuple[tuple[int, ...], ...] = ((1, 2), (3, 4, 5), (6, 7, 8, 9, 10, 11, 12))


@dataclass(frozen=True)
class NationalConfig:
    years: int = 3
    damping: float = 0.5
    lag: int = 1


@dataclass(frozen=True)
class DetectConfig:
    calib_end: int = 11
    monitor: tuple[int, int] = (12, 23)
    onset: tuple[int, int] = (13, 21)
    artifact: int = 3
    cusum_k: float = 0.5
    cusum_window: int = 3
    ewma: float = 0.4
    page_hinkley: float = 0.25
    glr_window: int = 8
    hazard: float = 0.02
    kappa0: float = 0.05
    recent: int = 1
    w_self: float = 0.5
    tolerance: int = 2


@dataclass(frozen=True)
class NewsConfig:
    half_life: float = 1.0
    max_lag: int = 3
    publication_lag_days: int = 0
    region_weight: float = 0.3
    hazard_types: tuple[str, ...] = ("emergency", "utility")
    beta: float = 4.0
    cap: float = 2.0


@dataclass(frozen=True)
class Settings:
    panel: PanelConfig = field(default_factory=PanelConfig)
    grid: GridConfig = field(default_factory=GridConfig)
    national: NationalConfig = field(default_factory=NationalConfig)
    detect: DetectConfig = field(default_factory=DetectConfig)
    news: NewsConfig = field(default_factory=NewsConfig)


DEFAULT = Settings()
