"""Run parameters. Values that results depend on are stated here once."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Metres per US survey foot, earth radius and degree lengths.
US_SURVEY_FT_M = 1200.0 / 3937.0
EARTH_RADIUS_M = 6_371_000.0
DEG_M = 111_320.0
DEG_LAT_M = 110_540.0

# Severity scale and the groups built on it.
SEVERITY_MIN, SEVERITY_MAX = 1, 5
KSI = (1, 2)
INJURY = (3, 4)
PDO = 5

# Shortlist sizes, rank tiers and matching strata.
CATCH_KS = (50, 100, 200, 500, 800, 1000)
RECALL_KS = (50, 100, 200, 500, 1000)
STRATA = ((1, 100), (101, 300), (301, 800), (801, 10_000))

# Comprehensive cost per event (US dollars) and fallback fatal share.
FATAL_COST = 15_988_000.0
SEVERE_COST = 1_705_100.0
FATAL_SHARE_FALLBACK = 0.243


@dataclass(frozen=True)
class Windows:
    """Feature window, wall and label window. ``cutoff`` is the first day no
    feature may read."""

    feature_start: date
    feature_end: date
    cutoff: date
    label_start: date
    label_end: date
    burn_in_start: date

    def __post_init__(self) -> None:
        if self.feature_end >= self.cutoff:
            raise ValueError("feature window reaches the cutoff")
        if self.label_start < self.cutoff:
            raise ValueError("label window starts before the cutoff")


@dataclass(frozen=True)
class Params:
    windows: Windows
    buffer_m: float = 76.2
    merge_m: float = 10.0
    screen_min: int = 5
    legacy_max_ksi: int = 2
    legacy_top_share: float = 0.10
    tile_m: float = 2000.0
    folds: int = 5
    seed: int = 42
    tweedie_power: float = 1.3
    sweep_radii_m: tuple[float, ...] = (30.0, 50.0, 76.2, 100.0)
    recall_at: tuple[int, ...] = (25, 50, 100)
    ewma_alpha: float = 0.4
    pandemic_start: date = field(default=date(2020, 3, 1))


# The windows used with the bundled tables, whose orders run 1995-01 to 2001-08.
TABLE_WINDOWS = Windows(
    feature_start=date(1995, 1, 1), feature_end=date(1999, 12, 31), cutoff=date(2000, 1, 1),
    label_start=date(2000, 1, 1), label_end=date(2001, 8, 1), burn_in_start=date(1995, 1, 1),
)
TABLE_PARAMS = Params(windows=TABLE_WINDOWS, pandemic_start=date(1998, 3, 1))
