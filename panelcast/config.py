"""Settings of a panel run: time splits and quality limits. All times are wall-clock, as timestamp_ntz."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Splits:
    """Half-open, out-of-time windows: [start, train_end), [train_end, validation_end), [validation_end, end)."""

    start: datetime
    train_end: datetime
    validation_end: datetime
    end: datetime

    def bounds(self, name: str) -> tuple[datetime, datetime]:
        return {"train": (self.start, self.train_end), "validation": (self.train_end, self.validation_end), "test": (self.validation_end, self.end), "all": (self.start, self.end)}[name]


@dataclass(frozen=True)
class Limits:
    """Bounds of valid events; a value at a closed bound is valid."""

    min_minutes: float = 1.0
    max_minutes: float = 240.0
    max_distance: float = 100.0
    max_fare: float = 1000.0
    max_zone: int = 263
    unknown_zones: tuple[int, ...] = (264, 265)
    min_daily: float = 1.0


#: Hours back, and hours averaged, of the history columns; the quantiles of a band.
LAGS = {"lag_1h": 1, "lag_2h": 2, "lag_24h": 24, "lag_168h": 168}
ROLLING = {"roll_mean_24h": 24, "roll_mean_168h": 168}
QUANTILES = (0.1, 0.5, 0.9)


@dataclass(frozen=True)
class Bands:
    """Limits of the reports."""

    on_target: float = 0.15
    error_floor: float = 5.0
    rank_edges: tuple[int, ...] = field(default=(20, 60, 120))
