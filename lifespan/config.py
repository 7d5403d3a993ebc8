"""Component contracts: window shapes, scales, blend weights and training sizes."""

from __future__ import annotations

from dataclasses import dataclass

from lifespan import fixed_values as fv


@dataclass(frozen=True)
class Boosting:
    trees: int
    leaves: int
    bins: int
    min_leaf: int
    rate: float
    l2: float


@dataclass(frozen=True)
class Contract:
    """What one component needs from its input and how its score is finished."""

    name: str
    channels: tuple[str, ...]
    required: tuple[str, ...]
    length: int
    stride: int
    rmax: float
    unit: str
    time_units: tuple[str, ...]
    age_threshold: float
    low_weight: float
    high_weight: float
    boosting: Boosting
    tree_features: str
    margin: float

    @property
    def edge(self) -> int:
        return edge_length(self.length)


def edge_length(length: int) -> int:
    """Number of steps averaged at either end of a window."""
    return max(2, min(8, length // 5))


BATTERY = Contract(
    name="battery",
    channels=fv.BATTERY_CHANNELS,
    required=fv.BATTERY_REQUIRED,
    length=60,
    stride=5,
    rmax=150.0,
    unit="cycles",
    time_units=("cycle",),
    age_threshold=139.0,
    low_weight=0.2,
    high_weight=0.7,
    boosting=Boosting(800, 31, 255, 5, 0.03, 0.005),
    tree_features="statistics",
    margin=fv.MAINTENANCE_MARGIN["battery"],
)
WHEEL = Contract(
    name="wheel",
    channels=fv.WHEEL_CHANNELS,
    required=fv.WHEEL_BASE_CHANNELS,
    length=30,
    stride=1,
    rmax=0.2,
    unit="days",
    time_units=tuple(fv.SECONDS_PER_UNIT),
    age_threshold=fv.WHEEL_AGE_THRESHOLD_S / fv.SECONDS_PER_UNIT["day"],
    low_weight=0.7,
    high_weight=1.0,
    boosting=Boosting(800, 63, 255, 20, 0.03, 0.001),
    tree_features="flat",
    margin=fv.MAINTENANCE_MARGIN["wheel"],
)
CONTRACTS = {c.name: c for c in (BATTERY, WHEEL)}

# Rows one task may hold for one unit before the unit is split across tasks.
SEGMENT_ROWS = 100_000
# Largest table that is shipped to every executor, in rows.
BROADCAST_ROWS = 100_000
