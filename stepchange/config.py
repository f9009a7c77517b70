"""The settings of one study: columns, dates, groups, cut-offs.

Every operator takes a ``StudyConfig``, so nothing about a city, a vendor or a
date is hard-wired into the operators themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

# Defaults of the ride-hail study ------------------------------
TIME_BANDS = (
    ("overnight", 21, 5),
    ("morning_peak", 5, 10),
    ("midday", 10, 16),
    ("evening", 16, 21),
)
ZONE_GROUPS = ("cbd", "ring_adjacent", "ring_across", "control_near", "control_far")
TRIP_GROUPS = (
    ("cbd", "treated"),
    ("ring_adjacent", "ring_adjacent"),
    ("ring_across", "ring_across"),
    ("control_near", "control_near"),
    ("control_far", "control_far"),
)
COARSE_GROUPS = (
    ("treated", "treated"),
    ("ring_adjacent", "ring"),
    ("ring_across", "ring"),
    ("control_near", "control"),
    ("control_far", "control"),
)
HISTOGRAM_SPECS = (
    ("trip_minutes", 0, 360, 3),
    ("money", -50, 550, 5),
    ("money_per_hour", -100, 400, 5),
)
QUANTILE_SPECS = (
    ("trip_minutes", 0, 360, 0.1),
    ("trip_miles", 0, 100, 0.05),
    ("speed_mph", 0, 100, 0.1),
    ("driver_pay", -50, 500, 0.25),
)
QUANTILE_PROBS = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
WEATHER = ("rain_mm", "snow_mm", "snow_depth_mm", "temp_max_c", "temp_min_c")
# End of fixed values --------------------------------------------------------


# US federal holidays 2023-2025, observed weekdays included -----
US_HOLIDAYS = (
    date(2023, 1, 1),
    date(2023, 1, 2),
    date(2023, 1, 16),
    date(2023, 2, 20),
    date(2023, 5, 29),
    date(2023, 6, 19),
    date(2023, 7, 4),
    date(2023, 9, 4),
    date(2023, 10, 9),
    date(2023, 11, 10),
    date(2023, 11, 11),
    date(2023, 11, 23),
    date(2023, 12, 25),
    date(2024, 1, 1),
    date(2024, 1, 15),
    date(2024, 2, 19),
    date(2024, 5, 27),
    date(2024, 6, 19),
    date(2024, 7, 4),
    date(2024, 9, 2),
    date(2024, 10, 14),
    date(2024, 11, 11),
    date(2024, 11, 28),
    date(2024, 12, 25),
    date(2025, 1, 1),
    date(2025, 1, 20),
    date(2025, 2, 17),
    date(2025, 5, 26),
    date(2025, 6, 19),
    date(2025, 7, 4),
    date(2025, 9, 1),
    date(2025, 10, 13),
    date(2025, 11, 11),
    date(2025, 11, 27),
    date(2025, 12, 25),
)
# End of fixed values --------------------------------------------------------


@dataclass(frozen=True)
class StudyConfig:
    """One study. The defaults describe the 2025 New York toll."""

    service: str = "fhvhv"
    timezone: str = "America/New_York"
    first_month: date = date(2023, 1, 1)
    last_month: date = date(2025, 12, 1)
    intervention: date = date(2025, 1, 5)
    placebo: date = date(2024, 1, 5)

    # Column roles
    vendor: str = "hvfhs_license_num"
    request: str = "request_datetime"
    pickup: str = "pickup_datetime"
    dropoff: str = "dropoff_datetime"
    origin: str = "PULocationID"
    destination: str = "DOLocationID"
    distance: str = "trip_miles"
    fee: str = "cbd_congestion_fee"
    pay: str = "driver_pay"
    shared: str = "shared_match_flag"

    # Zones. The seed and unknown lists are vocabularies of tens of ids
    seed_zones: tuple[int, ...] = ()
    unknown_zones: tuple[int, ...] = (264, 265)
    unknown_group: str = "unknown"
    zone_groups: tuple[str, ...] = ZONE_GROUPS
    trip_groups: tuple[tuple[str, str], ...] = TRIP_GROUPS
    coarse_groups: tuple[tuple[str, str], ...] = COARSE_GROUPS
    ring_distance_ft: float = 3281
    near_distance_ft: float = 6562

    # Outlier cut-offs
    min_trip_minutes: int = 1
    max_trip_minutes: int = 300
    max_speed_mph: float = 60
    max_distance_miles: float = 100
    max_money: float = 500

    bands: tuple[tuple[str, int, int], ...] = TIME_BANDS
    histogram_specs: tuple[tuple, ...] = HISTOGRAM_SPECS
    quantile_specs: tuple[tuple, ...] = QUANTILE_SPECS
    quantile_probs: tuple[float, ...] = QUANTILE_PROBS
    holidays: tuple[date, ...] = US_HOLIDAYS
    weather: tuple[str, ...] = WEATHER
    min_daily_pickups: float = 10
    # percentile_approx accuracy: the rank error is at most rows / accuracy
    accuracy: int = 1000
    # Medians of large groups: exact by distributed selection, or sketched
    exact_medians: bool = False

    @property
    def columns(self) -> dict[str, str]:
        """Kept raw columns and the one type every month is cast to."""
        return {
            self.vendor: "string",
            self.request: "timestamp_ntz",
            self.pickup: "timestamp_ntz",
            self.dropoff: "timestamp_ntz",
            self.origin: "int",
            self.destination: "int",
            self.distance: "double",
            self.fee: "double",
            self.pay: "double",
            self.shared: "string",
        }

    @property
    def periods(self) -> dict[str, tuple[date, date]]:
        """The intervention period and the same dates one year earlier."""
        start = self.intervention
        return {
            "before": (start.replace(year=start.year - 1), date(start.year - 1, 12, 31)),
            "after": (start, date(start.year, 12, 31)),
        }

    @property
    def first_date(self) -> date:
        return self.first_month

    @property
    def last_date(self) -> date:
        """The last day of ``last_month``."""
        return (self.last_month.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(
            days=1
        )

    @property
    def band_names(self) -> list[str]:
        return [name for name, _, _ in self.bands]

    @property
    def trip_group_names(self) -> list[str]:
        return [name for _, name in self.trip_groups]

    @property
    def coarse_names(self) -> list[str]:
        return list(dict.fromkeys(name for _, name in self.coarse_groups))

    @property
    def years(self) -> list[int]:
        return list(range(self.first_month.year, self.last_month.year + 1))

    @property
    def cell(self) -> list[str]:
        """A row of the summary cube, apart from its date."""
        return [self.origin, "dropoff_group", "time_band"]
