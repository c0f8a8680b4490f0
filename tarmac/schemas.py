"""Configuration objects, fixed values and stage schemas.

Aggregate column names are generated from ``SPECS x WINDOWS`` rather than
searched for by pattern in a schema.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class AggSpec:
    """One rolling-feature family: a name and its grouping keys."""

    name: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class SplitConfig:
    """Time split: train d<=train_end < val d<=val_end < test d<=test_end."""

    train_end: dt.date
    val_end: dt.date
    test_end: dt.date

    def __post_init__(self):
        if not (self.train_end < self.val_end < self.test_end):
            raise ValueError("split dates must satisfy train_end < val_end < test_end")


@dataclass(frozen=True)
class ScopeConfig:
    """Inclusive date range plus optional membership lists (None = no restriction)."""

    start: dt.date | None = None
    end: dt.date | None = None
    carriers: tuple[str, ...] | None = None
    origins: tuple[str, ...] | None = None
    dests: tuple[str, ...] | None = None


# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------

# Rolling-feature families, in the reference's order.
SPECS: tuple[AggSpec, ...] = (
    AggSpec("origin", ("ORIGIN",)),
    AggSpec("dest", ("DEST",)),
    AggSpec("carrier", ("OP_CARRIER",)),
    AggSpec("route", ("route",)),
    AggSpec("carrier_origin", ("OP_CARRIER", "ORIGIN")),
    AggSpec("origin_dep_hour", ("ORIGIN", "CRS_DEP_HOUR")),
)
WINDOWS: tuple[int, ...] = (30, 90, 365)
ALPHA = 50.0                      # smoothing strength
DEFAULT_STORE_RATE = 0.25         # store global rate when no rate column exists
MISSING_KEY = "__MISSING__"       # string key fill
MISSING_HOUR = -1                 # departure hour fill
DELAY_THRESHOLD_MIN = 15.0        # delayed_15 label threshold (minutes)
RISK_LOW_BELOW = 0.20             # risk bucket bounds
RISK_MEDIUM_BELOW = 0.40
SAMPLE_SEED = 42
SAMPLE_CAPS = {"train": 2_000_000, "val": 500_000, "test": 500_000}
BACKGROUND_ROWS = 5_000
TOP_K = 8
APP_TOP_K = 6
MAX_REASONS = 4
MAX_BULLETS = 6
EVIDENCE_VERSION = "v1"
EVIDENCE_TASK = "Explain flight arrival-delay risk prediction (>=15 minutes)."

# Default scope of the reference pipeline.
DEFAULT_SCOPE = ScopeConfig(
    start=dt.date(2024, 1, 1),
    end=dt.date(2025, 11, 30),
    carriers=("DL", "AA", "UA", "WN"),
    origins=("ATL", "ORD", "DFW", "DEN", "LAX", "JFK", "CLT", "LAS", "PHX", "MCO"),
    dests=("ATL", "ORD", "DFW", "DEN", "LAX", "JFK", "CLT", "LAS", "PHX", "MCO"),
)

# Missing-value tokens a pandas CSV read turns into missing (Spark keeps them as text).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Reason-code sentences, in the order they are tested.
REASON_EVENING = "Evening departures tend to accumulate delays from earlier flights."
REASON_EARLY = "Early flights can still be impacted by morning congestion at busy airports."
REASON_WEEKEND = "Weekend travel often has different congestion patterns."
REASON_LONG = "Longer routes have more opportunities for upstream disruption."
REASON_ROUTE = "Route-specific congestion patterns can affect delay risk."

# Human labels for base features and rolling-feature families.
BASE_FEATURE_LABELS = {
    "YEAR": "Year",
    "MONTH": "Month",
    "DAY_OF_WEEK": "Day of week (1=Mon…7=Sun)",
    "is_weekend": "Weekend flag",
    "week_of_year": "Week of year",
    "day_of_month": "Day of month",
    "OP_CARRIER": "Carrier",
    "ORIGIN": "Origin airport",
    "DEST": "Destination airport",
    "route": "Route",
    "dep_daypart": "Time of day (bucket)",
    "DISTANCE": "Distance (miles)",
    "CRS_DEP_HOUR": "Scheduled departure hour",
    "CRS_DEP_MINUTES": "Scheduled departure minutes (from midnight)",
    "CRS_ARR_HOUR": "Scheduled arrival hour",
    "CRS_ARR_MINUTES": "Scheduled arrival minutes (from midnight)",
}
SPEC_LABELS = {
    "origin": "Origin airport",
    "dest": "Destination airport",
    "carrier": "Carrier",
    "route": "Route",
    "carrier_origin": "Carrier × Origin",
    "origin_dep_hour": "Origin × Departure hour",
}
FEATURE_NAME_PATTERN = r"^([a-z_]+)_(delay_rate|freq)_(\d+)d$"

# Raw CSV columns: name -> (required, type after coercion).
RAW_COLUMNS: dict[str, tuple[bool, T.DataType]] = {
    "YEAR": (True, T.ShortType()),
    "MONTH": (True, T.ByteType()),
    "DAY_OF_MONTH": (True, T.ByteType()),
    "DAY_OF_WEEK": (True, T.ByteType()),
    "OP_CARRIER": (True, T.StringType()),
    "ORIGIN": (True, T.StringType()),
    "DEST": (True, T.StringType()),
    "CRS_DEP_TIME": (True, T.IntegerType()),
    "CRS_ARR_TIME": (True, T.IntegerType()),
    "ARR_DELAY": (True, T.DoubleType()),
    "DISTANCE": (True, T.DoubleType()),
    "FL_DATE": (False, T.DateType()),
    "OP_CARRIER_FL_NUM": (False, T.StringType()),
    "CANCELLED": (False, T.ByteType()),
    "DIVERTED": (False, T.ByteType()),
}
COLUMN_ALIASES = {"OP_UNIQUE_CARRIER": "OP_CARRIER", "Origin": "ORIGIN", "Dest": "DEST"}

# Base-feature selection (P18), in output order.
BASE_FEATURE_COLUMNS = (
    "YEAR", "MONTH",
    "DAY_OF_WEEK", "is_weekend", "week_of_year", "day_of_month",
    "OP_CARRIER", "ORIGIN", "DEST", "route", "dep_daypart",
    "DISTANCE",
    "CRS_DEP_MINUTES", "CRS_ARR_MINUTES", "CRS_DEP_HOUR", "CRS_ARR_HOUR",
)
CATEGORICAL_FEATURES = ("OP_CARRIER", "ORIGIN", "DEST", "route", "dep_daypart")
STORE_KEYS = ("flight_date", "ORIGIN", "DEST", "OP_CARRIER", "route", "CRS_DEP_HOUR")
LABEL = "delayed_15"


def freq_col(spec: str, w: int) -> str:
    return f"{spec}_freq_{w}d"


def rate_col(spec: str, w: int) -> str:
    return f"{spec}_delay_rate_{w}d"


def spec_columns(spec: AggSpec, windows=WINDOWS) -> list[str]:
    """A spec's feature columns in table order: per window, freq then rate."""
    out = []
    for w in windows:
        out += [freq_col(spec.name, w), rate_col(spec.name, w)]
    return out


def aggregate_columns(specs=SPECS, windows=WINDOWS) -> list[str]:
    out = []
    for s in specs:
        out += spec_columns(s, windows)
    return out


def model_feature_columns(specs=SPECS, windows=WINDOWS) -> list[str]:
    """Model inputs: base features without YEAR/MONTH (D3) + the aggregates."""
    base = [c for c in BASE_FEATURE_COLUMNS if c not in ("YEAR", "MONTH")]
    return base + aggregate_columns(specs, windows)


@dataclass(frozen=True)
class PipelineConfig:
    """Every knob of the offline pipeline in one place."""

    splits: SplitConfig
    scope: ScopeConfig = field(default_factory=lambda: DEFAULT_SCOPE)
    specs: tuple[AggSpec, ...] = SPECS
    windows: tuple[int, ...] = WINDOWS
    alpha: float = ALPHA
    global_rate_scope: str = "all"   # "all" (parity) or "train" (leak-free), D11
    drop_cancelled_diverted: bool = True
