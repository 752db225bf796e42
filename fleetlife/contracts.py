"""Column names and fixed values shared by all jobs."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

# Column names, window widths, horizons, thresholds and bin edges that decide results.
UNIT = "serial_number"
DAY = "date"
CATEGORY = "model"
SMART_BIG5 = ["smart_5_raw", "smart_187_raw", "smart_188_raw", "smart_197_raw", "smart_198_raw"]
BASE_FEATURES = ["model", "capacity_gb", "drive_age_days"]
STRING_COLUMNS = [
    "serial_number",
    "model",
    "datacenter",
    "cluster_id",
    "vault_id",
    "pod_id",
    "pod_slot_num",
    "is_legacy_format",
]
WINDOWS = [7, 14, 30]
HORIZONS = [7, 15, 30]
SEQUENCE_LENGTH = 30
RUL_CAP = 400.0
PSI_THRESHOLD = 0.1
PSI_BINS = 10
PSI_FLOOR = 1e-6
MIN_DRIFT_ROWS = 50
DRIFT_SHARE_THRESHOLD = 0.5
PR_AUC_DROP_THRESHOLD = 0.05
FPR_BUDGETS = {"fpr_1pct": 0.01, "fpr_0_1pct": 0.001}
FBETA = 2.0
WATCH_RUL_DAYS = 60
SHORT_RUL_DAYS = 90
RISK_BIN_EDGES = [0.0, 0.05, 0.1, 0.25, 0.5, 1.0]
RISK_BIN_NAMES = ["0-5%", "5-10%", "10-25%", "25-50%", "50-100%"]

DRIFT_NUMERIC = ["capacity_gb", *SMART_BIG5]
DRIFT_CATEGORICAL = ["model"]


def rolling_columns(columns: list[str] | None = None, windows: list[int] | None = None) -> list[str]:
    """Names of the rolling features: all means, then all deviations, then the distances."""
    columns = columns or SMART_BIG5
    windows = windows or WINDOWS
    means, stds = (
        [f"{c}_{kind}_{w}" for c in columns for w in windows] for kind in ("rmean", "rstd")
    )
    return [*means, *stds, *(f"{c}_dev{max(windows)}" for c in columns)]


def feature_columns() -> list[str]:
    """The ordered 43 model inputs."""
    return [*BASE_FEATURES, *SMART_BIG5, *rolling_columns()]


def quarter_range(name: str) -> tuple[date, date]:
    """First and last day of a calendar quarter written like ``2024-Q4``."""
    year, quarter = int(name[:4]), int(name[-1])
    if name[4:6] != "-Q" or quarter not in (1, 2, 3, 4):
        raise ValueError(f"not a quarter: {name}")
    start = date(year, 3 * quarter - 2, 1)
    following = date(year + quarter // 4, 3 * quarter % 12 + 1, 1)
    return start, following - timedelta(days=1)


def quarter_name(day: date) -> str:
    """The quarter of a day, written like ``2024-Q4``."""
    return f"{day.year:04d}-Q{(day.month + 2) // 3}"


@dataclass(frozen=True)
class Span:
    """An inclusive range of days."""

    first: date
    last: date

    @classmethod
    def of_quarters(cls, names: list[str]) -> Span:
        """From the earliest start to the latest end; gaps between the quarters are included."""
        ranges = [quarter_range(n) for n in names]
        return cls(min(r[0] for r in ranges), max(r[1] for r in ranges))

    def with_lookback(self, days: int) -> Span:
        return Span(self.first - timedelta(days=days), self.last)


@dataclass(frozen=True)
class Settings:
    """Job settings; the defaults are the published configuration."""

    splits: dict[str, Span] = field(
        default_factory=lambda: {
            "train": Span.of_quarters(["2024-Q4", "2025-Q1"]),
            "val": Span.of_quarters(["2025-Q2"]),
            "test": Span.of_quarters(["2025-Q3"]),
        }
    )
    horizon: int = 30
    horizons: tuple[int, ...] = tuple(HORIZONS)
    negatives_per_positive: float = 50.0
    survival_ratios: dict[str, float] = field(
        default_factory=lambda: {"train": 50.0, "val": 20.0, "test": 20.0}
    )
    min_drives: int = 1000
    fbeta: float = FBETA
    drift_share: float = DRIFT_SHARE_THRESHOLD
    pr_auc_drop: float = PR_AUC_DROP_THRESHOLD

    @classmethod
    def from_dict(cls, raw: dict) -> Settings:
        """Read the nested form: data / labels / split / evaluation / mlops sections."""
        split = raw["split"]
        if split.get("strategy", "time") != "time":
            raise ValueError("only splits by time are supported")
        ratio = float(raw["data"].get("healthy_downsample_ratio", 50))
        return cls(
            splits={
                name: Span.of_quarters(split[f"{name}_quarters"]) for name in ("train", "val", "test")
            },
            horizon=int(raw["labels"].get("primary_horizon_days", cls.horizon)),
            horizons=tuple(raw["labels"]["horizons_days"]),
            negatives_per_positive=ratio,
            survival_ratios={"train": ratio, "val": 20.0, "test": 20.0},
            fbeta=float(raw.get("evaluation", {}).get("fbeta_beta", FBETA)),
            pr_auc_drop=float(
                raw.get("mlops", {}).get("drift_pr_auc_drop_threshold", PR_AUC_DROP_THRESHOLD)
            ),
        )
