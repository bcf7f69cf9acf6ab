"""Typed, validated parameters for every stage.

``ResearchParams.from_mapping`` accepts the usual nested mapping (data, features,
target, split, walk_forward, tuning, models, evaluation, backtest, project), so a
parsed YAML or JSON document can be passed straight in.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any


class ParamError(ValueError):
    """A parameter is missing or out of range."""


@dataclass(frozen=True)
class DataParams:
    tickers: tuple[str, ...] = ()
    extra_tickers: tuple[str, ...] = ()
    market_ticker: str = "SPY"
    start: str | None = None
    end: str | None = None
    min_rows: int = 300
    source: str = "files"

    def universe(self) -> list[str]:
        """Tickers plus extras, trimmed and upper-cased, first mention wins."""
        names = (str(t).strip().upper() for t in (*self.tickers, *self.extra_tickers))
        return list(dict.fromkeys(names))

    def market(self) -> str:
        return str(self.market_ticker).upper()


@dataclass(frozen=True)
class MarketParams:
    enabled: bool = True
    lag: int = 1
    return_windows: tuple[int, ...] = (1, 5, 20)
    volatility_windows: tuple[int, ...] = (20,)

    def __post_init__(self):
        if self.lag < 0:
            raise ParamError("market_features.lag must be >= 0: a negative lag reads the future")


@dataclass(frozen=True)
class FeatureParams:
    return_windows: tuple[int, ...] = (1, 2, 5, 10, 20, 60)
    volatility_windows: tuple[int, ...] = (5, 10, 20, 60)
    ma_distance_windows: tuple[int, ...] = (5, 20, 50)
    ma_spread: tuple[int, int] = (5, 20)
    volume_ma_window: int = 20
    drawdown_windows: tuple[int, ...] = (20, 60)
    annualise_volatility: bool = True
    market_features: MarketParams = field(default_factory=MarketParams)

    def __post_init__(self):
        if any(w < 1 for w in self.return_windows):
            raise ParamError("return windows must be >= 1")
        if any(w < 2 for w in self.volatility_windows):
            raise ParamError("volatility windows must be >= 2")
        fast, slow = self.ma_spread
        if fast >= slow:
            raise ParamError(f"ma_spread fast ({fast}) must be below slow ({slow})")

    def longest_window(self) -> int:
        """Rows of history one feature row can look back on."""
        market = self.market_features
        return max(
            *self.return_windows, *self.volatility_windows, *self.ma_distance_windows,
            *self.ma_spread, self.volume_ma_window, *self.drawdown_windows,
            *(w + market.lag for w in (*market.return_windows, *market.volatility_windows)),
        )


@dataclass(frozen=True)
class TargetParams:
    horizon: int = 1
    threshold: float = 0.0

    def __post_init__(self):
        if self.horizon < 1:
            raise ParamError("target.horizon must be >= 1")


@dataclass(frozen=True)
class SplitParams:
    train_end: str | None = None
    val_end: str | None = None
    train_frac: float = 0.6
    val_frac: float = 0.2
    purge_days: int | None = None

    def __post_init__(self):
        if self.by_date():
            if not str(self.train_end) < str(self.val_end):
                raise ParamError(
                    f"split.train_end ({self.train_end}) must be before split.val_end ({self.val_end})"
                )
        elif self.train_frac <= 0 or self.val_frac <= 0 or self.train_frac + self.val_frac >= 1:
            raise ParamError(
                f"split.train_frac ({self.train_frac}) and split.val_frac ({self.val_frac}) "
                "must be > 0 and sum to < 1"
            )

    def by_date(self) -> bool:
        return bool(self.train_end and self.val_end)


@dataclass(frozen=True)
class WalkForwardParams:
    enabled: bool = True
    min_train_days: int = 756
    test_days: int = 252
    scope: str = "full"


@dataclass(frozen=True)
class TuningParams:
    cv_splits: int = 4
    scoring: str = "neg_log_loss"
    selection_metric: str = "log_loss"
    parallelism: int = 4


@dataclass(frozen=True)
class ImportanceParams:
    enabled: bool = True
    n_repeats: int = 10
    scoring: str = "roc_auc"
    max_rows: int | None = None  # the newest rows that are scored; all if missing


@dataclass(frozen=True)
class EvaluationParams:
    refit_on_train_val: bool = True
    permutation_importance: ImportanceParams = field(default_factory=ImportanceParams)


@dataclass(frozen=True)
class BacktestParams:
    threshold: float = 0.5
    long_short: bool = False
    short_threshold: float = 0.5
    cost_bps: float = 5.0
    execution_lag: int = 0
    risk_free_rate: float = 0.0
    periods_per_year: int = 252
    ma_rule_window: int = 50
    rolling_vol_window: int = 63

    def __post_init__(self):
        if not 0.0 <= self.threshold <= 1.0:
            raise ParamError("backtest.threshold must be in [0, 1]")
        if self.cost_bps < 0:
            raise ParamError("backtest.cost_bps must be non-negative")
        if self.execution_lag < 0:
            raise ParamError("backtest.execution_lag must be >= 0")

    def ma_rule(self) -> str:
        return f"ma_rule_{self.ma_rule_window}d"


# Default hyper-parameter grids and class weighting per model family.
DEFAULT_MODELS: dict[str, dict[str, Any]] = {
    "majority": {"enabled": True},
    "logreg_none": {"enabled": True, "class_weight": "balanced", "max_iter": 2000},
    "logreg_l1": {
        "enabled": True, "class_weight": "balanced", "max_iter": 5000,
        "grid": {"C": [0.001, 0.01, 0.1, 1.0, 10.0]},
    },
    "logreg_l2": {
        "enabled": True, "class_weight": "balanced", "max_iter": 2000,
        "grid": {"C": [0.001, 0.01, 0.1, 1.0, 10.0]},
    },
    "random_forest": {
        "enabled": True, "class_weight": "balanced_subsample",
        "grid": {
            "n_estimators": [200, 400], "max_depth": [3, 5, 8],
            "min_samples_leaf": [50, 200], "max_features": ["sqrt", 0.5],
        },
    },
    "xgboost": {
        "enabled": True, "allow_fallback": True,
        "grid": {
            "learning_rate": [0.03, 0.1], "max_depth": [2, 3], "n_estimators": [100, 300],
            "subsample": [0.7, 1.0], "colsample_bytree": [0.7, 1.0],
            "reg_alpha": [0.0, 0.1, 1.0], "reg_lambda": [1.0, 10.0],
        },
    },
}


@dataclass(frozen=True)
class ResearchParams:
    data: DataParams = field(default_factory=DataParams)
    features: FeatureParams = field(default_factory=FeatureParams)
    target: TargetParams = field(default_factory=TargetParams)
    split: SplitParams = field(default_factory=SplitParams)
    walk_forward: WalkForwardParams = field(default_factory=WalkForwardParams)
    tuning: TuningParams = field(default_factory=TuningParams)
    evaluation: EvaluationParams = field(default_factory=EvaluationParams)
    backtest: BacktestParams = field(default_factory=BacktestParams)
    models: Mapping[str, Mapping[str, Any]] = field(default_factory=lambda: DEFAULT_MODELS)
    seed: int = 42

    def __post_init__(self):
        if self.backtest.ma_rule_window not in self.features.ma_distance_windows:
            raise ParamError(
                f"backtest.ma_rule_window={self.backtest.ma_rule_window} must be one of "
                f"features.ma_distance_windows={self.features.ma_distance_windows}"
            )

    def purge_days(self) -> int:
        """Dates removed at each segment boundary; an explicit 0 means none."""
        purge = self.split.purge_days
        return self.target.horizon if purge is None else int(purge)

    def cv_gap(self) -> int:
        """Cross-validation gap: here a purge of 0 also falls back to the horizon."""
        return int(self.split.purge_days or self.target.horizon)

    @classmethod
    def from_mapping(cls, mapping: Mapping[str, Any]) -> ResearchParams:
        known = {f.name for f in fields(cls)}
        values: dict[str, Any] = {
            name: _build(_SECTIONS[name], mapping[name])
            for name in known & mapping.keys() & _SECTIONS.keys()
        }
        if "models" in mapping:
            values["models"] = mapping["models"]
        if "seed" in (mapping.get("project") or {}):
            values["seed"] = int(mapping["project"]["seed"])
        params = cls(**values)
        if not params.data.universe():
            raise ParamError("data.tickers (plus extra_tickers) needs at least one ticker")
        return params


_SECTIONS = {
    "data": DataParams, "features": FeatureParams, "target": TargetParams, "split": SplitParams,
    "walk_forward": WalkForwardParams, "tuning": TuningParams, "evaluation": EvaluationParams,
    "backtest": BacktestParams,
}
#: Accepted and without effect here (paths, local parallelism).
NOT_ON_A_CLUSTER = frozenset({
    "raw_dir", "processed_dir", "sample_dir", "force_download", "max_retries", "retry_wait_seconds", "n_jobs",
})
_NESTED = {"market_features": MarketParams, "permutation_importance": ImportanceParams}


def _build(kind, mapping):
    """Make one section. A key that is neither known nor without meaning on a cluster is an error."""
    known = {f.name for f in fields(kind)}
    values = {}
    for key, value in (mapping or {}).items():
        if key in NOT_ON_A_CLUSTER:
            continue
        if key not in known:
            raise ParamError(f"{kind.__name__} has no parameter {key!r}; it has {', '.join(sorted(known))}")
        if key in _NESTED:
            value = _build(_NESTED[key], value)
        elif isinstance(value, list):
            value = tuple(value)
        elif key in ("start", "end", "train_end", "val_end") and value is not None:
            value = str(value)
        values[key] = value
    return kind(**values)
