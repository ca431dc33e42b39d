"""Settings: weights of events, features, boosts and blending; read from TOML, checked on the driver."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

STRATEGIES = ("collaborative", "sequential", "item_based", "content_fallback", "latest", "popular")
PERSONALIZED = ("collaborative", "sequential", "item_based", "content_fallback")
NEEDS_HISTORY = ("sequential", "item_based", "content_fallback")
# The label that each strategy leaves in the source column.
SOURCE_LABELS = {
    "collaborative": "personalized",
    "sequential": "sequential",
    "item_based": "item_based",
    "content_fallback": "content_fallback",
    "latest": "latest",
    "popular": "popular_fallback",
}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class FeatureColumn:
    column: str
    type: str = "categorical"


@dataclass(frozen=True)
class BoostRule:
    name: str
    item_column: str
    kind: str  # boolean, value_map, numeric
    factor: float = 1.0
    value_factors: Mapping[str, float] = field(default_factory=dict)
    weight: float = 0.0


@dataclass(frozen=True)
class Blending:
    enabled: bool = False
    curve: str = "sigmoid"
    midpoint: float = 5.0
    steepness: float = 1.0
    saturate_at: float = 10.0
    popular_share: float = 0.7
    rrf_k: float = 60.0
    latest_date_columns: tuple[str, ...] = ("published_at",)


@dataclass(frozen=True)
class FeatureConfig:
    event_weights: Mapping[str, float]
    quantity_scaled: tuple[str, ...] = ()
    event_caps: Mapping[str, int] = field(default_factory=dict)
    user_features: tuple[FeatureColumn, ...] = ()
    item_features: tuple[FeatureColumn, ...] = ()
    availability: tuple[str, ...] = ()
    boosts: tuple[BoostRule, ...] = ()
    boost_overfetch: int = 3
    blending: Blending = Blending()


# The weights, caps and features that the shop's tables are read with.
SHOP = FeatureConfig(
    event_weights={"purchase": 4.0, "review_positive": 5.0, "review_negative": -3.0, "saved": 2.0, "cart_add": 1.0, "view": 0.3},
    quantity_scaled=("purchase",),
    event_caps={"view": 5},
    user_features=(FeatureColumn("favorite_styles", "list"), FeatureColumn("region_slug")),
    item_features=(
        FeatureColumn("category"), FeatureColumn("primary_style"), FeatureColumn("producer_id"), FeatureColumn("region_slug"), FeatureColumn("abv_bucket"),
    ),
    availability=("published", "in_stock"),
)


def positive(name: str, value: Any, kind: type = float) -> Any:
    """The value as kind, if it is a number above zero (a whole one for int); booleans are no numbers."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0 or (kind is int and value != int(value)):
        raise ConfigError(f"{name} must be a positive {'whole number' if kind is int else 'number'}, not {value!r}")
    return kind(value)


def unit(name: str, value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ConfigError(f"{name} must lie between 0 and 1, not {value!r}")
    return float(value)


def check_weights(weights: Mapping[str, float], names: tuple[str, ...]) -> dict[str, float]:
    for name, w in weights.items():
        if name not in names:
            raise ConfigError(f"unknown strategy {name!r}")
        if isinstance(w, bool) or not isinstance(w, (int, float)) or w < 0:
            raise ConfigError(f"weight of {name} must be at least 0")
    return {k: float(v) for k, v in weights.items()}


def substitute_env(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """${NAME} becomes the variable's value, $${NAME} stays as ${NAME}; an unset variable is an error."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: substitute_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute_env(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        if m[1]:
            return m[0][1:]
        if m[2] not in env:
            raise ConfigError(f"environment variable {m[2]} is not set")
        return env[m[2]]

    return re.sub(r"(\$)?\$\{([A-Za-z_][A-Za-z0-9_]*)\}", put, value)


def _features(rows: Any, where: str) -> tuple[FeatureColumn, ...]:
    out = []
    for r in rows or ():
        kind = r.get("type", "categorical")
        if kind not in ("categorical", "list") or not r.get("column"):
            raise ConfigError(f"{where}: needs a column, and type categorical or list")
        out.append(FeatureColumn(r["column"], kind))
    return tuple(out)


def _boost(r: Mapping[str, Any]) -> BoostRule:
    kind, name = r.get("kind"), r.get("name", "boost")
    if not r.get("item_column"):
        raise ConfigError(f"{name}: item_column is missing")
    if kind == "boolean":
        return BoostRule(name, r["item_column"], kind, factor=positive(f"{name}.factor", r.get("factor")))
    if kind == "value_map":
        factors = {str(k): positive(f"{name}.{k}", v) for k, v in (r.get("value_factors") or {}).items()}
        if not factors:
            raise ConfigError(f"{name}: value_factors is empty")
        return BoostRule(name, r["item_column"], kind, value_factors=factors)
    if kind == "numeric":
        return BoostRule(name, r["item_column"], kind, weight=positive(f"{name}.weight", r.get("weight")))
    raise ConfigError(f"{name}: kind must be boolean, value_map or numeric")


def parse_features(raw: Mapping[str, Any]) -> FeatureConfig:
    """A FeatureConfig from a parsed TOML document."""
    raw = substitute_env(dict(raw))
    if not raw.get("event_weights"):
        raise ConfigError("event_weights is missing")
    if raw.get("boost") and raw.get("boosts"):
        raise ConfigError("give boost or boosts, not both")
    b = raw.get("blending") or {}
    base = Blending()
    curve = b.get("curve", base.curve)
    if curve not in ("sigmoid", "linear"):
        raise ConfigError("blending.curve must be sigmoid or linear")
    over = raw.get("boost_overfetch_factor", 3)
    return FeatureConfig(
        event_weights={k: float(v) for k, v in raw["event_weights"].items()},
        quantity_scaled=tuple(raw.get("quantity_scaled_events") or ()),
        event_caps={k: positive(f"event_caps.{k}", v, int) for k, v in (raw.get("event_caps") or {}).items()},
        user_features=_features(raw.get("user_features"), "user_features"),
        item_features=_features(raw.get("item_features"), "item_features"),
        availability=tuple(raw.get("item_availability_filters") or ()),
        boosts=tuple(_boost(r) for r in raw.get("boost") or raw.get("boosts") or ()),
        boost_overfetch=int(over) if over >= 1 else 3,
        blending=Blending(
            enabled=bool(b.get("enabled", base.enabled)), curve=curve, midpoint=float(b.get("midpoint", base.midpoint)),
            steepness=positive("blending.steepness", b.get("steepness", base.steepness)),
            saturate_at=positive("blending.saturate_at", b.get("saturate_at", base.saturate_at)),
            popular_share=unit("blending.popular_share", b.get("popular_share", base.popular_share)),
            rrf_k=positive("blending.rrf_k", b.get("rrf_k", base.rrf_k)),
            latest_date_columns=tuple(b.get("latest_date_columns", base.latest_date_columns)),
        ),
    )


def load_features(path: str) -> FeatureConfig:
    with open(path, "rb") as f:
        return parse_features(tomllib.load(f))


@dataclass(frozen=True)
class JobSettings:
    top_k: int = 10
    half_life_days: float = 90.0
    models: tuple[str, ...] = ("collaborative", "item_based", "popular")
    model_weights: Mapping[str, float] | None = None  # given: weighted fusion instead of priority
    rrf_k: float = 60.0
    content_fallback: bool = False
    neighbours: int = 20
    content_rows: int = 50
    latest_days: int = 14
    folds: int = 2
    fold_days: int = 14
    automl: bool = False  # choose models, weights and rrf_k by backtesting before the run
    candidates: tuple[Mapping[str, Any], ...] | None = None  # None: every strategy alone and two combinations
    primary_metric: str = "MAP"
    epochs: tuple[int, ...] = ()  # iterations of collaborative after which its fit is measured for the manifest
    sequential_least: float = 5.0  # median items of a user below which sequential is no candidate


def parse_job(raw: Mapping[str, Any]) -> JobSettings:
    """JobSettings from the [job] table of a parsed TOML document."""
    job = substitute_env(dict(raw.get("job") or raw))
    models = tuple(job.get("models") or JobSettings.models)
    if not models or any(m not in STRATEGIES for m in models):
        raise ConfigError(f"models must be some of {', '.join(STRATEGIES)}")
    weights, auto = job.get("model_weights"), job.get("automl") or {}
    if auto.get("candidates") is not None and not auto["candidates"]:
        raise ConfigError("automl.candidates is empty")
    return JobSettings(
        top_k=positive("top_k", job.get("top_k", 10), int), half_life_days=positive("half_life_days", job.get("half_life_days", 90.0)),
        models=models, model_weights=None if weights is None else check_weights(weights, STRATEGIES),
        rrf_k=positive("rrf_k", job.get("rrf_k", 60.0)), content_fallback=bool(job.get("content_fallback", False)),
        neighbours=positive("neighbours", job.get("neighbours", 20), int), content_rows=positive("content_rows", job.get("content_rows", 50), int),
        latest_days=positive("latest_days", job.get("latest_days", 14), int), folds=positive("n_splits", auto.get("n_splits", job.get("folds", 2)), int),
        fold_days=positive("test_days", auto.get("test_days", job.get("fold_days", 14)), int), automl=bool(auto.get("enabled", False)),
        candidates=tuple(auto["candidates"]) if auto.get("candidates") is not None else None, primary_metric=str(auto.get("primary_metric", "MAP")),
        epochs=tuple(positive("epochs", e, int) for e in job.get("epochs") or ()), sequential_least=float(job.get("sequential_min_median_interactions", 5.0)),
    )
