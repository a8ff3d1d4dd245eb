"""Settings with their defaults, and overrides from plain mappings such as parsed configuration files."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    paths: int = 10_000
    horizon_days: int = 21
    cost_bps: float = 15.0
    risk_free: float = 0.065
    alpha: float = 0.1
    gamma: float = 0.015
    hazard: float = 100.0
    particles: int = 1000
    max_r_hat: float = 1.05
    train_until: str = "1999-01-01"
    calibrate_until: str = "2000-06-01"


def load(values: dict | None = None, base: Settings = Settings()) -> Settings:
    """base with the given values; names that aren't settings are an error, values take the setting's type."""
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    unknown = sorted(set(values or {}) - set(kinds))
    if unknown:
        raise KeyError(f"no such setting: {', '.join(unknown)}")
    return replace(base, **{k: kinds[k](v) for k, v in (values or {}).items()})
