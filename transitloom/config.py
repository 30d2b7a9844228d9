"""Run configuration: cities, types, limits, and their validation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from .functions.text import TYPE_LABELS

# Other names of cities.
CITY_ALIASES = {"kyiv": "kiev", "київ": "kiev", "киев": "kiev"}


class ConfigError(ValueError):
    """Settings that contradict one another or are out of range."""


def resolve_city(raw: str) -> str:
    """The slug of a city given as a slug, an alias, a path or a URL."""
    text = unquote(raw.strip())
    path = urlparse(text).path if "://" in text else text
    parts = [p for p in path.split("/") if p]
    if not parts:
        raise ConfigError("a city is needed")
    slug = parts[0].lower()
    return CITY_ALIASES.get(slug, slug)


def parse_types(chunks: list[str]) -> set[str]:
    """Types from repeated, comma- or space-separated flags."""
    types = {t for chunk in chunks for t in re.split(r"[,\s]+", chunk.lower()) if t}
    if unknown := types - TYPE_LABELS.keys():
        raise ConfigError(f"unknown types: {', '.join(sorted(unknown))}")
    return types


@dataclass(frozen=True)
class Limits:
    """Filters of routes; 0 is off, and so is the radius without both center coordinates."""

    curvilinearity: float = 0.0
    min_km: float = 0.0
    radius_km: float = 0.0
    center: tuple[float | None, float | None] = (None, None)

    @property
    def where(self) -> tuple[float, float] | None:
        return self.center if self.radius_km > 0 and None not in self.center else None


@dataclass(frozen=True)
class RunConfig:
    city: str
    include: frozenset[str] = frozenset()
    exclude: frozenset[str] = frozenset()
    only: str = ""
    most_number: int = 0
    active_only: bool = True
    limits: Limits = field(default_factory=lambda: Limits(curvilinearity=2.0))
    volume_buffer_m: float = 800.0
    poi_buffer_m: float = 800.0
    dedup: bool = False
    dedup_buffer_m: float = 100.0
    dedup_threshold: float = 0.7
    dedup_passes: int = 1
    center_weight: float = 0.0
    heat_cell_km: float = 0.1
    heat_percent: float = 35.0
    heat_gamma: float = 0.6
    generate: int = 0

    def __post_init__(self) -> None:
        if both := self.include & self.exclude:
            raise ConfigError(f"types asked for and excluded: {', '.join(sorted(both))}")
        for name in ("volume_buffer_m", "poi_buffer_m", "dedup_buffer_m", "generate", "most_number"):
            if getattr(self, name) < 0:
                raise ConfigError(f"{name} must not be negative")
        if self.dedup_passes < 1:
            raise ConfigError("dedup_passes must be 1 at least")
        if not 0 <= self.dedup_threshold <= 1 or not 0 <= self.center_weight <= 1:
            raise ConfigError("dedup_threshold and center_weight must be from 0 to 1")
        if not 0 < self.heat_percent <= 100 or self.heat_cell_km <= 0 or self.heat_gamma <= 0:
            raise ConfigError("the heat map's settings must be positive, heat_percent at most 100")
