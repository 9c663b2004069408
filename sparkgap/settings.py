"""Settings of an analysis, and their profile file."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field

SCHEMA = "analysis_settings"


@dataclass(frozen=True)
class Settings:
    """What an analysis run may vary; the defaults are the engine's."""

    threshold_mm: float = 0.2
    cti: float = 175.0
    pollution_degree: int = 2
    altitude_m: float = 5500.0
    metallic_particle_size_mm: float = 0.0
    external_conformal_coating: bool = False
    include_none_net: bool = False
    layers: tuple[str, ...] = ()
    galvanic_zones_enabled: bool | None = None
    galvanic_zone_voltage_v: float = 1000.0
    galvanic_zone_matrix: dict = field(default_factory=dict)


def write_profile(settings: Settings, path: str) -> None:
    from .sinks.reports import write_json

    write_json({"schema": SCHEMA, "schema_version": 1, **dataclasses.asdict(settings)}, path)


def read_profile(path: str) -> Settings:
    """The settings in a profile; unknown keys are ignored, a newer version is refused."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    if not isinstance(content, dict) or content.get("schema") != SCHEMA or int(content.get("schema_version", 0)) > 1:
        raise ValueError(f"no settings profile: {os.path.basename(path)}")
    known = {f.name for f in dataclasses.fields(Settings)}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in content.items() if k in known}
    return Settings(**values)
