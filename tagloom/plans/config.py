"""Configuration: one YAML file with the sections paths, artifacts and pipeline (a section for each stage)."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class Config:
    raw: dict[str, Any] = field(default_factory=dict)
    workdir: str = "."

    @classmethod
    def parsed(cls, text: str, workdir: str = ".") -> Config:
        import yaml

        return cls(yaml.safe_load(text) or {}, workdir)

    @classmethod
    def load(cls, path: str, workdir: str | None = None) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls.parsed(f.read(), workdir or str(Path(path).resolve().parent))

    def stage(self, name: str, **overrides) -> dict[str, Any]:
        """A copy of a stage's section with overrides on top."""
        section = copy.deepcopy((self.raw.get("pipeline") or {}).get(name) or {})
        for key, value in overrides.items():
            *parents, last = key.split(".")
            at = section
            for p in parents:
                at = at.setdefault(p, {})
            at[last] = value
        return section

    def artifact(self, name: str) -> str | None:
        found = (self.raw.get("artifacts") or {}).get(name)
        return self.path(found) if found else None

    def path(self, value: str) -> str:
        """An absolute path or URI; relative ones are below workdir."""
        if "://" in value or value.startswith("/"):
            return value
        return str(Path(self.workdir) / value)


def flag(value: Any, default: bool = False) -> bool:
    """A switch of a configuration: booleans, numbers and their usual words."""
    if value is None:
        return default
    if isinstance(value, str):
        return value.strip().lower() in {"1", "true", "yes", "on"}
    return bool(value)


def required(section: dict, stage: str, *keys: str) -> list:
    """Values of dotted keys; an error that names the missing ones."""
    out, missing = [], []
    for key in keys:
        at: Any = section
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        out.append(at)
        if at is None:
            missing.append(key)
    if missing:
        raise ValueError(f"{stage}: the configuration lacks {', '.join(missing)}")
    return out
