"""Settings from KEY=VALUE files and the environment, and lists of models."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_env(text: str) -> dict[str, str]:
    """Settings of KEY=VALUE lines; comments, blank lines and `export` are skipped, outer quotes dropped."""
    found: dict[str, str] = {}
    for line in map(str.strip, text.splitlines()):
        key, mark, value = line.removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if mark and key and not line.startswith("#"):
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            found[key] = value[1:-1] if quoted else value
    return found


def load_env(path: str, override: bool = False) -> None:
    """Put a file's settings into the environment; set ones stay unless override."""
    file = Path(path)
    found = parse_env(file.read_text(encoding="utf-8")) if file.exists() else {}
    os.environ.update(found if override else {k: v for k, v in found.items() if k not in os.environ})


def env_text(name: str, default: str = "") -> str:
    return os.environ.get(name, default).strip()


# Words that switch a setting on.
ON = {"1", "true", "yes", "y", "on"}


def env_flag(name: str, default: bool = False) -> bool:
    return env_text(name).casefold() in ON if name in os.environ else default


def capable_models(models: DataFrame, capability: str) -> DataFrame:
    """Models (backend, model_id, capabilities map) that have a capability, by backend and name."""
    return models.where(F.coalesce(F.col("capabilities")[capability], F.lit(False))).orderBy("backend", "model_id")
