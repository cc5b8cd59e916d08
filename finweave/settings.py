"""Settings from the environment, or from a file of NAME=value lines that the environment overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from finweave.errors import ContractError

#: Fixed values.
ENVIRONMENTS = ("local", "test", "staging")
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def read_env_file(path: str | None) -> dict[str, str]:
    """NAME=value lines; blank lines and comments are skipped, quotes around a value go; no file is no values."""
    if path is None or not Path(path).is_file():
        return {}
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and not name.startswith("#"):
            value = value.strip()
            out[name.strip().lower()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


@dataclass(frozen=True)
class Settings:
    app_env: str = "local"
    data_root: str = "data"
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        if self.app_env not in ENVIRONMENTS or self.log_level not in LOG_LEVELS:
            raise ContractError(f"settings: app_env {self.app_env}, log_level {self.log_level}")

    @classmethod
    def load(cls, env_file: str | None = ".env") -> Settings:
        given = read_env_file(env_file) | {k.lower(): v for k, v in os.environ.items()}
        return cls(**{name: given[name] for name in cls.__dataclass_fields__ if name in given})
