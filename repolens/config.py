"""Settings from files and the environment, and the small key=value store behind ``repolens config``."""

from __future__ import annotations

import os
from pathlib import Path

DEFAULTS = {"REPOLENS_STORE": "./repolens-store", "REPOLENS_MAX_TOKENS": "150", "REPOLENS_SLOTS": "16", "REPOLENS_DIMENSIONS": "384"}
GLOBAL_FILE, LOCAL_FILE = Path.home() / ".repolens" / "env", Path(".repolens.env")


def read_env(path: Path) -> dict[str, str]:
    if not path.exists():
        return {}
    pairs = (x.partition("=") for x in path.read_text().splitlines() if "=" in x and not x.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}


def write_env(path: Path, changes: dict[str, str]) -> None:
    merged = read_env(path) | changes
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{k}={v}\n" for k, v in sorted(merged.items())))


def load_config(global_file: Path = GLOBAL_FILE, local_file: Path = LOCAL_FILE, environ: dict[str, str] | None = None) -> dict[str, str]:
    """Defaults, then the global file, then the local one, then the environment."""
    env = os.environ if environ is None else environ
    return DEFAULTS | read_env(global_file) | read_env(local_file) | {k: v for k, v in env.items() if k.startswith("REPOLENS_")}


def masked(settings: dict[str, str]) -> dict[str, str]:
    """Settings for display: what looks secret is hidden."""
    return {k: "***" if any(x in k.upper() for x in ("KEY", "PASSWORD", "TOKEN", "SECRET")) and v else v for k, v in settings.items()}
