"""Configuration files."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def load(path: str | Path) -> dict[str, Any]:
    """YAML, or JSON by its suffix; an empty file is an empty configuration."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix == ".json":
        return json.loads(text or "{}")
    import yaml

    return yaml.safe_load(text) or {}


def save(config: dict[str, Any], path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if Path(path).suffix == ".json":
        Path(path).write_text(json.dumps(config, indent=2, default=str), encoding="utf-8")
        return
    import yaml

    Path(path).write_text(yaml.safe_dump(config, sort_keys=False), encoding="utf-8")
