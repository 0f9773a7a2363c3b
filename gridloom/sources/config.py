"""Configuration files."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any


def load_config(path: str | Path) -> dict[str, Any]:
    """A YAML or JSON mapping, told apart by its suffix."""
    path = Path(path)
    if path.suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(path.read_text()) or {}
    if path.suffix == ".json":
        return json.loads(path.read_text())
    raise ValueError(f"no loader for {path.suffix or path}")


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with ``over`` on top, mapping by mapping; None changes nothing, lists are replaced."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = v
    return out
