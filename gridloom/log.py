"""Loggers: INFO to the console, DEBUG to a rotating file."""

from __future__ import annotations

import logging
import logging.handlers
import re
import sys
from datetime import datetime, timezone
from pathlib import Path

ROOT = "gridloom"


def level(value: int | str) -> int:
    if isinstance(value, str):
        number = logging.getLevelName(value.upper())
        if not isinstance(number, int):
            raise ValueError(f"no such level: {value}")
        return number
    return value


def get_logger(name: str = "") -> logging.Logger:
    return logging.getLogger(f"{ROOT}.{name}" if name else ROOT)


def configure(file: str | Path | None = None, console: int | str = "INFO", to_file: int | str = "DEBUG") -> logging.Logger:
    """Set up handlers; calling it again replaces them."""
    root = get_logger()
    root.setLevel(logging.DEBUG)
    for h in list(root.handlers):
        root.removeHandler(h)
        h.close()
    handler = logging.StreamHandler(sys.stderr)
    handler.setLevel(level(console))
    handlers: list[logging.Handler] = [handler]
    if file is not None:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.handlers.RotatingFileHandler(file, maxBytes=10 << 20, backupCount=3))
        handlers[-1].setLevel(level(to_file))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        root.addHandler(h)
    return root


def label(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9\-_.]", "_", text)


def run_id(name: str, now: datetime | None = None) -> str:
    return f"{(now or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%SZ')}-{label(name)}"
