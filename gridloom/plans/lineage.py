"""Records of runs, checkpoints of iterative state, and schema versions, in the catalog."""

from __future__ import annotations

import hashlib
import json
import pickle
import platform
import subprocess
import sys
from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import functions as F

from gridloom.log import run_id as new_run_id
from gridloom.operators import catalogs
from gridloom.sources.catalog import Catalog

SCHEMA_VERSION = 1
LIBRARIES = ("pyspark", "pyarrow", "pandas", "numpy")


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def config_hash(config: Mapping[str, Any]) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def file_hash(path: str | Path, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def git_sha(root: str | Path = ".") -> str | None:
    try:
        done = subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


class RunManifest:
    """Within ``with``: a run that is ``running``, and ``ok`` or ``error`` after it. Errors go on."""

    def __init__(self, catalog: Catalog, name: str, config: Mapping[str, Any] | None = None, parent: str | None = None, notes: str = "", root: str | Path = "."):
        self.catalog, self.config, self.parent, self.notes, self.root = catalog, dict(config or {}), parent, notes, root
        self.run_id = f"{new_run_id(name)}-{catalog.next_sequence()}"

    def _save(self, status: str, ended: datetime | None) -> None:
        self.catalog.put("runs", [(self.run_id, self.started, ended, status, git_sha(self.root), config_hash(self.config), sys.version.split()[0], platform.platform(), self.parent, self.notes)])

    def __enter__(self) -> RunManifest:
        self.started = _now()
        self._save("running", None)
        self.catalog.put("run_libs", [(self.run_id, n, metadata.version(n)) for n in LIBRARIES])
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self._save("ok" if error is None else "error", _now())
        return False

    def record_input(self, role: str, path: str | Path) -> None:
        """A file's hash and size; folders by name only; what is absent is passed over."""
        p = Path(path)
        if p.is_dir():
            self.catalog.put("run_inputs", [(self.run_id, role, str(p), "(dir)", 0)])
        elif p.exists():
            self.catalog.put("run_inputs", [(self.run_id, role, str(p), file_hash(p), p.stat().st_size)])

    def record_output(self, variable: str, version: int, producer: str) -> None:
        self.catalog.put("run_outputs", [(self.run_id, variable, version, producer)])

    def summary(self) -> dict[str, Any]:
        row = self.catalog.table("runs").where(F.col("run_id") == self.run_id).first()
        count = lambda t: self.catalog.table(t).where(F.col("run_id") == self.run_id).count()
        return row.asDict() | {t: count(t) for t in ("run_inputs", "run_outputs", "run_libs")}


class CheckpointStore:
    """State of an iterative producer by step; a step's state replaces an earlier one."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def save(self, producer: str, step_id: int, state: Any) -> None:
        self.catalog.put("checkpoints", [(producer, step_id, _now(), bytearray(pickle.dumps(state)))])

    def _of(self, producer: str):
        return self.catalog.table("checkpoints").where(F.col("producer") == producer)

    def load(self, producer: str, step_id: int) -> Any:
        row = self._of(producer).where(F.col("step_id") == step_id).first()
        if row is None:
            raise KeyError(f"{producer} has no step {step_id}")
        return pickle.loads(bytes(row.state))

    def latest(self, producer: str) -> tuple[int, Any] | None:
        row = catalogs.latest_checkpoints(self._of(producer)).first()
        return (row.step_id, pickle.loads(bytes(row.state))) if row else None

    def steps(self, producer: str) -> list[int]:
        return [r.step_id for r in self._of(producer).select("step_id").orderBy("step_id").collect()]

    def delete(self, producer: str, step_id: int | None = None) -> int:
        """Drop one step or all; how many went."""
        gone = self._of(producer) if step_id is None else self._of(producer).where(F.col("step_id") == step_id)
        n = gone.count()
        if n:
            self.catalog.swap(checkpoints=self.catalog.table("checkpoints").join(gone.select("producer", "step_id"), ["producer", "step_id"], "left_anti"))
        return n


class SchemaTooNew(RuntimeError):
    pass


def schema_version(catalog: Catalog) -> int:
    row = catalog.table("cube_meta").where("key = 'schema_version'").first()
    return int(row.value) if row else 0


def migrate(catalog: Catalog, migrations: Mapping[int, Callable[[Catalog], None]], target: int = SCHEMA_VERSION) -> list[int]:
    """Bring a catalog to ``target``, one version at a time; the versions passed.

    ``migrations[n]`` takes version n - 1 to n. A newer catalog and a gap are
    refused before anything runs. The version moves after its step succeeded.
    """
    have = schema_version(catalog)
    if have > target:
        raise SchemaTooNew(f"the catalog has version {have}, this engine knows {target}")
    steps = list(range(have + 1, target + 1))
    if lacking := [n for n in steps if n not in migrations]:
        raise KeyError(f"no migration to version {lacking[0]}")
    for n in steps:
        migrations[n](catalog)
        catalog.put("cube_meta", [("schema_version", str(n))])
    return steps
