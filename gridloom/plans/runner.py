"""Runs pipelines over a cube: skips what it holds, retries, fires triggers, reports.

Nodes of a layer are submitted from threads of the driver; each node's work is
a Spark job of its own group, which the scheduler runs beside the others.
"""

from __future__ import annotations

import json
import statistics
import time
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from gridloom.log import get_logger
from gridloom.model import Request, VarSpec
from gridloom.plans.contracts import ProducerRegistry, is_tiled, names_of, run_tiles, specs_of
from gridloom.plans.pipeline import Pipeline
from gridloom.plans.retry import RetryPolicy, attempt

_log = get_logger("runner")


@dataclass
class TileMetric:
    ty: int
    tx: int
    elapsed_s: float
    ok: bool
    error: str | None = None
    attempts: int = 1


@dataclass
class StepResult:
    name: str
    status: str  # ok, skipped or error
    elapsed_s: float = 0.0
    versions: dict[str, int] = field(default_factory=dict)
    error: str | None = None
    attempts: int = 0
    dead_letter: bool = False
    tiles: list[TileMetric] = field(default_factory=list)

    def tile_summary(self) -> dict[str, float]:
        times = [t.elapsed_s for t in self.tiles]
        if not times:
            return {"n": 0}
        return {"n": len(times), "min_s": min(times), "median_s": statistics.median(times), "max_s": max(times), "total_s": sum(times), "errors": sum(not t.ok for t in self.tiles)}


@dataclass
class RunResult:
    steps: list[StepResult] = field(default_factory=list)
    triggered: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(s.status != "error" for s in self.steps)

    @property
    def counts(self) -> dict[str, int]:
        return {k: sum(s.status == k for s in self.steps) for k in ("ok", "skipped", "error")}

    @property
    def elapsed_s(self) -> float:
        return sum(s.elapsed_s for s in self.steps)

    def step(self, name: str) -> StepResult:
        return next(s for s in self.steps if s.name == name)

    def to_json(self) -> str:
        steps = [asdict(s) | {"tile_summary": s.tile_summary()} for s in self.steps]
        return json.dumps({"ok": self.ok, "counts": self.counts, "elapsed_s": self.elapsed_s, "triggered": self.triggered, "steps": steps}, indent=2)

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(self.to_json())


def is_satisfied(producer, cube, request: Request, caps: Mapping[str, float] | None = None) -> bool:
    """Whether every output is there, good enough for its consumers, and newer than the inputs.

    The producer's own ``is_satisfied`` decides where there is one, by variable
    or as a whole; errors count as no.
    """
    if request.force or not names_of(producer.produces):
        return False
    own = getattr(producer, "is_satisfied", None)
    try:
        if own is not None:
            try:
                there = all(own(cube, v, request) for v in names_of(producer.produces))
            except TypeError:
                there = bool(own(cube, request))
        else:
            there = all(cube.satisfies(s if isinstance(s, VarSpec) else VarSpec(s, ""), request) for s in producer.produces)
        for variable, cap in (caps or {}).items():
            have = cube.catalog.native_resolution(variable) if there else None
            there = there and (have is None or have <= cap)
        needs = list(names_of(producer.requires))
        return there and not (needs and any(cube.is_output_stale(v, needs) for v in names_of(producer.produces)))
    except Exception as error:
        _log.info("%s: taken as not satisfied: %s", producer.name, error)
        return False


class PipelineRunner:
    def __init__(self, registry: ProducerRegistry, *, workers: int = 4, fail_fast: bool = False, skip_when_satisfied: bool = True, retry: RetryPolicy = RetryPolicy(), result_dir: str | Path | None = None, verbose: bool = True):
        self.registry, self.workers, self.fail_fast = registry, workers, fail_fast
        self.skip, self.retry, self.result_dir, self.verbose = skip_when_satisfied, retry, result_dir, verbose

    def run(self, cube, pipeline: Pipeline, *, t_start: datetime | None = None, t_end: datetime | None = None, force: bool = False, context: dict[str, Any] | None = None, result_path: str | Path | bool | None = None) -> RunResult:
        """Every node once its dependencies are done; nodes behind a failed one are errors.

        ``result_path`` False writes no report, None one into ``result_dir``.
        """
        request = Request(t_start, t_end, force, None, dict(context or {}))
        pipeline.topological_layers()  # refuses unknown names and cycles before anything runs
        if self.verbose:
            _log.info(pipeline.explain())
        waiting = {n: set(node.after) for n, node in pipeline.nodes.items()}
        caps = self._caps(waiting)
        result, done, failed = RunResult(), set(), set()
        try:
            while waiting:
                for n in sorted(n for n, after in waiting.items() if after & failed and after <= done | failed):
                    waiting.pop(n)
                    failed.add(n)
                    result.steps.append(StepResult(n, "error", error="upstream dependency failed"))
                ready = sorted(n for n, after in waiting.items() if after <= done)
                if not ready:
                    if any(after & failed for after in waiting.values()):
                        continue
                    if waiting:
                        raise RuntimeError(f"pipeline stuck: {sorted(waiting)}")
                    break
                for step in self._layer(ready, cube, request, caps):
                    waiting.pop(step.name)
                    result.steps.append(step)
                    (failed if step.status == "error" else done).add(step.name)
                    if step.status == "ok":
                        self._fire(step.name, cube, pipeline, waiting, done, result)
                if self.fail_fast and failed:
                    break
            return result
        finally:
            self._report(result, result_path)

    def _caps(self, nodes) -> dict[str, float]:
        """The finest resolution that any consumer in the graph asks for, by variable."""
        caps: dict[str, float] = {}
        for n in nodes:
            for spec in specs_of(self.registry.get(n).requires) if n in self.registry else ():
                if spec.max_native_res_m is not None:
                    caps[spec.name] = min(caps.get(spec.name, spec.max_native_res_m), spec.max_native_res_m)
        return caps

    def _layer(self, names: list[str], cube, request: Request, caps: dict[str, float]) -> list[StepResult]:
        tiled = [n for n in names if n in self.registry and is_tiled(self.registry.get(n))]
        plain = [n for n in names if n not in tiled]
        if len(plain) > 1 and self.workers > 1:
            with ThreadPoolExecutor(min(self.workers, len(plain))) as pool:
                # data is written side by side; the catalog's lock lets one of them move its pointer
                out = list(pool.map(lambda n: self._step(n, cube, request, caps), plain))
        else:
            out = [self._step(n, cube, request, caps) for n in plain]
        return sorted(out + [self._step(n, cube, request, caps) for n in tiled], key=lambda s: s.name)

    def _step(self, name: str, cube, request: Request, caps: dict[str, float]) -> StepResult:
        began = time.perf_counter()
        try:
            producer = self.registry.get(name)
        except KeyError as error:
            return StepResult(name, "error", error=str(error))
        own = {v: c for v, c in caps.items() if v in names_of(producer.produces)}
        if self.skip and is_satisfied(producer, cube, request, own):
            return StepResult(name, "skipped", time.perf_counter() - began)
        tiles: list[TileMetric] = []
        work = (lambda: self._tiled(producer, cube, request, tiles)) if is_tiled(producer) else (lambda: producer.run(cube, request))
        versions, error, attempts = attempt(work, policy=self.retry)
        step = StepResult(name, "ok" if error is None else "error", time.perf_counter() - began, attempts=attempts, tiles=tiles)
        if error is None:
            step.versions = dict(versions or {})
        else:
            step.error, step.dead_letter = f"{type(error).__name__}: {error}", attempts >= self.retry.max_attempts
        if self.verbose:
            _log.info("%s: %s in %.2f s %s", name, step.status, step.elapsed_s, step.error or "")
        return step

    def _tiled(self, producer, cube, request: Request, tiles: list[TileMetric]) -> dict[str, int]:
        """One grouped job over all tiles, whose metrics are kept also where tiles fail."""

        def seen(rows) -> None:
            tiles[:] = [TileMetric(r.ty, r.tx, r.elapsed, r.ok, r.error, r.attempts) for r in rows]

        return run_tiles(producer, cube, request, seen)[0]

    def _fire(self, source: str, cube, pipeline: Pipeline, waiting: dict[str, set[str]], done: set[str], result: RunResult) -> None:
        for t in pipeline.triggers:
            if t.source != source or t.target in done:
                continue
            try:
                fired = bool(t.when(cube))
            except Exception as error:
                _log.info("trigger %s to %s: %s; not fired", t.source, t.target, error)
                fired = False
            if fired:
                waiting.setdefault(t.target, set()).add(source)
                result.triggered.append(t.target)

    def _report(self, result: RunResult, path: str | Path | bool | None) -> None:
        if path is False or (path is None and self.result_dir is None):
            return
        stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
        try:
            result.save(path if path is not None else Path(self.result_dir) / f"runresult_{stamp}.json")
        except OSError as error:
            _log.warning("no report: %s", error)
