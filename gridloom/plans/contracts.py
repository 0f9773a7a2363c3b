"""Producers: nodes that need variables of a cube and make others.

``compute`` maps lazy DataFrames to lazy DataFrames and doesn't touch the cube;
extraction before it and the merge after it are the engine's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import Capabilities, Request, TileSpec, VarSpec, tiles_of
from gridloom.operators import stencil


def name_of(item: str | VarSpec) -> str:
    return item if isinstance(item, str) else item.name


def names_of(items: Iterable[str | VarSpec] | str | None) -> tuple[str, ...]:
    if items is None:
        return ()
    return (items,) if isinstance(items, str) else tuple(name_of(i) for i in items)


def specs_of(items: Iterable[str | VarSpec] | str | None, kind: str = "static") -> tuple[VarSpec, ...]:
    items = (items,) if isinstance(items, (str, VarSpec)) else items or ()
    return tuple(i if isinstance(i, VarSpec) else VarSpec(i, kind) for i in items)


class Producer:
    """extract, then compute, then update."""

    name = "producer"
    produces: tuple[VarSpec, ...] = ()
    requires: tuple[VarSpec, ...] = ()
    capabilities = Capabilities()

    def extract(self, cube, request: Request) -> dict[str, DataFrame]:
        """Required variables, time variables within the request's window."""
        out = {}
        for spec in specs_of(self.requires):
            row = cube.catalog.variable(spec.name)
            if row is None:
                if spec.required:
                    raise KeyError(f"{self.name} needs {spec.name}")
                continue
            windowed = row.kind == "time" and (request.t_start is not None or request.t_end is not None)
            out[spec.name] = cube.read_window(spec.name, request.t_start, request.t_end) if windowed else cube.read(spec.name)
        return out

    def compute(self, inputs: dict[str, DataFrame], request: Request) -> dict[str, DataFrame]:
        raise NotImplementedError

    def update(self, cube, outputs: Mapping[str, DataFrame], request: Request) -> dict[str, int]:
        """Merge the outputs, which must be those declared, by each one's policy."""
        check_outputs(self, outputs)
        specs = {s.name: s for s in specs_of(self.produces)}
        return {n: cube.merge(specs[n], df, source=f"producer:{self.name}", producer=self.name) for n, df in outputs.items()}

    def run(self, cube, request: Request) -> dict[str, int]:
        return self.update(cube, self.compute(self.extract(cube, request), request), request)


def check_outputs(producer: Producer, outputs: Mapping[str, DataFrame]) -> None:
    """All declared outputs that are required, no others, and their columns."""
    specs = {s.name: s for s in specs_of(producer.produces)}
    missing = [n for n, s in specs.items() if s.required and n not in outputs]
    extra = sorted(outputs.keys() - specs.keys())
    if missing or extra:
        raise ValueError(f"{producer.name} left out {missing} and made undeclared {extra}")
    for n, df in outputs.items():
        need = {"y", "x", "value"} | ({"t"} if specs[n].kind == "time" else set())
        if not need <= set(df.columns):
            raise ValueError(f"{n} lacks columns {sorted(need - set(df.columns))}")


class TiledProducer(Producer):
    """A producer that works tile by tile, with a halo around each.

    ``init`` comes first, then ``process`` gets each wanted tile's rows (the
    required variables as columns, and is_inner) as a pandas frame and returns
    rows (y, x, value) of the first variable it produces, and ``finalize`` last,
    only if no tile failed. All tiles are one grouped job, which runs once: its
    rows are staged beside the cube, and both the tiles' metrics and the cells
    of the inner tiles are read from there. ``attempts`` tries are made at a tile.
    """

    tile = 256
    attempts = 1

    def tiles(self, cube, request: Request) -> list[TileSpec]:
        return tiles_of(cube.grid.height, cube.grid.width, self.tile)

    def wanted(self, cube, request: Request, tile: TileSpec) -> bool:
        """Whether the tile is worked on; where this fails, it is."""
        return True

    def init(self, cube, request: Request) -> None:
        """Before any tile."""

    def process(self, rows, tile: tuple[int, int]):
        raise NotImplementedError

    def finalize(self, cube, request: Request, versions: dict[str, int]) -> dict[str, int]:
        """After all tiles; what the run reports."""
        return versions

    def compute_tiles(self, cube, request: Request) -> tuple[dict[str, DataFrame], DataFrame, Callable[[], None]]:
        """Outputs, a metric row for each tile (ty, tx, elapsed, attempts, ok, error), and what removes the stage."""
        keep = []
        for t in self.tiles(cube, request):
            try:
                wanted = self.wanted(cube, request, t)
            except Exception:
                wanted = True
            if wanted:
                keep.append((t.y[0] // self.tile, t.x[0] // self.tile))
        inputs = self.extract(cube, request)
        h, w = cube.grid.shape
        cells = cube.grid.cells(cube.spark).select("y", "x")
        for n, df in inputs.items():
            cells = cells.join(df.select("y", "x", F.col("value").alias(n)), ["y", "x"], "left")
        held = F.broadcast(cube.spark.createDataFrame(keep, "ty int, tx int"))  # one row for each tile of the plan
        haloed = stencil.haloed_tiles(cells, self.tile, self.capabilities.halo_cells, h, w).join(held, ["ty", "tx"])
        work, attempts = self.process, max(1, self.attempts)

        def one(key, rows):
            import time

            import pandas as pd

            began = time.perf_counter()
            for turn in range(1, attempts + 1):
                try:
                    out = work(rows.copy(), (int(key[0]), int(key[1])))[["y", "x", "value"]]
                    out = out.merge(rows.loc[rows.is_inner, ["y", "x"]], on=["y", "x"])
                    error = None
                    break
                except Exception as e:
                    out, error = pd.DataFrame({"y": [], "x": [], "value": []}), f"{type(e).__name__}: {e}"
            # the tile's own row has no cell
            mark = pd.DataFrame({"y": [-1], "x": [-1], "value": [float("nan")]})
            out = pd.concat([mark, out.astype({"y": int, "x": int, "value": float})], ignore_index=True)
            return out.assign(ty=key[0], tx=key[1], elapsed=time.perf_counter() - began, attempts=turn, error=error)

        schema = "y int, x int, value double, ty int, tx int, elapsed double, attempts int, error string"
        stage = cube.stage(f"tiles-{self.name}")
        haloed.groupBy("ty", "tx").applyInPandas(one, schema).write.parquet(stage)
        done = cube.spark.read.schema(schema).parquet(stage)
        metrics = done.where("y = -1").select("ty", "tx", "elapsed", "attempts", F.col("error").isNull().alias("ok"), "error")
        return {names_of(self.produces)[0]: done.where("y >= 0").select("y", "x", "value")}, metrics, lambda: cube.unstage(stage)

    def run(self, cube, request: Request) -> dict[str, int]:
        return run_tiles(self, cube, request)[0]


def run_tiles(producer: TiledProducer, cube, request: Request, seen: Callable[[list], None] = lambda rows: None) -> tuple[dict[str, int], int]:
    """init, tiles, update and finalize; ``seen`` gets the tiles' metrics before a failure is raised.

    Nothing is written if a tile failed. Returns the versions and the most attempts at a tile.
    """
    producer.init(cube, request)
    outputs, metrics, unstage = producer.compute_tiles(cube, request)
    try:
        rows = metrics.orderBy("ty", "tx").collect()  # a row a tile
        seen(rows)
        if bad := [f"tile {r.ty},{r.tx}: {r.error}" for r in rows if not r.ok]:
            raise TilesFailed(bad[:3], more=len(bad) - 3)
        versions = producer.update(cube, outputs, request)
    finally:
        unstage()
    return dict(producer.finalize(cube, request, versions) or {}), max((r.attempts for r in rows), default=1)


class TilesFailed(RuntimeError):
    def __init__(self, errors: list[str], more: int = 0):
        super().__init__("; ".join(errors) + f" (+{more} more)" * (more > 0))
        self.errors = errors


def is_tiled(producer: Any) -> bool:
    return isinstance(producer, TiledProducer) or all(callable(getattr(producer, m, None)) for m in ("tiles", "process", "compute_tiles"))


class FunctionProducer(Producer):
    """A callable as a producer: func(inputs, request) or, ``on_cube``, func(cube, request)."""

    def __init__(self, func: Callable, produces, requires=(), name: str | None = None, on_cube: bool = False, kind: str = "static"):
        self.func, self.on_cube = func, on_cube
        self.name = name or getattr(func, "__name__", "function")
        self.produces, self.requires = specs_of(produces, kind), specs_of(requires)

    def compute(self, inputs, request):
        out = self.func(inputs, request)
        return out if isinstance(out, Mapping) else {self.produces[0].name: out}

    def run(self, cube, request):
        return written_versions(self.func(cube, request), cube, self.produces) if self.on_cube else super().run(cube, request)


class DriverProducer(Producer):
    """A data driver (fetch(cube, t_start, t_end)) as a producer.

    ``end``: "inclusive_day" drivers take the last day itself as their end.
    ``check``: "any" takes any step of the variables as enough.
    """

    def __init__(self, driver, name: str | None = None, produces=None, requires=(), end: str = "as_requested", check: str = "as_requested"):
        if end not in ("as_requested", "inclusive_day") or check not in ("as_requested", "any"):
            raise ValueError("no such mode")
        self.driver, self.end, self.check = driver, end, check
        self.name = name or driver.name
        kind = "static" if getattr(driver, "is_static", False) else "time"
        self.produces, self.requires = specs_of(driver.produces if produces is None else produces, kind), specs_of(requires)

    def is_satisfied(self, cube, variable: str, request: Request) -> bool:
        if self.check == "any":
            return cube.catalog.variable(variable) is not None
        spec = next(s for s in self.produces if s.name == variable)
        return cube.satisfies(spec, request)

    def run(self, cube, request):
        end = request.t_end - timedelta(days=1) if request.t_end is not None and self.end == "inclusive_day" else request.t_end
        return written_versions(self.driver.fetch(cube, request.t_start, end), cube, self.produces)


def written_versions(out: Any, cube, declared) -> dict[str, int]:
    """What a run reports (nothing, a name, names, or versions by name) as versions by name."""
    if isinstance(out, Mapping):
        return {str(k): int(v) for k, v in out.items()}
    names = names_of(declared) if out is None else (out,) if isinstance(out, str) else tuple(str(n) for n in out)
    return {n: cube.catalog.latest_version(n) for n in names}


class ProducerRegistry:
    """Producers by name; each variable has one owner."""

    def __init__(self, producers: Iterable = ()):
        self._by_name: dict[str, Any] = {}
        self._owner: dict[str, str] = {}
        for p in producers:
            self.register(p)

    def register(self, producer, replace: bool = False):
        if producer.name in self._by_name and not replace:
            raise ValueError(f"{producer.name} is registered")
        taken = {v: self._owner[v] for v in names_of(producer.produces) if self._owner.get(v, producer.name) != producer.name}
        if taken and not replace:
            raise ValueError(f"owned by others: {taken}")
        for other in set(taken.values()):
            left = [s for s in self._by_name[other].produces if name_of(s) not in taken]
            if not left:
                self.unregister(other)
        self.unregister(producer.name)
        self._by_name[producer.name] = producer
        self._owner |= dict.fromkeys(names_of(producer.produces), producer.name)
        return producer

    def unregister(self, name: str) -> None:
        self._by_name.pop(name, None)
        self._owner = {v: n for v, n in self._owner.items() if n != name}

    def get(self, name: str):
        if name not in self._by_name:
            raise KeyError(f"no producer {name}")
        return self._by_name[name]

    def producer_for(self, variable: str):
        if variable not in self._owner:
            raise KeyError(f"nothing produces {variable}")
        return self._by_name[self._owner[variable]]

    def has_variable(self, variable: str) -> bool:
        return variable in self._owner

    def requires(self, producer) -> tuple[str, ...]:
        return names_of(producer.requires)

    def variables(self) -> list[str]:
        return sorted(self._owner)

    def __iter__(self):
        return iter(self._by_name.values())

    def __len__(self):
        return len(self._by_name)

    def __contains__(self, name: str) -> bool:
        return name in self._by_name


def as_registry(source: ProducerRegistry | Iterable) -> ProducerRegistry:
    """A registry of what is given: producers as they are, drivers and callables wrapped."""
    if isinstance(source, ProducerRegistry):
        return source
    return ProducerRegistry(_wrapped(p) for p in source)


def _wrapped(p):
    if callable(getattr(p, "run", None)):
        return p
    if callable(getattr(getattr(p, "driver", None), "fetch", None)):
        return DriverProducer(p.driver, name=p.name)
    if callable(getattr(p, "fetch", None)):
        return DriverProducer(p)
    if callable(getattr(p, "func", None)):
        return FunctionProducer(p.func, p.produces, getattr(p, "requires", ()), name=p.name, on_cube=True)
    raise TypeError(f"{p!r} is no producer")
