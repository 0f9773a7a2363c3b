"""Graphs of producers, built on the driver; each node's work is a Spark plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Node:
    name: str
    after: set[str] = field(default_factory=set)
    optional: bool = False
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Trigger:
    """``target`` runs after ``source`` if ``when(cube)`` holds."""

    source: str
    target: str
    when: Callable[[Any], bool]


def parallel(*names: str) -> tuple[str, ...]:
    """A layer of a chain whose nodes don't wait for each other."""
    return names


class Pipeline:
    def __init__(self, name: str = "pipeline"):
        self.name = name
        self._nodes: dict[str, Node] = {}
        self.triggers: list[Trigger] = []

    @property
    def nodes(self) -> dict[str, Node]:
        return dict(self._nodes)

    @property
    def edges(self) -> list[tuple[str, str]]:
        return sorted((a, n.name) for n in self._nodes.values() for a in n.after)

    def add(self, name: str, after: Iterable[str] = (), optional: bool = False, **metadata: Any) -> Pipeline:
        """Add a node, or more dependencies of one that is there; it stays optional only if both say so."""
        if name in set(after):
            raise ValueError(f"{name} can't come after itself")
        if (node := self._nodes.get(name)) is None:
            self._nodes[name] = Node(name, set(after), optional, dict(metadata))
        else:
            node.after |= set(after)
            node.optional &= optional
            node.metadata |= metadata
        return self

    def remove(self, name: str) -> Pipeline:
        """Drop a node, and every mention of it."""
        self._nodes.pop(name, None)
        for node in self._nodes.values():
            node.after.discard(name)
        self.triggers = [t for t in self.triggers if name not in (t.source, t.target)]
        return self

    def on_complete(self, source: str, target: str, when: Callable[[Any], bool] = lambda cube: True) -> Pipeline:
        self.triggers.append(Trigger(source, target, when))
        return self

    @classmethod
    def chain(cls, steps: Sequence[str | Sequence[str]], name: str = "chain") -> Pipeline:
        """One step after another; a nested sequence is a layer of its own."""
        out, before = cls(name), ()
        for step in steps:
            layer = (step,) if isinstance(step, str) else tuple(step)
            for n in layer:
                out.add(n, after=before)
            before = layer
        return out

    @classmethod
    def from_targets(cls, targets: Iterable[str], registry, name: str = "from_targets") -> Pipeline:
        """The producers that the target variables need, found backwards.

        Requirements that nothing produces are left to the cube.
        """
        out, open_ = cls(name), []

        def visit(variable: str) -> str:
            producer = registry.producer_for(variable)
            if producer.name in open_:
                raise RuntimeError("cycle in pipeline: " + " -> ".join([*open_, producer.name]))
            if producer.name not in out._nodes:
                open_.append(producer.name)
                needs = [visit(r) for r in registry.requires(producer) if registry.has_variable(r)]
                open_.pop()
                out.add(producer.name, after=set(needs) - {producer.name})
            return producer.name

        for target in targets:
            visit(target)
        return out

    def topological_layers(self) -> list[list[str]]:
        """Nodes by how deep they stand, names sorted; unknown names and cycles are errors."""
        for node in self._nodes.values():
            if unknown := node.after - self._nodes.keys():
                raise ValueError(f"{node.name} comes after unknown {sorted(unknown)}")
        layers, done = [], set()
        while len(done) < len(self._nodes):
            ready = sorted(n.name for n in self._nodes.values() if n.name not in done and n.after <= done)
            if not ready:
                raise ValueError(f"cycle among {sorted(self._nodes.keys() - done)}")
            layers.append(ready)
            done.update(ready)
        return layers

    def explain(self) -> str:
        lines = [f"pipeline {self.name}"]
        for k, layer in enumerate(self.topological_layers()):
            lines += [f"  {k}: {n}" + (f" after {', '.join(sorted(self._nodes[n].after))}" if self._nodes[n].after else "") for n in layer]
        lines += [f"  on {t.source}: {t.target}" for t in self.triggers]
        return "\n".join(lines)

    def to_dot(self) -> str:
        lines = [f'digraph "{self.name}" {{']
        lines += [f'  "{n}";' for n in sorted(self._nodes)]
        lines += [f'  "{a}" -> "{b}";' for a, b in self.edges]
        lines += [f'  "{t.source}" -> "{t.target}" [style=dashed];' for t in self.triggers]
        return "\n".join([*lines, "}"])
