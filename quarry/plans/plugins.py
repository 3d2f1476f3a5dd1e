"""Plugins: named implementations of a pipeline's steps with typed, checked parameters.

Plugins of other packages are found by entry points of the group GROUP. An entry point names a Plugin, several of them, or a
function without parameters that returns such. `ship` sends a plugin's package to the executors, whose tasks then can import it.
"""

from __future__ import annotations

import difflib
import importlib
import io
import os
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import SparkSession

from quarry.storage import new_path, write_bytes

GROUP = "quarry.plugins"
KINDS = ("dataset", "identifier", "augmentation", "transformation", "export")
# The names of parameter types.
TYPES = {"str": str, "int": int, "bool": bool, "float": float, "list": list, "dict": dict}
_MISSING: Any = object()


@dataclass(frozen=True)
class Param:
    name: str
    type: str = "str"
    default: Any = _MISSING
    choices: tuple = ()
    help: str = ""
    #: The value is a path; what lies there decides whether a step has to run again.
    source: bool = False

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"parameter {self.name!r}: type {self.type!r} is none of {', '.join(TYPES)}")

    @property
    def required(self) -> bool:
        return self.default is _MISSING

    def check(self, value: Any) -> Any:
        """The value in the parameter's type. Null needs no type and no choice; whole numbers pass as floats, truth values don't."""
        if value is None:
            return None
        if self.type == "float" and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, TYPES[self.type]) or (self.type == "int" and isinstance(value, bool)):
            raise TypeError(f"parameter {self.name!r} is of type {self.type}, not {type(value).__name__}")
        if self.choices and value not in self.choices:
            raise ValueError(f"parameter {self.name!r} is {value!r}, none of {list(self.choices)}")
        return value


@dataclass(frozen=True)
class Plugin:
    kind: str
    name: str
    run: Callable
    params: tuple[Param, ...] = ()
    #: Another version is another step: raise it where a plugin's results change.
    version: str = "1"

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name or self.name == "none":
            raise ValueError(f"{self.name!r} can't be a plugin's name")
        if not all(isinstance(p, Param) for p in self.params) or len({p.name for p in self.params}) < len(self.params):
            raise TypeError(f"plugin {self.name!r} needs different parameters of type Param")

    def resolve(self, given: dict[str, Any] | None) -> dict[str, Any]:
        """All parameters: given ones checked, others by default; unknown and missing ones are errors."""
        given = dict(given or {})
        names = [p.name for p in self.params]
        for name in given:
            if name not in names:
                near = difflib.get_close_matches(name, names, 1)
                raise ValueError(f"{self.kind} {self.name!r} has no parameter {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        out = {}
        for p in self.params:
            if p.name not in given and p.required:
                raise ValueError(f"{self.kind} {self.name!r} needs the parameter {p.name!r}")
            out[p.name] = p.check(given[p.name]) if p.name in given else p.default
        return out


@dataclass
class Registry:
    found: dict[tuple[str, str], Plugin] = field(default_factory=dict)

    def add(self, plugin: Plugin) -> Plugin:
        if plugin.kind not in KINDS:
            raise ValueError(f"unknown kind of plugin {plugin.kind!r}; known: {', '.join(KINDS)}")
        if not callable(plugin.run):
            raise TypeError(f"plugin {plugin.name!r} cannot be run")
        if (plugin.kind, plugin.name) in self.found:
            raise ValueError(f"{plugin.kind} {plugin.name!r} is registered twice")
        self.found[plugin.kind, plugin.name] = plugin
        return plugin

    def plugin(self, kind: str, name: str, *params: Param) -> Callable[[Callable], Callable]:
        """Decorator: register a function as the plugin of this name."""

        def put(run: Callable) -> Callable:
            self.add(Plugin(kind, name, run, params))
            return run

        return put

    def get(self, kind: str, name: str) -> Plugin:
        if (kind, name) not in self.found:
            raise KeyError(f"no {kind} {name!r}; there are {self.names(kind)}")
        return self.found[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.found if k == kind)

    def __iter__(self) -> Iterator[Plugin]:
        return iter(self.found.values())

    def describe(self) -> str:
        """All plugins and their parameters, for people."""
        lines = []
        for kind in KINDS:
            lines.append(f"{kind}:")
            for name in self.names(kind):
                lines.append(f"  {name}")
                for p in self.get(kind, name).params:
                    note = "required" if p.required else f"default {p.default!r}"
                    lines.append(f"    {p.name}: {p.type}, {note}" + (f", one of {list(p.choices)}" if p.choices else "") + (f" - {p.help}" if p.help else ""))
        return "\n".join(lines)


def _plugins_of(found: Any, where: str) -> list[Plugin]:
    if callable(found) and not isinstance(found, Plugin):
        found = found()
    many = list(found) if isinstance(found, (list, tuple)) else [found]
    if not many or not all(isinstance(p, Plugin) for p in many):
        raise TypeError(f"{where} gives no Plugin but {type(found).__name__}")
    return many


def discover(registry: Registry, spark: SparkSession | None = None, group: str = GROUP) -> list[Plugin]:
    """Registers the plugins of all installed packages; with a session, their packages go to the executors, each once.

    A name that is registered already, by the library or by another package, is an error, as is an entry point of another shape.
    """
    found, packages = [], set()
    for point in sorted(entry_points(group=group), key=lambda e: (e.name, e.value)):
        for plugin in _plugins_of(point.load(), f"entry point {point.name!r} ({point.value})"):
            found.append(registry.add(plugin))
            packages.add(point.module.partition(".")[0])
    for package in sorted(packages) if spark is not None else ():
        ship(spark, package)
    return found


def ship(spark: SparkSession, package: str) -> str:
    """Sends an importable package or module to the executors, by way of the shared folder; returns where it lies there."""
    place = importlib.import_module(package)
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as out:
        if hasattr(place, "__path__"):
            for top in place.__path__:
                for folder, _, names in os.walk(top):
                    for name in sorted(names):
                        if not name.endswith((".pyc", ".pyo")):
                            out.write(os.path.join(folder, name), os.path.join(package, os.path.relpath(os.path.join(folder, name), top)))
        else:
            out.write(place.__file__, f"{package}.py")
    path = f"{new_path(spark, 'plugin')}/{package}.zip"
    write_bytes(spark, path, body.getvalue())
    spark.sparkContext.addPyFile(path)
    return path
