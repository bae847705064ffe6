"""Operators by name: what they need, whether they can run, and discovery of further ones."""

from __future__ import annotations

import importlib
import importlib.util
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[..., DataFrame] | None
    description: str = ""
    needs: tuple[str, ...] = ()
    #: Groups of pipelines: one of each group must have run.
    after: tuple[tuple[str, ...], ...] = ()
    visible: bool = True
    missing: tuple[str, ...] = field(default=())

    def __call__(self, *args, **kwargs) -> DataFrame:
        if self.run is None or self.missing:
            raise ImportError(f"{self.name} needs {', '.join(self.missing) or 'code that could not be loaded'}")
        return self.run(*args, **kwargs)


PIPELINES: dict[str, Operator] = {}
POSTPROCESSES: dict[str, Operator] = {}


def _missing(needs: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(n for n in needs if importlib.util.find_spec(n) is None)


def _add(into: dict[str, Operator], name: str, description: str, needs: tuple[str, ...], after=(), visible: bool = True):
    def wrap(f):
        if name in into:
            raise ValueError(f"{name} is registered twice")
        into[name] = Operator(name, f, description, tuple(needs), tuple(map(tuple, after)), visible, _missing(tuple(needs)))
        return f

    return wrap


def pipeline(name: str, description: str = "", needs: tuple[str, ...] = ()):
    """Register a function of waveforms to metrics."""
    return _add(PIPELINES, name, description, needs)


def postprocess(name: str, description: str = "", needs: tuple[str, ...] = (), after=(), visible: bool = True):
    """Register a function of metrics to report frames; ``after`` lists groups of which one pipeline each must have run."""
    return _add(POSTPROCESSES, name, description, needs, after, visible)


def unmet(name: str, ran: set[str]) -> list[tuple[str, ...]]:
    """Requirement groups of a postprocess of which no pipeline has run."""
    return [g for g in POSTPROCESSES[name].after if not ran & set(g)]


def catalog() -> list[tuple[str, str, bool]]:
    """(name, description, can run) of all visible operators, by name."""
    return sorted((o.name, o.description, not o.missing) for o in (*PIPELINES.values(), *POSTPROCESSES.values()) if o.visible)


def discover(package: str) -> dict[str, str]:
    """Import the modules of a package, which register what they have; modules that fail are named with the reason."""
    failed = {}
    for m in pkgutil.iter_modules(importlib.import_module(package).__path__, f"{package}."):
        try:
            importlib.import_module(m.name)
        except Exception as e:
            failed[m.name] = f"{type(e).__name__}: {e}"
    return failed
