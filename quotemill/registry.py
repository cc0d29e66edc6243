"""Registries of strategies by name, in order, each of which can be switched off; applications extend them."""

from __future__ import annotations

from collections.abc import Callable

from quotemill.operators import concepts as co


class Registry:
    """Strategies of one stage: ``extend`` adds one, ``enable`` switches one, ``enabled`` gives those that run, in order."""

    def __init__(self, stage: str, defaults: dict[str, Callable]):
        self.stage = stage
        self._strategies: dict[str, Callable] = {}
        self._off: set[str] = set()
        for name, f in defaults.items():
            self.extend(name, f)

    def extend(self, name: str, strategy: Callable, on: bool = True) -> None:
        if name in self._strategies:
            raise ValueError(f"{self.stage}: {name} is there already")
        self._strategies[name] = strategy
        self.enable(name, on)

    def enable(self, name: str, on: bool = True) -> None:
        self.require(name)
        (self._off.discard if on else self._off.add)(name)

    def require(self, name: str) -> Callable:
        if name not in self._strategies:
            raise KeyError(f"{self.stage}: no {name}")
        return self._strategies[name]

    def enabled(self) -> dict[str, Callable]:
        return {n: f for n, f in self._strategies.items() if n not in self._off}

    def snapshot(self) -> list[dict]:
        return [{"name": n, "enabled": n not in self._off, "position": i} for i, n in enumerate(self._strategies)]


#: The detectors of equivalences.
DETECTORS = Registry("equivalence_detection", {k: co.pair_detector(k) for k in co.RELATIONS})
