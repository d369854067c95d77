"""A small benchmark runner: repeated timings, and regressions against an earlier run."""

from __future__ import annotations

import json
import statistics
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Timing:
    name: str
    runs: int
    best: float
    median: float
    worst: float


class Benchmarks:
    def __init__(self, threshold: float = 0.2):
        self.threshold, self.timings = threshold, {}

    def run(self, name: str, body: Callable[[], object], runs: int = 3, warm_up: int = 1) -> Timing:
        for _ in range(warm_up):
            body()
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            body()
            took.append(time.perf_counter() - began)
        self.timings[name] = Timing(name, runs, min(took), statistics.median(took), max(took))
        return self.timings[name]

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({n: asdict(t) for n, t in self.timings.items()}, f, indent=1)

    def regressions(self, path: str) -> dict[str, float]:
        """Names whose median grew by more than the threshold over a saved run, and by what factor."""
        with open(path) as f:
            before = {n: Timing(**t) for n, t in json.load(f).items()}
        factors = {n: t.median / before[n].median for n, t in self.timings.items() if n in before and before[n].median > 0}
        return {n: x for n, x in factors.items() if x > 1 + self.threshold}
