"""Small driver-side helpers: a timer, seeds, a logger, running means and chained transforms."""

from __future__ import annotations

import logging
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame


class Timer:
    """Seconds since the start and since the last look; a context manager too."""

    def __init__(self) -> None:
        self.begin = self.last = time.perf_counter()

    def __enter__(self) -> Timer:
        self.__init__()
        return self

    def __exit__(self, *_: object) -> None:
        self.last = time.perf_counter()

    def since_start(self) -> float:
        self.last = time.perf_counter()
        return self.last - self.begin

    def since_last(self) -> float:
        before, self.last = self.last, time.perf_counter()
        return self.last - before


def seed_everything(seed: int = 26) -> np.random.Generator:
    random.seed(seed)
    np.random.seed(seed)
    return np.random.default_rng(seed)


def logger(name: str = "trajecta", path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger with one handler per target, however often it is asked for."""
    log = logging.getLogger(name)
    log.setLevel(level)
    targets = {getattr(h, "baseFilename", "") for h in log.handlers}
    for h in ([logging.StreamHandler()] if "" not in targets else []) + ([logging.FileHandler(path)] if path and path not in targets else []):
        h.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log


@dataclass
class Meters:
    """Running weighted means by name."""

    sums: dict[str, float] = field(default_factory=dict)
    counts: dict[str, float] = field(default_factory=dict)

    def add(self, values: dict[str, float], n: float = 1) -> None:
        for k, v in values.items():
            self.sums[k] = self.sums.get(k, 0.0) + v * n
            self.counts[k] = self.counts.get(k, 0.0) + n

    def mean(self, name: str) -> float:
        return self.sums[name] / self.counts[name] if self.counts.get(name) else 0.0

    def reset(self) -> None:
        self.sums.clear()
        self.counts.clear()


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: reduce(lambda d, f: d.transform(f), steps, df)
