"""Sequential model-based search of parameters (M5): tree-structured Parzen estimators.

After ``startup`` random trials, the finished trials are parted into the better ones and the
rest.  For each parameter two densities are estimated, one from either part; candidates are
drawn from the better ones' density, and the one with the greatest ratio of both is tried
next.  A density is a mixture of the prior over the range and a normal distribution around
each trial's value, cut off at the range's ends, with the distance to its neighbours as width
(numbers), or smoothed counts (choices).

Trials run in rounds of ``in_flight``: the proposals of a round are made one after the other,
each taking those before it for poor trials, so they keep apart.  All depends on the seed and
on the results only, not on which trial ends first.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from typing import Callable, Mapping, Sequence


@dataclass(frozen=True)
class Number:
    """A number between ``low`` and ``high``, both included; ``log``: evenly spread on a log scale."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    def bounds(self) -> tuple[float, float]:
        half = 0.5 if self.whole and not self.log else 0.0
        return self.inner(self.low) - half, self.inner(self.high) + half

    def outer(self, x: float) -> float | int:
        value = math.exp(x) if self.log else x
        return min(max(round(value), int(self.low)), int(self.high)) if self.whole else min(max(value, self.low), self.high)

    def draw(self, rng: random.Random):
        return self.outer(rng.uniform(*self.bounds()))


@dataclass(frozen=True)
class Choice:
    options: tuple

    def draw(self, rng: random.Random):
        return self.options[rng.randrange(len(self.options))]


#: A parameter that exists only where another one is large enough: (name of the other, least value).
Space = Mapping[str, "Number | Choice"]
Needs = Mapping[str, tuple[str, float]]


def active(space: Space, needs: Needs, params: Mapping) -> dict:
    """The parameters without those whose condition doesn't hold."""
    return {n: v for n, v in params.items() if n not in needs or params.get(needs[n][0], -math.inf) >= needs[n][1]}


def random_draw(space: Space, needs: Needs, rng: random.Random) -> dict:
    return active(space, needs, {n: d.draw(rng) for n, d in space.items()})


def _normal_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


class _Kernels:
    """Mixture over a number's range: the prior and one cut-off normal per value."""

    def __init__(self, domain: Number, values: Sequence):
        self.low, self.high = domain.bounds()
        span = self.high - self.low
        points = sorted(domain.inner(v) for v in values)
        # the prior is a wide normal in the middle of the range
        self.centres = [(self.low + self.high) / 2, *points]
        self.widths = [max(span, 1e-12)]
        least = span / min(100.0, 1.0 + len(points))
        for i, x in enumerate(points):
            left = x - (points[i - 1] if i else self.low)
            right = (points[i + 1] if i + 1 < len(points) else self.high) - x
            self.widths.append(min(max(left, right, least, 1e-12), max(span, 1e-12)))
        self.mass = [_normal_cdf((self.high - c) / w) - _normal_cdf((self.low - c) / w) for c, w in zip(self.centres, self.widths, strict=True)]

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.centres))
        for _ in range(1000):
            x = rng.gauss(self.centres[i], self.widths[i])
            if self.low <= x <= self.high:
                return x
        return min(max(self.centres[i], self.low), self.high)

    def log_density(self, x: float) -> float:
        total = 0.0
        for c, w, m in zip(self.centres, self.widths, self.mass, strict=True):
            total += math.exp(-0.5 * ((x - c) / w) ** 2) / (w * max(m, 1e-12))
        return math.log(max(total / len(self.centres), 1e-300))


class _Counts:
    def __init__(self, domain: Choice, values: Sequence):
        n = len(domain.options)
        self.weights = [(1.0 + sum(v == o for v in values)) / (n + len(values)) for o in domain.options]

    def draw(self, rng: random.Random) -> int:
        return rng.choices(range(len(self.weights)), self.weights)[0]


def propose(space: Space, needs: Needs, better: Sequence[Mapping], rest: Sequence[Mapping], rng: random.Random, candidates: int) -> dict:
    """The next trial, parameter by parameter."""
    out: dict = {}
    for name, domain in space.items():
        if name in needs and out.get(needs[name][0], -math.inf) < needs[name][1]:
            continue
        good, poor = ([t[name] for t in part if name in t] for part in (better, rest))
        if isinstance(domain, Choice):
            a, b = _Counts(domain, good), _Counts(domain, poor)
            drawn = [a.draw(rng) for _ in range(candidates)]
            out[name] = domain.options[max(drawn, key=lambda i: (math.log(a.weights[i] / b.weights[i]), -i))]
        else:
            a, b = _Kernels(domain, good), _Kernels(domain, poor)
            drawn = [a.draw(rng) for _ in range(candidates)]
            out[name] = domain.outer(max(drawn, key=lambda x: (a.log_density(x) - b.log_density(x), -x)))
    return out


@dataclass
class Trial:
    number: int
    params: dict
    value: float | None
    error: str | None = None


def search(space: Space, run: Callable[[list[dict]], list[float | Exception]], n_trials: int, seed: int = 42, needs: Needs | None = None,
           startup: int = 10, candidates: int = 24, in_flight: int = 4, share: float = 0.1) -> list[Trial]:
    """All trials, in order.  ``run`` takes the parameters of a round and gives their values (more is better); a trial
    that gives an exception or NaN counts as poor and has no value."""
    needs = needs or {}
    rng = random.Random(seed)
    trials: list[Trial] = []
    while len(trials) < n_trials:
        pending: list[dict] = []
        for _ in range(min(in_flight, n_trials - len(trials))):
            if len(trials) + len(pending) < startup:
                pending.append(random_draw(space, needs, rng))
                continue
            done = sorted((t for t in trials if t.value is not None), key=lambda t: (-t.value, t.number))
            n = min(math.ceil(share * (len(done) or 1)), 25) + (1 if len(done) > 1 else 0)
            poor = [t.params for t in done[n:]] + [t.params for t in trials if t.value is None] + pending
            pending.append(propose(space, needs, [t.params for t in done[:n]], poor, rng, candidates))
        for params, value in zip(pending, run(pending), strict=True):
            bad = isinstance(value, Exception) or value is None or value != value
            trials.append(Trial(len(trials), params, None if bad else float(value), str(value) if bad else None))
    return trials


def best_trial(trials: Sequence[Trial]) -> Trial:
    done = [t for t in trials if t.value is not None]
    if not done:
        raise ValueError("no trial gave a value: " + "; ".join(sorted({t.error or "" for t in trials})))
    return max(done, key=lambda t: (t.value, -t.number))
