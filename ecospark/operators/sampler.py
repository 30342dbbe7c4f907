"""Adaptive choice of parameters from past trials.

After a few random draws, past trials are split into good ones (the best quarter) and the rest. Each parameter gets a
density of either group: Gaussian bumps at the trials on a scale from 0 to 1 (logarithmic where the space says so) over a
uniform floor, or smoothed counts for choices. Candidates are drawn from the good density and the one with the largest ratio
good / rest is proposed. A round proposes a whole batch, so its trials can run side by side; a proposal counts among
the rest while the batch is filled, which keeps it from being proposed again. Everything follows from the seed.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

#: candidates per proposal, share of trials that count as good, weight of the uniform floor in trials
CANDIDATES, GOOD, FLOOR = 32, 0.25, 1.0

Space = dict[str, tuple]


def _to_unit(spec: tuple, value) -> float:
    kind, low, high = spec
    if kind == "log":
        low, high, value = math.log(low), math.log(high), math.log(value)
    return (value - low) / (high - low) if high > low else 0.5


def _from_unit(spec: tuple, u: float):
    kind, low, high = spec
    if kind == "log":
        return min(high, max(low, math.exp(math.log(low) + u * (math.log(high) - math.log(low)))))
    value = low + u * (high - low)
    return min(high, max(low, round(value))) if kind == "int" else value


class _Density:
    """Of one parameter over some trials."""

    def __init__(self, spec: tuple, values: Sequence):
        self.spec, self.choice = spec, spec[0] == "choice"
        if self.choice:
            self.weight = {repr(v): FLOOR / len(spec[1]) for v in spec[1]}
            for v in values:
                self.weight[repr(v)] += 1
        else:
            self.centres = sorted(_to_unit(spec, v) for v in values)
            self.width = max(0.03, 1.0 / (1 + len(self.centres)))

    def draw(self, rng: random.Random):
        if self.choice:
            return rng.choices(self.spec[1], [self.weight[repr(v)] for v in self.spec[1]])[0]
        if rng.random() * (len(self.centres) + FLOOR) < FLOOR:
            return _from_unit(self.spec, rng.random())
        u = rng.gauss(rng.choice(self.centres), self.width)
        return _from_unit(self.spec, min(1.0, max(0.0, u)))

    def log(self, value) -> float:
        if self.choice:
            return math.log(self.weight[repr(value)] / sum(self.weight.values()))
        u = _to_unit(self.spec, value)
        bumps = sum(math.exp(-0.5 * ((u - m) / self.width) ** 2) for m in self.centres) / (self.width * math.sqrt(2 * math.pi))
        return math.log((FLOOR + bumps) / (len(self.centres) + FLOOR))


def draw(space: Space, rng: random.Random) -> dict:
    """One uniform draw: ('int', lo, hi), ('float', lo, hi), ('log', lo, hi) or ('choice', [...])."""
    return {n: rng.choice(s[1]) if s[0] == "choice" else _from_unit(s, rng.random()) for n, s in space.items()}


def propose(space: Space, trials: Sequence[tuple[dict, float]], k: int, startup: int, rng: random.Random) -> list[dict]:
    """``k`` parameter sets to try next, given past ``trials`` (parameters, loss)."""
    out: list[dict] = []
    ranked = [p for p, _ in sorted(trials, key=lambda t: t[1])]
    n_good = max(2, math.ceil(GOOD * len(ranked)))
    for _ in range(k):
        if len(trials) + len(out) < startup or len(ranked) < 3:
            out.append(draw(space, rng))
            continue
        good = {n: _Density(s, [p[n] for p in ranked[:n_good]]) for n, s in space.items()}
        rest = {n: _Density(s, [p[n] for p in [*ranked[n_good:], *out]]) for n, s in space.items()}
        candidates = [{n: good[n].draw(rng) for n in space} for _ in range(CANDIDATES)]
        out.append(max(candidates, key=lambda p: sum(good[n].log(p[n]) - rest[n].log(p[n]) for n in space)))
    return out


def search(evaluate: Callable[[list[dict]], list[float]], space: Space, n: int = 20, batch: int = 4, startup: int = 8, seed: int = 42) -> list[tuple[dict, float]]:
    """``n`` trials in rounds of ``batch``: ``evaluate`` maps a batch of parameter sets to losses (lower is better)."""
    rng, trials = random.Random(seed), []
    while len(trials) < n:
        asked = propose(space, trials, min(batch, n - len(trials)), startup, rng)
        trials += list(zip(asked, evaluate(asked), strict=True))
    return trials
