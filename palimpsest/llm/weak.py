"""Weak supervision without labels: labelers vote 1, 0 or abstain; expectation-maximisation estimates how reliable each is.

Model: a hidden binary class with prior p; a labeler that votes is right with probability a1 where the class is 1 and a0 where it
is 0, independently of the others; whether it votes says nothing. The corpus reaches the driver as counts of vote patterns, of
which there are at most 3 ** labelers, however many rows there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSTAIN = -1


@dataclass(frozen=True)
class Model:
    bias: float
    #: log-odds that a vote of 1 and a vote of 0 add, by labeler
    weights: tuple[tuple[float, float], ...]
    prior: float
    accuracies: tuple[tuple[float, float], ...]

    def log_odds(self, votes: list[int]) -> float:
        return self.bias + sum(w[0] if v == 1 else w[1] if v == 0 else 0.0 for v, w in zip(votes, self.weights, strict=True))

    def posterior(self, votes: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.log_odds(votes)))))

    def log_odds_column(self, votes: list[Column]) -> Column:
        """The same for columns; terms in fixed order, so the result does not depend on the plan."""
        out = F.lit(self.bias)
        for v, (one, zero) in zip(votes, self.weights, strict=True):
            out = out + F.when(v == 1, F.lit(one)).when(v == 0, F.lit(zero)).otherwise(F.lit(0.0))
        return out


def fit(counts: list[tuple[tuple[int, ...], int]], n_labelers: int, prior: float = 0.5, start: tuple[float, float] = (0.8, 0.8), rounds: int = 60, low: float = 0.02, high: float = 0.999) -> Model:
    """EM over (votes, count). ``start`` is (a1, a0) of every labeler at first and weighs as ten votes later on.

    Estimates stay in [low, high] and a1 + a0 at 1.05 or more: a labeler may be nearly silent about a class but never turned round.
    Without rows, or for a labeler that never votes, the starting values hold.
    """
    counts = sorted(counts)
    total = sum(n for _, n in counts)
    acc = [start] * n_labelers
    p = prior
    model = _model(p, acc)
    for _ in range(rounds):
        if not total:
            break
        post = [model.posterior(list(v)) for v, _ in counts]
        new = []
        for j in range(n_labelers):
            right, every = [0.0, 0.0], [0.0, 0.0]
            for (v, n), q in zip(counts, post, strict=True):
                if v[j] != ABSTAIN:
                    for k, share in ((1, q), (0, 1 - q)):
                        every[k] += n * share
                        right[k] += n * share * (v[j] == k)
            a1, a0 = (min(high, max(low, (right[k] + 10 * start[1 - k]) / (every[k] + 10))) for k in (1, 0))
            new.append((a1, max(a0, 1.05 - a1)))
        p = min(0.99, max(0.01, sum(n * q for (_, n), q in zip(counts, post, strict=True)) / total))
        acc, model = new, _model(p, new)
    return model


def _model(p: float, acc: list[tuple[float, float]]) -> Model:
    weights = tuple((math.log(a1 / (1 - a0)), math.log((1 - a1) / a0)) for a1, a0 in acc)
    return Model(math.log(p / (1 - p)), weights, p, tuple(acc))
