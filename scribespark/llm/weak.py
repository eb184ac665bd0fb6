"""Weak supervision: voters that say yes, no or nothing, and how far each can be trusted.

Expectation-maximisation works on the histogram of vote patterns, which has at most 3 to the power of
the number of voters rows a kind however large the corpus is. Votes are -1, 0 (abstains) and 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

#: A voter is never taken for worse than a guess nor for infallible.
LEAST, MOST = 0.6, 0.995


@dataclass
class Model:
    """Share of yes, and each voter's accuracy among its votes on yes items and on no items."""

    prior: float
    on_yes: list[float]
    on_no: list[float]

    def posterior(self, votes: tuple[int, ...]) -> float:
        """Probability of yes, given the votes; abstentions say nothing."""
        logit = math.log(self.prior / (1 - self.prior))
        for v, yes, no in zip(votes, self.on_yes, self.on_no):
            if v:
                logit += math.log(yes / (1 - no)) if v > 0 else math.log((1 - yes) / no)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, logit))))


def estimate(patterns: dict[tuple[int, ...], int], voters: int, prior: float = 0.8, accuracy: float = 0.85, rounds: int = 50) -> Model:
    """EM over vote patterns with their counts; an empty histogram gives the starting values.

    Each accuracy starts from ``accuracy`` with the weight of ten votes, so a voter that hardly votes
    stays near it, and is kept within LEAST..MOST: a vote never counts against its own side.
    """
    model = Model(prior, [accuracy] * voters, [accuracy] * voters)
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        yes_sum = 0.0
        hit = [[10 * accuracy, 10 * accuracy] for _ in range(voters)]
        seen = [[10.0, 10.0] for _ in range(voters)]
        for votes, n in patterns.items():
            p = model.posterior(votes)
            yes_sum += n * p
            for j, v in enumerate(votes):
                if v:
                    seen[j][0] += n * p
                    seen[j][1] += n * (1 - p)
                    hit[j][0 if v > 0 else 1] += n * (p if v > 0 else 1 - p)
        bound = lambda x: min(MOST, max(LEAST, x))
        model = Model(
            min(0.99, max(0.01, (yes_sum + 10 * prior) / (total + 10))),
            [bound(h[0] / s[0]) for h, s in zip(hit, seen)],
            [bound(h[1] / s[1]) for h, s in zip(hit, seen)],
        )
    return model


def logistic(rows: list[tuple[list[float], float, float]], width: int, ridge: float = 1.0, rounds: int = 25) -> list[float]:
    """Weights (bias last) of a logistic regression on (features, soft label, count), by Newton's steps."""
    w = [0.0] * (width + 1)
    for _ in range(rounds):
        grad = [ridge * x for x in w[:-1]] + [0.0]
        hess = [[ridge * (i == j) + 1e-6 * (i == j) for j in range(width + 1)] for i in range(width + 1)]
        for x, label, n in rows:
            x = [*x, 1.0]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for i, a in enumerate(x):
                if a:
                    grad[i] += n * (p - label) * a
                    for j, b in enumerate(x):
                        hess[i][j] += n * max(p * (1 - p), 1e-6) * a * b
        step = _solve(hess, grad)
        w = [a - max(-2.0, min(2.0, s)) for a, s in zip(w, step)]
    return w


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    n = len(b)
    m = [row[:] + [y] for row, y in zip(a, b)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[k] = m[k], m[i]
        for r in range(n):
            if r != i and m[r][i]:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i])]
    return [m[i][n] / m[i][i] for i in range(n)]
