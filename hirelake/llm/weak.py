"""Weak supervision: voters say 1, -1 or 0 (abstain); EM learns how far each can be trusted.

The table of distinct vote patterns has at most 3 ** voters rows however large the corpus is, so the
fit runs on the driver over exact counts of all rows, and the posterior is a plain column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = (1, -1, 0)
MAX_VOTERS = 9  # 3 ** 9 patterns is the most that is sent to the driver


@dataclass
class VoteModel:
    """prior: share of the positive class. rates[j][y][v]: chance that voter j says v for class y (1 or 0)."""

    prior: float
    rates: list

    def weights(self) -> tuple[float, list[dict[int, float]]]:
        base = math.log(self.prior / (1 - self.prior))
        return base, [{v: math.log(r[1][v] / r[0][v]) for v in VOTES} for r in self.rates]

    def posterior(self, votes: list[Column]) -> Column:
        base, ws = self.weights()
        terms = [F.when(c == 1, w[1]).when(c == -1, w[-1]).otherwise(w[0]) for c, w in zip(votes, ws, strict=True)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(base))))

    def score(self, votes: tuple[int, ...]) -> float:
        base, ws = self.weights()
        return 1 / (1 + math.exp(-(base + sum(w[v] for v, w in zip(votes, ws, strict=True)))))


def patterns(df: DataFrame, votes: list[str]) -> list[tuple[tuple[int, ...], int]]:
    """Exact counts of the distinct vote patterns of all rows."""
    if len(votes) > MAX_VOTERS:
        raise ValueError(f"at most {MAX_VOTERS} voters")
    rows = df.groupBy(*votes).count().collect()
    return sorted((tuple(int(r[v]) for v in votes), int(r["count"])) for r in rows)


def fit(counts: list[tuple[tuple[int, ...], int]], voters: int, prior: float = 0.8, rounds: int = 200, smooth: float = 1.0, like: VoteModel | None = None, trust: float = 20.0) -> VoteModel:
    """EM that starts by trusting every vote against. A voter never counts against its own meaning: where the estimates
    say so, its votes are taken to say nothing. Without rows the start values stand. `like` is a model whose rates and prior
    count as much as `trust` rows of each class, for groups with few rows of their own."""
    start = {1: {1: 0.6, -1: 0.1, 0: 0.3}, 0: {1: 0.2, -1: 0.5, 0: 0.3}}
    model = like or VoteModel(prior, [{y: dict(start[y]) for y in (1, 0)} for _ in range(voters)])
    total = sum(n for _, n in counts)
    if not total:
        return model
    soft = [0.1 if -1 in p else like.score(p) if like else 0.95 if 1 in p else prior for p, _ in counts]
    for _ in range(rounds):
        good = sum(n * q for (_, n), q in zip(counts, soft, strict=True))
        share = (good + trust * like.prior) / (total + trust) if like else good / total
        model = VoteModel(min(0.99, max(0.01, share)), [])
        for j in range(voters):
            mass = {y: {v: trust * like.rates[j][y][v] if like else smooth for v in VOTES} for y in (1, 0)}
            for (p, n), q in zip(counts, soft, strict=True):
                mass[1][p[j]] += n * q
                mass[0][p[j]] += n * (1 - q)
            rate = {y: {v: mass[y][v] / sum(mass[y].values()) for v in VOTES} for y in (1, 0)}
            if rate[1][1] < rate[0][1] or rate[0][-1] < rate[1][-1]:
                rate = {y: {v: (mass[1][v] + mass[0][v]) / (sum(mass[1].values()) + sum(mass[0].values())) for v in VOTES} for y in (1, 0)}
            model.rates.append(rate)
        new = [model.score(p) for p, _ in counts]
        moved = max(abs(a - b) for a, b in zip(new, soft, strict=True))
        soft = new
        if moved < 1e-7:
            break
    return model
