"""Weak supervision in DataFrame operations: rules vote or abstain, expectation-maximisation estimates their accuracies.

A vote is 1, -1 or 0 (abstains). Rows with the same votes are alike, so the votes are first
counted by pattern (at most 3 ** rules rows, whatever the input); every round is then one
aggregate over that small table, and the driver gets one row of sums per round.

`Rates` has the shares of a rule's votes in either class, estimated freely, with the classes' own shares: not to vote says something as well.
`Voters` has one accuracy per rule, of the votes that it casts, and the share of the class 1 among rows with votes. A vote weighs the log-odds of that accuracy
and abstaining says nothing, so that rows of a kind that only some rules know aren't taken for the other class.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .session import cut


@dataclass(frozen=True)
class Voters:
    """prior: share of the class 1. accuracy: of each rule, the share of its votes that are right."""

    prior: float
    accuracy: dict[str, float]

    def posterior(self) -> Column:
        start = F.lit(math.log(self.prior / (1 - self.prior)))
        return 1.0 / (1.0 + F.exp(-sum((F.col(r) * F.lit(math.log(a / (1 - a))) for r, a in self.accuracy.items()), start)))


def fit(votes: DataFrame, start: Voters, rounds: int = 60, strength: float = 20.0, most: float = 0.98, least_move: float = 1e-3) -> Voters:
    """Accuracies and prior by expectation-maximisation. Each starting value counts as `strength` rows; no rule is worse than chance or surer than `most`. Without rows: the start."""
    rules = list(start.accuracy)
    voted = F.exists(F.array(*rules), lambda v: v != 0)
    patterns = cut(votes.where(voted).groupBy(*rules).agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1), "votes")  # 3 ** rules rows at most
    now = start
    for _ in range(rounds):
        p, n = now.posterior(), F.col("n")
        total = lambda w: F.coalesce(F.sum(n * w), F.lit(0.0))
        sums = patterns.agg(
            total(p).alias("yes"), total(F.lit(1.0)).alias("rows"),
            *(total(F.when(F.col(r) > 0, p).when(F.col(r) < 0, 1 - p)).alias(f"right_{r}") for r in rules),
            *(total(F.abs(F.col(r)).cast("double")).alias(f"voted_{r}") for r in rules),
        ).first()
        found = {r: (sums[f"right_{r}"] + strength * a) / (sums[f"voted_{r}"] + strength) for r, a in start.accuracy.items()}
        prior = (sums["yes"] + strength * start.prior) / (sums["rows"] + strength)
        new = Voters(min(max(prior, 1 - most), most), {r: min(max(a, 0.5), most) for r, a in found.items()})
        moved = max(abs(new.prior - now.prior), *(abs(new.accuracy[r] - now.accuracy[r]) for r in rules))
        now = new
        if moved < least_move:
            break
    return now


@dataclass(frozen=True)
class Rates:
    """prior: share of the class 1. rates: of each rule the shares of its votes (against, none, for) in rows of class 1, and in the others.

    Nothing is assumed of a rule but where the estimate starts: that it seldom votes is told by its rates as well.
    """

    prior: float
    rates: dict[str, tuple[tuple[float, float, float], tuple[float, float, float]]]

    def log_odds(self, vote: Callable[[str], Column] = F.col) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, (yes, no) in self.rates.items():
            against, none, for_ = (math.log(a / b) for a, b in zip(yes, no))
            total += F.when(vote(rule) < 0, against).when(vote(rule) > 0, for_).otherwise(none)
        return total

    def posterior(self, vote: Callable[[str], Column] = F.col) -> Column:
        return 1.0 / (1.0 + F.exp(-self.log_odds(vote)))


def fit_rates(votes: DataFrame, start: Rates, rounds: int = 60, strength: float = 20.0, least_move: float = 1e-3) -> Rates:
    """Rates and prior by expectation-maximisation. Each starting value counts as `strength` rows. Without rows: the start."""
    rules = list(start.rates)
    patterns = cut(votes.groupBy(*rules).agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1), "votes")  # 3 ** rules rows at most
    now = start
    for _ in range(rounds):
        told = patterns.select("n", now.posterior().alias("p"), F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).cast("int").alias("vote")) for r in rules))).alias("of"))
        found = told.groupBy("of.rule", "of.vote").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()  # three rows a rule
        sums = {(r["rule"], r["vote"]): (r["yes"], r["no"]) for r in found}
        total = [sum(sums.get((rules[0], v), (0.0, 0.0))[k] for v in (-1, 0, 1)) for k in (0, 1)]
        share = lambda r, k: tuple((sums.get((r, v), (0.0, 0.0))[k] + strength * start.rates[r][k][v + 1]) / (total[k] + strength) for v in (-1, 0, 1))
        new = Rates((total[0] + strength * start.prior) / (sum(total) + strength), {r: (share(r, 0), share(r, 1)) for r in rules})
        moved = max(abs(a - b) for r in rules for x, y in zip(new.rates[r], now.rates[r]) for a, b in zip(x, y))
        now = new
        if moved < least_move:
            break
    return now
