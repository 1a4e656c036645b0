"""Weak supervision on a bounded sample: a generative model of voters, and a linear model of its posteriors.

Both run on the driver over a sample whose size is a parameter of the operator that calls them; what they return is
small and is shipped to the tasks that score everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ABSTAIN = -1
NOISE = 0.2  # correlations within classes up to here are taken for chance


@dataclass
class LabelModel:
    """Vote probabilities by class and voter (votes 0, 1, abstain), class prior, and weights against double counting."""

    emit: np.ndarray  # class, voter, vote
    prior: float
    weight: np.ndarray
    silence: bool = True  # whether abstaining is evidence, too

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of votes."""
        v = np.where(votes == ABSTAIN, 2, votes)
        each = np.log(self.emit)
        if not self.silence:
            each[:, :, 2] = 0
        total = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for j in range(v.shape[1]):
            total += self.weight[j] * (each[1, j] - each[0, j])[v[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 30, smoothing: float = 1.0, correlated: bool = False, known: dict[int, float] | None = None, silence: bool = True) -> LabelModel:
    """Expectation-maximisation of voters' accuracies; votes are 0, 1 or ABSTAIN.

    ``smoothing`` rows of every class stand for the belief that voters are better than chance; they matter in small samples.
    The start is the majority vote, rows without votes at the prior. Voters in ``known`` keep the accuracy given there, and
    if there are any, the start is theirs alone. With ``correlated``, voters that agree within a class
    beyond chance share their weight: each counts 1 / (1 + sum of its positive correlations) in the posterior. Without
    ``silence``, abstaining is no evidence: right for voters of which a row of their class moves only a few.
    """
    n, m = votes.shape
    first = votes[:, list(known)] if known else votes
    yes, no = (first == 1).sum(1), (first == 0).sum(1)
    p = np.where(yes + no > 0, (yes + prior) / (yes + no + 1), prior).astype(float)
    model = LabelModel(np.full((2, m, 3), 1 / 3), prior, np.ones(m), silence)
    shown = [(votes == k).astype(float) for k in (0, 1)]
    for _ in range(rounds):
        for c, q in enumerate((1 - p, p)):
            some = q.sum() + 4 * smoothing
            for k in (0, 1):
                model.emit[c, :, k] = (q @ shown[k] + (smoothing if k == c else smoothing / 50)) / some
            model.emit[c, :, 2] = 1 - model.emit[c, :, 0] - model.emit[c, :, 1]
        for j, accuracy in (known or {}).items():
            model.emit[0, j], model.emit[1, j] = (accuracy, 1 - accuracy, 1.0), (1 - accuracy, accuracy, 1.0)
        model.prior = float(np.clip(p.mean(), 1e-3, 1 - 1e-3))
        if correlated:
            cast, pooled = shown[1] - shown[0], np.zeros((m, m))
            for q in (1 - p, p):
                centred = (cast - q @ cast / max(q.sum(), 1e-9)) * np.sqrt(q)[:, None]
                pooled += centred.T @ centred
            sd = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
            shared = pooled / sd[:, None] / sd
            np.fill_diagonal(shared, 0)
            for j in known or {}:
                shared[j], shared[:, j] = 0, 0
            model.weight = 1 / (1 + np.where(shared > NOISE, shared, 0).sum(1))
        before, p = p, model.posterior(votes)
        if np.abs(before - p).max() < 1e-5:
            break
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 400, rate: float = 0.5, intercept: float | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: weights and intercept (fitted unless given). Deterministic.

    Products are taken in the type of ``x``: with two types the whole matrix would be converted in every round.
    """
    n, d = x.shape
    w, b = np.zeros(d), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if intercept is None else intercept
    first, second, b1, b2 = np.zeros(d + 1), np.zeros(d + 1), 0.9, 0.999
    for t in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-np.clip((x @ w.astype(x.dtype)).astype(float) + b, -60, 60))) - y
        slope = np.append((error.astype(x.dtype) @ x).astype(float) / n + l2 * w, error.mean())
        first, second = b1 * first + (1 - b1) * slope, b2 * second + (1 - b2) * slope**2
        move = rate / np.sqrt(t) * (first / (1 - b1**t)) / (np.sqrt(second / (1 - b2**t)) + 1e-8)
        w, b = w - move[:-1], b - (move[-1] if intercept is None else 0)
    return w, b
