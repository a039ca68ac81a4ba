"""A linear-chain conditional random field with two states over batches of equal-sized sequences.

States are 0 (plain) and 1 (marked). A token has an emission, the log odds its features give state 1.
Ratios of state 1 to state 0 are passed along the chain, so nothing over- or underflows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Log weights of going on from one state to the other; staying plain has weight zero."""

    start: float = -2.0
    enter: float = -2.0  # 0 -> 1
    leave: float = 0.0  # 1 -> 0
    stay: float = 0.0  # 1 -> 1


def marginals(
    emission: np.ndarray,
    mask: np.ndarray,
    chain: Chain,
    first: np.ndarray | None = None,
    last: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over ``(steps, sequences)``; masked steps must come last in a sequence.

    ``first`` and ``last`` are the ratios that reach the sequences from what stands before and behind
    them; without them a sequence stands alone.

    Returns the probability of state 1 at every step, and the expected counts of going 0 -> 1 and
    1 -> 1 into it (the other two follow from these).
    """
    steps = len(emission)
    odds = np.exp(np.clip(emission, -30, 30))
    enter, leave, stay = np.exp([chain.enter, chain.leave, chain.stay])
    forward = np.empty_like(odds)
    backward = np.ones_like(odds)
    if last is not None:
        backward[-1] = last
    for t in range(steps):
        if t == 0:
            forward[t] = odds[t] * (np.exp(chain.start) if first is None else first)
        else:
            before = forward[t - 1]
            forward[t] = odds[t] * (enter + before * stay) / (1 + before * leave)
    for t in range(steps - 2, -1, -1):
        after = odds[t + 1] * backward[t + 1]
        backward[t] = np.where(mask[t + 1], (leave + stay * after) / (1 + enter * after), 1.0)
    ratio = forward * backward
    one = np.where(mask, ratio / (1 + ratio), 0.0)
    up, on = np.zeros_like(odds), np.zeros_like(odds)
    if steps > 1:
        after = odds[1:] * backward[1:]
        before = forward[:-1]
        whole = 1 + enter * after + before * leave + before * stay * after
        up[1:] = np.where(mask[1:], enter * after / whole, 0.0)
        on[1:] = np.where(mask[1:], before * stay * after / whole, 0.0)
    return one, up, on


def neighbours(
    emission: np.ndarray, mask: np.ndarray, chain: Chain, n_parts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``first`` and ``last`` for :func:`marginals` of sequences that are the parts of longer ones.

    The parts of a sequence stand side by side, ``n_parts`` of them, and all but its last are full. A part
    is a matrix of what it makes of the weights of both states; the matrices are chained part by part.
    """
    steps, n = emission.shape
    begin, own = np.array([1.0, np.exp(chain.start)]), np.ones(n)
    first = own * begin[1]
    longer = n_parts > 1
    if not longer.any():
        return first, own
    enter, leave, stay = np.exp([chain.enter, chain.leave, chain.stay])
    at = np.flatnonzero(np.repeat(longer, n_parts))
    odds = np.exp(np.clip(emission[:, at], -30, 30))
    live = mask[:, at]
    # weights of states 0 and 1, from state 0 and from state 1 before the first step
    zero = np.stack([np.ones(len(at)), np.zeros(len(at))])
    one = np.stack([np.zeros(len(at)), odds[0]])
    for t in range(1, steps):
        to_zero, to_one = zero + one * leave, odds[t] * (zero * enter + one * stay)
        whole = (to_zero + to_one).sum(axis=0)
        zero, one = np.where(live[t], to_zero / whole, zero), np.where(live[t], to_one / whole, one)
    ends = zero + one  # what a last part adds up to, from either state
    next_zero, next_one = zero + one * leave, zero * enter + one * stay
    sizes = n_parts[longer]
    heads = np.cumsum(sizes) - sizes
    before = np.repeat(begin[:, None], len(at), axis=1)
    behind = ends.copy()
    for k in range(1, int(sizes.max())):
        here = heads[sizes > k] + k
        a, b = before[:, here - 1]
        came = np.stack([next_zero[0, here - 1] * a + next_zero[1, here - 1] * b, next_one[0, here - 1] * a + next_one[1, here - 1] * b])
        before[:, here] = came / came.sum(axis=0)
        here = (heads + sizes - 1)[sizes > k] - k
        comes = next_zero[:, here] * behind[0, here + 1] + next_one[:, here] * behind[1, here + 1]
        behind[:, here] = comes / comes.sum(axis=0)
    first[at] = before[1] / before[0]
    inner = np.setdiff1d(np.arange(len(at)), heads + sizes - 1)
    c, d = behind[:, inner + 1]
    own[at[inner]] = (leave * c + stay * d) / (c + enter * d)
    return first, own


def fit(
    tokens: np.ndarray,
    mask: np.ndarray,
    tags: np.ndarray,
    features: np.ndarray,
    n_features: int,
    rounds: int = 80,
    rate: float = 0.25,
    ridge: float = 0.02,
) -> tuple[np.ndarray, Chain]:
    """Weights of features and a chain, by Adam on the conditional likelihood of ``tags``.

    ``tokens``, ``mask`` and ``tags`` are ``(steps, sequences)``; a token is a number of a row of
    ``features``, whose entries are the numbers of its features, ``n_features`` standing for none. The
    emission of a token is the sum of its features' weights.
    """
    at = n_features + 1
    theta = np.zeros(at + 4)
    theta[at:] = [-2.0, -2.0, 0.0, 0.0]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    tags = np.where(mask, tags, 0).astype(float)
    pairs = mask[1:]

    def by_feature(weights: np.ndarray) -> np.ndarray:
        by_token = np.bincount(tokens[mask], weights[mask], minlength=len(features))
        return np.bincount(features.ravel(), np.repeat(by_token, features.shape[1]), minlength=at)

    seen = np.zeros_like(theta)
    seen[:at] = by_feature(tags)
    seen[at:] = [
        tags[0].sum(),
        ((1 - tags[:-1]) * tags[1:])[pairs].sum(),
        (tags[:-1] * (1 - tags[1:]))[pairs].sum(),
        (tags[:-1] * tags[1:])[pairs].sum(),
    ]
    scale = max(tags.sum(), 1.0)
    for turn in range(1, rounds + 1):
        chain = Chain(*theta[at:])
        one, up, on = marginals(theta[features].sum(axis=1)[tokens], mask, chain)
        hoped = np.zeros_like(theta)
        hoped[:at] = by_feature(one)
        left = one[:-1][pairs].sum() - on.sum()
        hoped[at:] = [one[0].sum(), up.sum(), left, on.sum()]
        gradient = (seen - hoped) / scale - ridge * theta / scale
        gradient[n_features] = 0.0
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        step = (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
        theta += rate * step
    return theta[:n_features], Chain(*theta[at:])


def logistic(
    x: np.ndarray, y: np.ndarray, counts: np.ndarray | float = 1.0, ridge: float = 0.1, rounds: int = 50
) -> np.ndarray:
    """Weights of the columns of ``x`` and a constant, which comes first, by Newton's method.

    A row counts as often as ``counts`` says.
    """
    x = np.column_stack([np.ones(len(x)), x])
    weights = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counts * (y - p)) - penalty @ weights
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + penalty, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights
