"""A bidirectional gated recurrent network over bytes that labels every position."""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]


def new_weights(classes: int, hidden: int = 16, width: int = 8, seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    weights = {"bytes": (rng.standard_normal((256, width)) * 0.5).astype(np.float32)}
    for way in "fb":
        weights |= {f"w{way}": draw(width, 3 * hidden), f"u{way}": draw(hidden, 3 * hidden)}
        weights[f"a{way}"] = np.zeros(3 * hidden, np.float32)
    return weights | {"out": draw(2 * hidden, classes), "bias": np.zeros(classes, np.float32)}


def packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as ``(steps, words)`` of bytes, the same from their ends, and where bytes are."""
    sizes = np.array([len(w) for w in words])
    steps = int(sizes.max(initial=0))
    forth = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in words), np.uint8).reshape(-1, steps).T
    back = np.frombuffer(b"".join(w[::-1].ljust(steps, b"\0") for w in words), np.uint8).reshape(-1, steps).T
    return forth, back, np.arange(steps)[:, None] < sizes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _run(weights: Weights, way: str, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states after every step; ``keep`` takes what the way back needs."""
    u = weights[f"u{way}"]
    hidden = len(u)
    inputs = weights["bytes"] @ weights[f"w{way}"] + weights[f"a{way}"]  # one row for each byte
    state = np.zeros((steps.shape[1], hidden), np.float32)
    out = np.empty((*steps.shape, hidden), np.float32)
    for t, now in enumerate(steps):
        given, own = inputs[now], state @ u
        gates = _sigmoid(given[:, : 2 * hidden] + own[:, : 2 * hidden])
        reset, update = gates[:, :hidden], gates[:, hidden:]
        new = np.tanh(given[:, 2 * hidden :] + reset * own[:, 2 * hidden :])
        if keep is not None:
            keep.append((state, reset, update, new, own[:, 2 * hidden :]))
        state = new + update * (state - new)
        out[t] = state
    return out


def _turned(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Steps counted from a word's end as steps from its start, and the other way round."""
    sizes = mask.sum(axis=0)
    at = sizes[None, :] - 1 - np.arange(len(mask))[:, None]
    return states[np.where(at >= 0, at, 0), np.arange(mask.shape[1])[None, :]] * mask[:, :, None]


def labelled(weights: Weights, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities ``(steps, words, classes)`` of every byte, and where bytes are."""
    forth, back, mask = packed(words)
    states = np.concatenate(
        [_run(weights, "f", forth), _turned(_run(weights, "b", back), mask)], axis=2
    )
    return _softmax(states @ weights["out"] + weights["bias"]), mask


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _through_time(weights: Weights, way: str, steps: np.ndarray, kept: list, given: np.ndarray) -> Weights:
    """Gradients of one direction from the gradients of its states."""
    u = weights[f"u{way}"]
    hidden = len(u)
    to_inputs = np.zeros((256, 3 * hidden), np.float32)
    to_u = np.zeros_like(u)
    carry = np.zeros_like(given[0])
    for t in range(len(steps) - 1, -1, -1):
        state, reset, update, new, own = kept[t]
        grad = given[t] + carry
        to_new = grad * (1 - update) * (1 - new**2)
        to_update = grad * (state - new) * update * (1 - update)
        to_reset = to_new * own * reset * (1 - reset)
        to_own = np.concatenate([to_reset, to_update, to_new * reset], axis=1)
        to_u += state.T @ to_own
        np.add.at(to_inputs, steps[t], np.concatenate([to_reset, to_update, to_new], axis=1))
        carry = grad * update + to_own @ u.T
    return {
        f"u{way}": to_u,
        f"a{way}": to_inputs.sum(axis=0),
        f"w{way}": weights["bytes"].T @ to_inputs,
        "bytes": to_inputs @ weights[f"w{way}"].T,
    }


def gradients(
    weights: Weights, words: list[bytes], classes: np.ndarray, importance: np.ndarray
) -> tuple[float, Weights]:
    """Mean cross-entropy over positions, weighted by word, and its gradients."""
    forth, back, mask = packed(words)
    kept_forth, kept_back = [], []
    states = np.concatenate(
        [
            _run(weights, "f", forth, kept_forth),
            _turned(_run(weights, "b", back, kept_back), mask),
        ],
        axis=2,
    )
    p = _softmax(states @ weights["out"] + weights["bias"])
    share = (mask * importance).astype(np.float32)
    share /= share.sum()
    at = (np.arange(len(mask))[:, None], np.arange(len(words))[None, :], classes[None, :])
    loss = float(-(share * np.log(p[at] + 1e-9)).sum())
    p[at] -= 1
    p *= share[:, :, None]
    found = {"out": np.einsum("twh,twc->hc", states, p), "bias": p.sum(axis=(0, 1))}
    to_states = p @ weights["out"].T
    hidden = to_states.shape[2] // 2
    one = _through_time(weights, "f", forth, kept_forth, to_states[:, :, :hidden])
    two = _through_time(weights, "b", back, kept_back, _turned(to_states[:, :, hidden:], mask))
    return loss, found | one | two | {"bytes": one["bytes"] + two["bytes"]}


def train(
    words: list[bytes],
    classes: np.ndarray,
    importance: np.ndarray,
    n_classes: int,
    turns: int = 400,
    batch: int = 256,
    rate: float = 0.01,
    seed: int = 7,
    **shape: int,
) -> Weights:
    """Weights by ``turns`` steps of Adam on shuffled batches; the same for the same words."""
    weights = new_weights(n_classes, seed=seed, **shape)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    rng = np.random.default_rng(seed)
    order = np.zeros(0, int)
    for turn in range(1, turns + 1):
        if not len(order):
            order = rng.permutation(len(words))
        mine, order = order[:batch], order[batch:]
        found = gradients(weights, [words[i] for i in mine], classes[mine], importance[mine])[1]
        pace = rate * (1 - 0.9 * turn / turns)
        for k, g in found.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            weights[k] -= pace * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
    return weights
