"""A bidirectional gated recurrent network with attention pooling, in numpy.

Windows of word numbers go in; ``inputs`` holds a row for each word and a last row that stands for
padding. A window's logit is the mean of a linear reading of the states, weighted by attention.
"""

from __future__ import annotations

import numpy as np

PAD_GATE = 30.0  # keeps the state unchanged at padding


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def new_network(n_in: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    net = {}
    for side in ("f", "b"):
        net |= {f"W{side}": scale(n_in, 3 * hidden), f"U{side}": scale(hidden, 3 * hidden), f"c{side}": np.zeros(3 * hidden, np.float32)}
    return net | {"v": scale(2 * hidden), "w": scale(2 * hidden), "b": np.zeros(1, np.float32)}


def projected(net: dict, inputs: np.ndarray, side: str) -> np.ndarray:
    """The input part of the gates of each word; computed once, however often the word occurs."""
    hidden = len(net[f"U{side}"])
    gates = inputs @ net[f"W{side}"] + net[f"c{side}"]
    gates[-1] = 0
    gates[-1, :hidden] = PAD_GATE
    return gates.astype(np.float32)


def _states(net: dict, gates: np.ndarray, windows: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
    n, length = windows.shape
    recurrent = net[f"U{side}"]
    hidden = len(recurrent)
    state = np.zeros((n, hidden), np.float32)
    out = np.empty((length, n, hidden), np.float32)
    for t in range(length) if side == "f" else range(length - 1, -1, -1):
        x = gates[windows[:, t]]
        own = state @ recurrent
        zr = _sigmoid(x[:, : 2 * hidden] + own[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        new = np.tanh(x[:, 2 * hidden :] + r * own[:, 2 * hidden :])
        if keep is not None:
            keep.append((t, state, z, r, own[:, 2 * hidden :], new))
        state = new + z * (state - new)
        out[t] = state
    return out


def _pool(net: dict, states: np.ndarray, pad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    attention, reading = states @ net["v"], states @ net["w"]
    attention = np.where(pad, np.float32(-1e9), attention)
    attention = np.exp(attention - attention.max(axis=0))
    attention /= attention.sum(axis=0)
    return attention, reading, (attention * reading).sum(axis=0) + net["b"][0]


def logits(net: dict, gates: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """The logit of each window; ``gates`` are the projected inputs of both sides."""
    states = np.concatenate([_states(net, gates[s], windows, s) for s in ("f", "b")], axis=2)
    return _pool(net, states, (windows == len(gates["f"]) - 1).T)[2]


def gradients(net: dict, inputs: np.ndarray, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """(mean log loss, gradient of each weight, gradient of ``inputs``) over labelled windows."""
    n = len(windows)
    pad = (windows == len(inputs) - 1).T
    gates, kept, sides = {}, {"f": [], "b": []}, []
    for s in ("f", "b"):
        gates[s] = projected(net, inputs, s)
        sides.append(_states(net, gates[s], windows, s, kept[s]))
    states = np.concatenate(sides, axis=2)
    attention, reading, logit = _pool(net, states, pad)
    p = _sigmoid(logit)
    loss = float(-np.mean(labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7)))
    d = ((p - labels) / n).astype(np.float32)
    d_reading = attention * d
    d_attention = attention * (reading * d - (attention * reading * d).sum(axis=0))
    grads = {
        "b": np.array([d.sum()], np.float32),
        "w": np.einsum("tb,tbh->h", d_reading, states),
        "v": np.einsum("tb,tbh->h", d_attention, states),
    }
    d_states = d_reading[:, :, None] * net["w"] + d_attention[:, :, None] * net["v"]
    d_inputs = np.zeros_like(inputs)
    for k, s in enumerate(("f", "b")):
        recurrent = net[f"U{s}"]
        hidden = len(recurrent)
        d_gates, d_u = np.zeros_like(gates[s]), np.zeros_like(recurrent)
        d_state = np.zeros((n, hidden), np.float32)
        for t, before, z, r, own, new in reversed(kept[s]):
            d_state = d_state + d_states[t, :, k * hidden : (k + 1) * hidden]
            d_new = d_state * (1 - z) * (1 - new**2)
            d_z = d_state * (before - new) * z * (1 - z)
            d_r = d_new * own * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(d_gates, windows[:, t], d_x)
            d_u += before.T @ d_own
            d_state = d_state * z + d_own @ recurrent.T
        d_gates[-1] = 0
        grads |= {f"U{s}": d_u, f"W{s}": inputs.T @ d_gates, f"c{s}": d_gates.sum(axis=0)}
        d_inputs += d_gates @ net[f"W{s}"].T
    return loss, grads, d_inputs


class Adam:
    def __init__(self, net: dict, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.first = {k: np.zeros_like(x) for k, x in net.items()}
        self.second = {k: np.zeros_like(x) for k, x in net.items()}

    def update(self, grads: dict) -> None:
        self.step += 1
        for k, g in grads.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.99 * self.second[k] + 0.01 * g**2
            m, v = self.first[k] / (1 - 0.9**self.step), self.second[k] / (1 - 0.99**self.step)
            self.net[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
