"""A character tagger in NumPy: bidirectional LSTM, linear layer, CRF transitions.

All arrays are (time, windows, …); windows have one length, so there are no masks.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray):
    """States of one direction and what its gradient needs."""
    steps, rows, _ = x.shape
    size = u.shape[0]
    h, c = np.zeros((steps + 1, rows, size)), np.zeros((steps + 1, rows, size))
    gates = x @ w + b
    for t in range(steps):
        g = gates[t]
        g += h[t] @ u
        g[:, :3 * size] = _sigmoid(g[:, :3 * size])
        g[:, 3 * size:] = np.tanh(g[:, 3 * size:])
        i, f, o, n = (g[:, k * size:(k + 1) * size] for k in range(4))
        c[t + 1] = f * c[t] + i * n
        h[t + 1] = o * np.tanh(c[t + 1])
    return h, c, gates


def _lstm_back(slope, x, w, u, h, c, gates):
    """Gradients of (w, u, b, x) from the gradient of the states."""
    steps, size = len(x), u.shape[0]
    raw = np.zeros_like(gates)
    dh, dc = np.zeros_like(h[0]), np.zeros_like(h[0])
    for t in range(steps - 1, -1, -1):
        i, f, o, n = (gates[t][:, k * size:(k + 1) * size] for k in range(4))
        dh = dh + slope[t]
        squashed = np.tanh(c[t + 1])
        dc = dc + dh * o * (1 - squashed**2)
        raw[t] = np.concatenate([dc * n * i * (1 - i), dc * c[t] * f * (1 - f),
                                 dh * squashed * o * (1 - o), dc * i * (1 - n**2)], 1)
        dh, dc = raw[t] @ u.T, dc * f
    flat = raw.reshape(-1, raw.shape[2])
    return (x.reshape(-1, x.shape[2]).T @ flat, h[:-1].reshape(-1, size).T @ flat,
            flat.sum(0), raw @ w.T)


class CharTagger:
    """Tags of every character of fixed-length windows."""

    def __init__(self, symbols: int, tags: int, embed: int, hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)

        def matrix(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.p = {"embed": matrix(symbols, embed), "out": matrix(2 * hidden, tags), "bias": np.zeros(tags),
                  "move": np.zeros((tags, tags)), "first": np.zeros(tags)}
        for way in ("f", "b"):
            self.p |= {f"w{way}": matrix(embed, 4 * hidden), f"u{way}": matrix(hidden, 4 * hidden),
                       f"b{way}": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}

    def _forward(self, windows: np.ndarray):
        p, x = self.p, self.p["embed"][windows.T]
        ahead = _lstm(x, p["wf"], p["uf"], p["bf"])
        back = _lstm(x[::-1], p["wb"], p["ub"], p["bb"])
        states = np.concatenate([ahead[0][1:], back[0][1:][::-1]], 2)
        return x, ahead, back, states, states @ p["out"] + p["bias"]

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        """(time, windows, tags) scores of windows of symbol numbers."""
        return self._forward(windows)[-1]

    def decode(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of every window (windows, time), and the emissions."""
        e, move = self.emissions(windows), self.p["move"]
        best, come = self.p["first"] + e[0], []
        for t in range(1, len(e)):
            paths = best[:, :, None] + move
            come.append(paths.argmax(1))
            best = paths.max(1) + e[t]
        tags = [best.argmax(1)]
        for back in reversed(come):
            tags.append(back[np.arange(len(windows)), tags[-1]])
        return np.stack(tags[::-1], 1), e

    def _crf(self, e: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood and its gradients by emissions, transitions, first tags."""
        steps, rows, kinds = e.shape
        move, first = self.p["move"], self.p["first"]
        ahead, back = np.zeros_like(e), np.zeros_like(e)
        ahead[0] = first + e[0]
        for t in range(1, steps):
            ahead[t] = _logsum(ahead[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            back[t] = _logsum(move + (e[t + 1] + back[t + 1])[:, None, :], 2)
        whole = _logsum(ahead[-1], 1)
        slope = np.exp(ahead + back - whole[:, None])
        pairs = np.exp(ahead[:-1, :, :, None] + move + (e[1:] + back[1:])[:, :, None, :]
                       - whole[:, None, None]).sum((0, 1))
        time, row = np.indices((steps, rows))
        own = tags.T
        path = (e[time, row, own].sum(0) + first[own[0]] + move[own[:-1], own[1:]].sum(0))
        slope[time, row, own] -= 1
        np.add.at(pairs, (own[:-1], own[1:]), -1)
        return float((whole - path).mean()), slope / rows, pairs / rows, slope[0].sum(0) / rows

    def gradients(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p = self.p
        x, ahead, back, states, e = self._forward(windows)
        loss, de, dmove, dfirst = self._crf(e, tags)
        size = p["uf"].shape[0]
        ds = de @ p["out"].T
        g = {"out": states.reshape(-1, 2 * size).T @ de.reshape(-1, de.shape[2]),
             "bias": de.sum((0, 1)), "move": dmove, "first": dfirst}
        g["wf"], g["uf"], g["bf"], dxf = _lstm_back(ds[:, :, :size], x, p["wf"], p["uf"], *ahead)
        g["wb"], g["ub"], g["bb"], dxb = _lstm_back(ds[::-1, :, size:], x[::-1], p["wb"], p["ub"], *back)
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], windows.T, dxf + dxb[::-1])
        return loss, g

    def train(self, windows: np.ndarray, tags: np.ndarray, epochs: int, batch: int, rate: float,
              seed: int = 11) -> list[float]:
        """Adam over shuffled batches, the rate falling to a tenth; mean loss of every epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        total = epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            found, order = [], rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                rows = order[at:at + batch]
                loss, g = self.gradients(windows[rows], tags[rows])
                norm = np.sqrt(sum((v**2).sum() for v in g.values()))
                step += 1
                now = rate * (1 - 0.9 * step / total) * min(1.0, 5 / (norm + 1e-9))
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v**2
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                found.append(loss)
            losses.append(float(np.mean(found)))
        return losses
