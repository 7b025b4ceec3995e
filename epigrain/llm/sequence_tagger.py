"""A character-level bidirectional LSTM with a linear-chain CRF on top, in numpy.

Gates and outputs are piecewise linear, so class 0, which stands between texts, closes them exactly: what is tagged before it never reaches
what is tagged after it, and a row may hold several pieces of text. Arrays are time-major: (position, row, ...).
"""

from __future__ import annotations

import numpy as np

#: Log score of a transition that is not allowed.
NEVER = -1e4


def allowed(kinds: int) -> np.ndarray:
    """Tags are 0 (outside), 2k + 1 (first of kind k) and 2k + 2 (further of kind k), which follows only its own kind."""
    n = 2 * kinds + 1
    out = np.ones((n, n), bool)
    for k in range(kinds):
        out[:, 2 * k + 2] = False
        out[[2 * k + 1, 2 * k + 2], 2 * k + 2] = True
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


class Tagger:
    """Parameters and passes. ``classes`` of characters (0 parts texts), ``kinds`` of spans, ``width`` units per direction."""

    def __init__(self, classes: int, kinds: int, width: int, seed: int = 0, dtype=np.float32):
        draw = np.random.default_rng(seed)
        self.width, self.tags, self.dtype = width, 2 * kinds + 1, dtype
        self.allowed = allowed(kinds)
        self.p = {}
        for d in ("f", "b"):
            self.p[f"in_{d}"] = draw.normal(0, 0.4, (classes, 4 * width))
            self.p[f"in_{d}"][:, width : 2 * width] += 1.5  # remember at first
            self.p[f"re_{d}"] = draw.normal(0, 0.5 / np.sqrt(width), (width, 4 * width))
        self.p["out"] = draw.normal(0, 0.3, (2 * width, self.tags))
        self.p["bias"] = np.zeros(self.tags)
        self.p["step"] = np.zeros((self.tags, self.tags))
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}

    # gates in the order input, forget, output, candidate: clip(z / 4 + 1/2, 0, 1), and clip(z, -1, 1) for the candidate and the cell's output
    def _scaled(self, d: str) -> tuple[np.ndarray, np.ndarray]:
        w = self.width
        scale = np.full(4 * w, 0.25, self.dtype)
        scale[3 * w :] = 0.5
        into = self.p[f"in_{d}"] * scale + self.dtype(0.5)
        into[0, : 3 * w] = -1e6
        return np.ascontiguousarray(into), np.ascontiguousarray(self.p[f"re_{d}"] * scale)

    def _direction(self, classes: np.ndarray, d: str) -> np.ndarray:
        """Hidden states of one direction; every array of a step is made once."""
        (steps, rows), w = classes.shape, self.width
        into, again = self._scaled(d)
        z, m = np.empty((rows, 4 * w), self.dtype), np.empty((rows, 4 * w), self.dtype)
        i, f, o, g = (z[:, k * w : (k + 1) * w] for k in range(4))
        h, c, u = (np.zeros((rows, w), self.dtype) for _ in range(3))
        out = np.empty((steps, rows, w), self.dtype)
        low, high = self.dtype(0), self.dtype(1)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(into, classes[t], axis=0, out=z, mode="clip")
            np.matmul(h, again, out=m)
            np.add(z, m, out=z)
            np.clip(z, low, high, out=z)
            np.multiply(g, 2, out=u)
            np.subtract(u, 1, out=u)
            np.multiply(u, i, out=u)
            np.multiply(c, f, out=c)
            np.add(c, u, out=c)
            np.clip(c, -high, high, out=h)
            np.multiply(h, o, out=h)
            out[t] = h
        return out

    def emissions(self, classes: np.ndarray) -> np.ndarray:
        """(position, row, tag) scores; class 0 is outside for certain."""
        w = self.width
        e = self._direction(classes, "f") @ self.p["out"][:w]
        e += self._direction(classes, "b") @ self.p["out"][w:]
        e += self.p["bias"]
        e[classes == 0, 1:] = NEVER
        return e

    def steps(self) -> np.ndarray:
        return np.where(self.allowed, self.p["step"], self.dtype(NEVER))

    def may_hold_spans(self, e: np.ndarray) -> np.ndarray:
        """Where a span may end that is worth more than staying outside, (position, row).

        Each span is judged alone, entered and left by its best transition. Where none gains, no path beats the one that stays
        outside, so a window without such a place need not be decoded.
        """
        s = self.steps()
        stay = s[0, 0]
        first, further = np.arange(1, self.tags, 2), np.arange(2, self.tags, 2)
        leave = np.maximum(s[1:, 0].max() - stay, 0)
        enter = e[..., 1::2] - e[..., :1] + (s[:, first].max(axis=0) - stay)
        on = e[..., 2::2] - e[..., :1] + (np.maximum(s[first, further], s[further, further]) - stay)
        for t in range(1, len(e)):
            np.add(on[t], enter[t - 1], out=on[t])
            np.maximum(enter[t], on[t], out=enter[t])
        return enter.max(axis=-1) + leave > 0

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best path of each row, (position, row); before the first position every row is outside."""
        s = self.steps()
        steps, rows, n = e.shape
        best, back = e[0] + s[0], np.empty((steps, rows, n), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + s
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + e[t]
        path = np.empty((steps, rows), np.int8)
        path[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][np.arange(rows), path[t]]
        return path

    def loss_and_gradient(self, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags of each row, and its gradient."""
        (steps, rows), w, p = classes.shape, self.width, self.p
        kept = {d: self._kept(classes, d) for d in ("f", "b")}
        hidden = np.concatenate([kept["f"]["h"], kept["b"]["h"]], axis=2)
        e = hidden @ p["out"] + p["bias"]
        part = classes == 0
        e[part, 1:] = NEVER
        s = self.steps()
        alpha = np.empty_like(e)
        alpha[0] = e[0] + s[0]
        for t in range(1, steps):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + s, 1) + e[t]
        beta = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsumexp(s + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsumexp(alpha[-1], 1)
        at, row = np.meshgrid(np.arange(steps), np.arange(rows), indexing="ij")
        before = np.concatenate([np.zeros((1, rows), tags.dtype), tags[:-1]])
        gold = (e[at, row, tags] + s[before, tags]).sum(axis=0)
        d_e = np.exp(alpha + beta - total[None, :, None])
        d_s = np.zeros_like(s)
        d_s[0] += d_e[0].sum(axis=0)
        for t in range(1, steps):
            d_s += np.exp(alpha[t - 1][:, :, None] + s + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.add.at(d_s, (before, tags), -1)
        d_e[at, row, tags] -= 1
        d_e[part] = 0
        g = {"step": np.where(self.allowed, d_s, 0), "bias": d_e.sum(axis=(0, 1))}
        g["out"] = np.einsum("trh,trk->hk", hidden, d_e)
        d_h = d_e @ p["out"].T
        for d, x in (("f", d_h[:, :, :w]), ("b", d_h[:, :, w:])):
            self._back(classes, d, kept[d], x, g)
        return float((total - gold).mean()), {k: (v / rows).astype(self.dtype) for k, v in g.items()}

    def _kept(self, classes: np.ndarray, d: str) -> dict[str, np.ndarray]:
        """One direction, with all that the way back needs."""
        (steps, rows), w = classes.shape, self.width
        into, again = self._scaled(d)
        kept = {k: np.empty((steps, rows, w), self.dtype) for k in ("h", "c", "c_in", "h_in")}
        kept["z"] = np.empty((steps, rows, 4 * w), self.dtype)
        kept["open"] = np.empty((steps, rows, 4 * w), bool)
        h = c = np.zeros((rows, w), self.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            raw = into[classes[t]] + h @ again
            kept["open"][t] = (raw > 0) & (raw < 1)
            z = np.clip(raw, 0, 1)
            z[:, 3 * w :] = 2 * z[:, 3 * w :] - 1
            kept["c_in"][t], kept["h_in"][t], kept["z"][t] = c, h, z
            c = z[:, w : 2 * w] * c + z[:, :w] * z[:, 3 * w :]
            kept["c"][t] = c
            kept["h"][t] = h = z[:, 2 * w : 3 * w] * np.clip(c, -1, 1)
        return kept

    def _back(self, classes, d, kept, d_h, g) -> None:
        (steps, rows), w = classes.shape, self.width
        again = self.p[f"re_{d}"]
        slope = np.full(4 * w, 0.25, self.dtype)
        slope[3 * w :] = 1
        d_z = np.empty((steps, rows, 4 * w), self.dtype)
        down = carry = np.zeros((rows, w), self.dtype)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            z, c = kept["z"][t], kept["c"][t]
            dh = d_h[t] + down
            dc = dh * z[:, 2 * w : 3 * w] * (np.abs(c) < 1) + carry
            x = d_z[t]
            x[:, :w], x[:, w : 2 * w] = dc * z[:, 3 * w :], dc * kept["c_in"][t]
            x[:, 2 * w : 3 * w], x[:, 3 * w :] = dh * np.clip(c, -1, 1), dc * z[:, :w]
            x *= kept["open"][t] * slope
            down, carry = x @ again.T, dc * z[:, w : 2 * w]
        g[f"re_{d}"] = np.einsum("trh,trz->hz", kept["h_in"], d_z)
        into = np.zeros_like(self.p[f"in_{d}"])
        flat, rows_z = classes.ravel(), d_z.reshape(-1, 4 * w)
        order = np.argsort(flat, kind="stable")
        found, first = np.unique(flat[order], return_index=True)
        into[found] = np.add.reduceat(rows_z[order], first, axis=0)
        into[0] = 0
        g[f"in_{d}"] = into

    def fit(self, classes: np.ndarray, tags: np.ndarray, rounds: int, batch: int, rate: float = 0.04, seed: int = 0) -> list[float]:
        """Adam over shuffled batches of rows, the rate falling to a tenth; returns the mean loss of each round."""
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses, at = [], 0
        total = rounds * max(1, -(-classes.shape[1] // batch))
        for _ in range(rounds):
            order, seen = draw.permutation(classes.shape[1]), []
            for s in range(0, len(order), batch):
                part = order[s : s + batch]
                loss, g = self.loss_and_gradient(classes[:, part], tags[:, part])
                seen.append(loss)
                size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                at += 1
                step = rate * (1 - 0.9 * at / total) * np.sqrt(1 - 0.999**at) / (1 - 0.9**at)
                for k, x in g.items():
                    x = x * min(1.0, 5.0 / (size + 1e-9))
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.001 * (x * x - v[k])
                    self.p[k] -= (step * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(self.dtype)
            losses.append(float(np.mean(seen)))
        return losses
