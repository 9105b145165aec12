"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

SYMBOLS = 130  # ASCII, other letters, everything else


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, points, np.where(points < 0x2000, 128, 129)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Rows of equal length in, one tag a character out; ``w`` holds all weights."""

    def __init__(self, tags: int, embed: int = 12, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        new = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.w = {"E": new(SYMBOLS, embed) * 3, "O": new(2 * hidden, tags), "o": np.zeros(tags, np.float32), "T": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            self.w |= {f"X{d}": new(embed, 4 * hidden), f"H{d}": new(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.w[f"c{d}"][hidden : 2 * hidden] = 1

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        H = self.hidden
        h, c = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
        pre = x @ self.w[f"X{d}"] + self.w[f"c{d}"]
        out, tape = np.zeros((n, steps, H), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.w[f"H{d}"]
            s = _sigmoid(z[:, : 3 * H])
            i, f, o, g = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :], np.tanh(z[:, 3 * H :])
            before, last = c, h
            c = f * c + i * g
            u = np.tanh(c)
            h = o * u
            out[:, t] = h
            tape.append((t, i, f, o, g, before, u, last))
        return out, tape

    def emissions(self, rows: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.w["E"][rows]
        (f, tf), (b, tb) = self._run(x, "f"), self._run(x, "b")
        both = np.concatenate([f, b], 2)
        return both @ self.w["O"] + self.w["o"], (x, both, tf, tb)

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward: log partition, tag marginals, summed pair marginals."""
        n, steps, k = scores.shape
        T = self.w["T"]
        a, b = np.zeros((n, steps, k)), np.zeros((n, steps, k))
        a[:, 0] = scores[:, 0]
        for t in range(1, steps):
            a[:, t] = _logsumexp(a[:, t - 1, :, None] + T, 1) + scores[:, t]
        for t in range(steps - 2, -1, -1):
            b[:, t] = _logsumexp(T + (scores[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        z = _logsumexp(a[:, -1], 1)
        pairs = np.zeros((k, k))
        for t in range(1, steps):
            pairs += np.exp(a[:, t - 1, :, None] + T + (scores[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(0)
        return z, np.exp(a + b - z[:, None, None]), pairs

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags and the marginal of each."""
        scores, _ = self.emissions(rows)
        n, steps, k = scores.shape
        best, back = scores[:, 0], np.zeros((n, steps, k), np.int64)
        for t in range(1, steps):
            s = best[:, :, None] + self.w["T"]
            back[:, t] = s.argmax(1)
            best = s.max(1) + scores[:, t]
        tags = np.zeros((n, steps), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags, np.take_along_axis(self._likely(scores), tags[:, :, None], 2)[:, :, 0]

    def _likely(self, scores: np.ndarray) -> np.ndarray:
        """The marginals alone, by scaled products instead of logarithms."""
        T = np.exp(self.w["T"] - self.w["T"].max())
        e = np.exp(scores - scores.max(2, keepdims=True))
        a, b = np.empty_like(e), np.ones_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, e.shape[1]):
            a[:, t] = (a[:, t - 1] / a[:, t - 1].sum(1, keepdims=True)) @ T * e[:, t]
        for t in range(e.shape[1] - 2, -1, -1):
            x = (e[:, t + 1] * b[:, t + 1]) @ T.T
            b[:, t] = x / x.sum(1, keepdims=True)
        m = a * b
        return m / m.sum(2, keepdims=True)

    def gradients(self, rows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        scores, (x, both, tf, tb) = self.emissions(rows)
        n, steps, k = scores.shape
        z, m, pairs = self.marginals(scores)
        one = np.eye(k)[tags]
        gold = (scores * one).sum() + self.w["T"][tags[:, :-1], tags[:, 1:]].sum()
        d = ((m - one) / n).astype(np.float32)
        np.subtract.at(pairs, (tags[:, :-1], tags[:, 1:]), 1)
        g = {"T": (pairs / n).astype(np.float32), "O": np.einsum("nth,ntk->hk", both, d), "o": d.sum((0, 1))}
        dh = d @ self.w["O"].T
        H, dx = self.hidden, np.zeros_like(x)
        for name, tape, part in (("f", tf, dh[:, :, :H]), ("b", tb, dh[:, :, H:])):
            gx, gh, gc = (np.zeros_like(self.w[f"{p}{name}"]) for p in "XHc")
            nh, nc = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
            for t, i, f, o, c, before, u, last in reversed(tape):
                h = part[:, t] + nh
                dc = nc + h * o * (1 - u * u)
                dz = np.concatenate([dc * c * i * (1 - i), dc * before * f * (1 - f), h * u * o * (1 - o), dc * i * (1 - c * c)], 1)
                gx += x[:, t].T @ dz
                gh += last.T @ dz
                gc += dz.sum(0)
                dx[:, t] += dz @ self.w[f"X{name}"].T
                nh, nc = dz @ self.w[f"H{name}"].T, dc * f
            g |= {f"X{name}": gx, f"H{name}": gh, f"c{name}": gc}
        g["E"] = np.zeros_like(self.w["E"])
        np.add.at(g["E"], rows, dx)
        return float(z.sum() - gold) / n, g

    def fit(self, rows: np.ndarray, tags: np.ndarray, steps: int, batch: int = 48, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Adam on random batches; deterministic for a seed."""
        rng = np.random.default_rng(seed)
        m, v, losses = {k: np.zeros_like(w) for k, w in self.w.items()}, {k: np.zeros_like(w) for k, w in self.w.items()}, []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(rows), batch)
            loss, g = self.gradients(rows[pick], tags[pick])
            losses.append(loss)
            scale = rate * min(1.0, 2 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k in self.w:
                x = g[k] * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                self.w[k] = self.w[k] - (scale * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return losses
