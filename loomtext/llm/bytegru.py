"""A bidirectional gated recurrent network over bytes, in numpy, trained by backpropagation through time."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.exp(-x)
    x += 1
    return np.reciprocal(x, out=x)


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row [batch, time, ...] turned round within its length; the padding stays behind."""
    t = np.arange(x.shape[1])
    at = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
    return np.take_along_axis(x, at.reshape(*at.shape, *[1] * (x.ndim - 2)), 1) if x.ndim > 2 else np.take_along_axis(x, at, 1)


class ByteGRU:
    """Both directions run as one batch of two; the input weights are a table of rows per byte.

    Gates are in the order update, reset, candidate.
    """

    def __init__(self, classes: int, hidden: int = 32, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32),
            "u": (rng.normal(0, 1, (2, h, 3 * h)) / np.sqrt(h)).astype(np.float32),
            "c": np.zeros((2, 1, h), np.float32),
            "v": (rng.normal(0, 1, (2, h, classes)) / np.sqrt(2 * h)).astype(np.float32),
            "b": np.zeros(classes, np.float32),
        }
        self.p["x"][:, :, :h] += 1.0  # remember at first

    def _states(self, rows: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states [time, 2, batch, hidden] for bytes [2, batch, time], and what the way back needs."""
        h, u, c, x = self.hidden, self.p["u"], self.p["c"], self.p["x"]
        _, n, steps = rows.shape
        state = np.zeros((2, n, h), x.dtype)
        out = np.empty((steps, 2, n, h), x.dtype)
        past: list = []
        for t in range(steps):
            w = np.stack((x[0][rows[0, :, t]], x[1][rows[1, :, t]]))
            g = np.matmul(state, u)
            zr = _sigmoid(w[:, :, : 2 * h] + g[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            inner = g[:, :, 2 * h :] + c
            # tanh by way of exp, which numpy has in vector form for single precision
            cand = 2 * _sigmoid(2 * (w[:, :, 2 * h :] + r * inner)) - 1
            past.append((state, z, r, inner, cand))
            state = cand + z * (state - cand)
            out[t] = state
        return out, past

    def _run(self, texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The states alone [2, time, batch, hidden], in place; those of the way back in its own order.

        The way back begins with the padding, and its state is set to nothing where the text itself begins.
        """
        h = self.hidden
        n, steps = texts.shape
        x, u = self.p["x"].astype(np.float32), self.p["u"].astype(np.float32)
        # the gates' weights change their sign and the candidate's are doubled, so that exp is all that is left to do
        xg, xc = -x[:, :, : 2 * h], -2 * x[:, :, 2 * h :]
        ug, uc, c = -u[:, :, : 2 * h], -2 * u[:, :, 2 * h :], -2 * self.p["c"].astype(np.float32)
        at = np.ascontiguousarray(np.stack((texts, texts[:, ::-1])).transpose(2, 0, 1)).astype(np.intp)
        begins: dict[int, list[int]] = {}
        for row, k in enumerate((steps - lengths).tolist()):
            if k:
                begins.setdefault(k, []).append(row)
        gate, more, cand, inner = (np.empty((2, n, k * h), np.float32) for k in (2, 2, 1, 1))
        out = np.empty((2, steps, n, h), np.float32)
        state = np.zeros((2, n, h), np.float32)
        for t in range(steps):
            if t in begins:
                state[1, begins[t]] = 0
            for k in range(2):
                np.take(xg[k], at[t, k], axis=0, out=gate[k], mode="clip")
                np.take(xc[k], at[t, k], axis=0, out=cand[k], mode="clip")
            gate += np.matmul(state, ug, out=more)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            np.matmul(state, uc, out=inner)
            inner += c
            inner *= gate[:, :, h:]
            cand += inner
            np.exp(cand, out=cand)
            cand += 1
            np.divide(np.float32(2), cand, out=cand)
            cand -= 1
            state -= cand
            state *= gate[:, :, :h]
            state += cand
            out[:, t] = state
        return out

    def probabilities(self, texts: np.ndarray, lengths: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and their logarithms, both [classes, places], of ``size`` places from ``begin`` on of each of the padded texts [batch, time], one text's behind the other's."""
        n, steps = texts.shape
        with np.errstate(over="ignore"):
            out = self._run(texts, lengths)
        v = self.p["v"].astype(np.float32)
        ahead, back = ((v[k].T @ out[k].reshape(-1, self.hidden).T).reshape(-1, steps, n) for k in range(2))
        ahead += back[:, ::-1]
        place = np.arange(steps)
        judged = (place >= begin[:, None]) & (place < (begin + size)[:, None])
        logits = ahead.transpose(0, 2, 1)[:, judged]
        logits += self.p["b"].astype(np.float32)[:, None]
        logits -= logits.max(axis=0)
        mass = np.exp(logits)
        total = mass.sum(axis=0)
        mass /= total
        logits -= np.log(total)
        return mass, logits

    def gradients(self, texts: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the labelled positions (label -1 is none) and its gradients."""
        h, u, v = self.hidden, self.p["u"], self.p["v"]
        both = np.stack((texts, _flip(texts, lengths)))
        out, past = self._states(both)
        steps, _, n, _ = out.shape
        back = _flip(out[:, 1].transpose(1, 0, 2), lengths)
        logits = out[:, 0].transpose(1, 0, 2) @ v[0] + back @ v[1] + self.p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        known = labels >= 0
        count = max(1, int(known.sum()))
        safe = np.where(known, labels, 0)
        loss = float(-(np.log(np.take_along_axis(prob, safe[:, :, None], 2)[:, :, 0] + 1e-9) * known).sum() / count)
        d = prob
        np.put_along_axis(d, safe[:, :, None], np.take_along_axis(d, safe[:, :, None], 2) - 1, 2)
        d *= known[:, :, None] / np.float32(count)
        grad = {"b": d.sum(axis=(0, 1)), "v": np.stack((np.einsum("tnh,ntk->hk", out[:, 0], d, optimize=True), np.einsum("nth,ntk->hk", back, d, optimize=True)))}
        dout = np.stack(((d @ v[0].T).transpose(1, 0, 2), _flip(d @ v[1].T, lengths).transpose(1, 0, 2)), 1)
        dx = np.empty((steps, 2, n, 3 * h), np.float32)
        du, dc = np.zeros_like(u), np.zeros_like(self.p["c"])
        dstate = np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            state, z, r, inner, cand = past[t]
            dstate = dstate + dout[t]
            dcand = dstate * (1 - z) * (1 - cand * cand)
            dz = dstate * (state - cand) * z * (1 - z)
            dinner = dcand * r
            dr = dcand * inner * r * (1 - r)
            dx[t, :, :, :h], dx[t, :, :, h : 2 * h], dx[t, :, :, 2 * h :] = dz, dr, dcand
            dg = np.concatenate((dz, dr, dinner), 2)
            du += np.matmul(state.transpose(0, 2, 1), dg)
            dc += dinner.sum(axis=1, keepdims=True)
            dstate = dstate * z + np.matmul(dg, u.transpose(0, 2, 1))
        table = np.zeros_like(self.p["x"])
        for k in range(2):
            symbols = both[k].T.ravel()
            order = np.argsort(symbols, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(symbols[order]) != 0)))
            table[k][symbols[order][first]] = np.add.reduceat(dx[:, k].reshape(-1, 3 * h)[order], first, axis=0)
        return loss, grad | {"u": du, "c": dc, "x": table}

    def train(self, batches, rate: float = 0.01, clip: float = 1.0) -> list[float]:
        """Adam over an iterable of (bytes, lengths, labels); the rate falls to a tenth towards the end of the list."""
        batches = list(batches)
        m, s = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        losses = []
        for i, batch in enumerate(batches, 1):
            loss, grad = self.gradients(*batch)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = np.float32(min(1.0, clip / (norm + 1e-9)))
            now = rate * (0.1 + 0.9 * (1 - i / len(batches)))
            for k, g in grad.items():
                g = g * scale
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
        return losses
