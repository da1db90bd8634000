"""A character-level bidirectional LSTM with CRF transitions in numpy: training, and batched decoding of windows."""

from __future__ import annotations

import numpy as np

# Character classes: printable ASCII one by one, then groups.
ASCII = 95
OTHER_UPPER, OTHER_LOWER, OTHER_SPACE, OTHER, PAD = ASCII, ASCII + 1, ASCII + 2, ASCII + 3, ASCII + 4
N_CHARS = ASCII + 5


def _class(code: int) -> int:
    if 32 <= code < 127:
        return code - 32
    ch = chr(code)
    return OTHER_SPACE if ch.isspace() else OTHER_UPPER if ch.isupper() else OTHER_LOWER if ch.islower() else OTHER


_LOW = np.array([_class(c) for c in range(0x3000)], dtype=np.int16)


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < len(_LOW), _LOW[np.minimum(codes, len(_LOW) - 1)], OTHER)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class CharCrf:
    """Inputs are ids below ``n_inputs``; both directions run as one stacked product a step."""

    def __init__(self, n_inputs: int, n_tags: int, hidden: int = 24, seed: int = 5):
        r = np.random.default_rng(seed)
        h = hidden
        self.hidden, self.n_tags = h, n_tags
        self.p = {
            "table": r.normal(0, 0.3, (2, n_inputs, 4 * h)).astype(np.float32),
            "rec": r.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)).astype(np.float32),
            "bias": np.zeros((2, 1, 4 * h), np.float32),
            "out": r.normal(0, 0.2, (2 * h, n_tags)).astype(np.float32),
            "ob": np.zeros(n_tags, np.float32),
            "trans": np.zeros((n_tags, n_tags), np.float32),
        }
        self.p["bias"][:, :, h : 2 * h] = 1.0  # gates: input, forget, output, candidate

    def _run(self, x: np.ndarray, keep: bool):
        """Hidden states (T, 2, B, H); the second direction reads the reversed windows."""
        b, t = x.shape
        h = self.hidden
        ins = np.stack([x.T, x.T[::-1]], 1)  # T, 2, B
        c = np.zeros((2, b, h), np.float32)
        s = np.zeros((2, b, h), np.float32)
        hs = np.empty((t, 2, b, h), np.float32)
        saved = []
        table, rec = self.p["table"] + self.p["bias"], self.p["rec"]
        z = np.empty((2, b, 4 * h), np.float32)
        for i in range(t):
            np.matmul(s, rec, out=z)
            z[0] += table[0][ins[i, 0]]
            z[1] += table[1][ins[i, 1]]
            g = _sigmoid(z[:, :, : 3 * h])
            cand = np.tanh(z[:, :, 3 * h :])
            old = c
            c = g[:, :, h : 2 * h] * old + g[:, :, :h] * cand
            tc = np.tanh(c)
            before = s
            s = g[:, :, 2 * h :] * tc
            hs[i] = s
            if keep:
                saved.append((g, cand, old, tc, before))
        return ins, hs, saved

    def _ready(self) -> tuple:
        """Weights for reading: gates negated for 1 / (1 + exp(z)), the candidate's doubled as tanh is a sigmoid of twice the value, both directions in one table."""
        if not hasattr(self, "_fast"):
            h = self.hidden
            f = np.full(4 * h, -1.0, np.float32)
            f[3 * h :] = -2.0
            table = (self.p["table"] + self.p["bias"]) * f
            self._fast = np.ascontiguousarray(table.reshape(-1, 4 * h)), self.p["rec"] * f, table.shape[1]
        return self._fast

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_fast"}

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(T, B, tags)"""
        table, rec, n = self._ready()
        b, t = x.shape
        h = self.hidden
        ins = np.stack([x.T, x.T[::-1] + n], 1)  # T, 2, B
        z, zz = np.empty((2, b, 4 * h), np.float32), np.empty((2, b, 4 * h), np.float32)
        c, u = np.zeros((2, b, h), np.float32), np.empty((2, b, h), np.float32)
        hs = np.zeros((t + 1, 2, b, h), np.float32)
        for i in range(t):
            np.take(table, ins[i], axis=0, out=z, mode="clip")
            np.matmul(hs[i], rec, out=zz)
            z += zz
            np.exp(z, out=z)
            z += 1.0
            np.reciprocal(z, out=z)
            c *= z[:, :, h : 2 * h]
            np.multiply(z[:, :, 3 * h :], 2.0, out=u)
            u -= 1.0
            u *= z[:, :, :h]
            c += u
            np.multiply(c, -2.0, out=u)
            np.exp(u, out=u)
            u += 1.0
            np.reciprocal(u, out=u)
            u *= 2.0
            u -= 1.0
            np.multiply(u, z[:, :, 2 * h : 3 * h], out=hs[i + 1])
        hs = hs[1:]
        return hs[:, 0] @ self.p["out"][:h] + hs[::-1, 1] @ self.p["out"][h:] + self.p["ob"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window (B, T) under the CRF.

        A window where every other tag falls short of tag 0 by more than any two transitions can make good is all 0 and is not decoded.
        """
        e = self.emissions(x)
        t, b, k = e.shape
        tags = np.zeros((b, t), np.int8)
        tr = self.p["trans"]
        gain = 2 * float((tr - tr[0, 0]).max())
        some = np.flatnonzero((e[:, :, 1:].max(2) - e[:, :, 0]).max(0) + gain >= 0)
        if not len(some):
            return tags
        e = np.ascontiguousarray(e[:, some].transpose(0, 2, 1))  # T, tags, windows
        score = e[0]
        back = np.empty((t, k, len(some)), np.int8)
        for i in range(1, t):
            best = score[0] + tr[0][:, None]
            at = back[i]
            at[:] = 0
            for j in range(1, k):
                m = score[j] + tr[j][:, None]
                more = m > best
                np.copyto(best, m, where=more)
                at[more] = j
            score = best + e[i]
        rows = np.arange(len(some))
        now = score.argmax(0)
        for i in range(t - 1, -1, -1):
            tags[some, i] = now
            now = back[i, now, rows]
        return tags

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per character, and its gradients, by forward-backward and back-propagation through time."""
        b, t = x.shape
        h, k = self.hidden, self.n_tags
        ins, hs, saved = self._run(x, True)
        both = np.concatenate([hs[:, 0], hs[::-1, 1]], 2)  # T, B, 2H
        e = (both @ self.p["out"] + self.p["ob"]).astype(np.float64)
        tr = self.p["trans"].astype(np.float64)
        etr = np.exp(tr)
        alpha, beta = np.empty((t, b, k)), np.empty((t, b, k))
        ex = np.exp(e - e.max(2, keepdims=True))
        logz = e.max(2).sum(0)
        a = ex[0]
        for i in range(t):
            if i:
                a = (a @ etr) * ex[i]
            norm = a.sum(1, keepdims=True)
            a = a / norm
            alpha[i] = a
            logz += np.log(norm[:, 0])
        bt = np.ones((b, k))
        gtr = np.zeros((k, k))
        beta[-1] = bt
        for i in range(t - 2, -1, -1):
            w = ex[i + 1] * bt
            pair = alpha[i][:, :, None] * etr * w[:, None, :]
            gtr += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            bt = w @ etr.T
            bt /= bt.sum(1, keepdims=True)
            beta[i] = bt
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        yt = y.T
        gold = np.take_along_axis(e, yt[:, :, None], 2).sum((0, 2)) + tr[yt[:-1], yt[1:]].sum(0)
        de = post
        np.put_along_axis(de, yt[:, :, None], np.take_along_axis(de, yt[:, :, None], 2) - 1, 2)
        np.subtract.at(gtr, (yt[:-1], yt[1:]), 1)
        scale = 1.0 / (b * t)
        de = (de * scale).astype(np.float32)
        g = {n: np.zeros_like(v) for n, v in self.p.items()}
        g["trans"] = (gtr * scale).astype(np.float32)
        g["out"] = np.tensordot(both, de, ([0, 1], [0, 1]))
        g["ob"] = de.sum((0, 1))
        dboth = de @ self.p["out"].T
        dh = np.stack([dboth[:, :, :h], dboth[::-1, :, h:]], 1)
        ds, dc = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        rec_t = np.swapaxes(self.p["rec"], 1, 2)
        dzs = np.empty((t, 2, b, 4 * h), np.float32)
        for i in range(t - 1, -1, -1):
            gate, cand, old, tc, before = saved[i]
            s = ds + dh[i]
            o = gate[:, :, 2 * h :]
            dc = dc + s * o * (1 - tc * tc)
            dz = dzs[i]
            dz[:, :, :h] = dc * cand
            dz[:, :, h : 2 * h] = dc * old
            dz[:, :, 2 * h : 3 * h] = s * tc
            dz[:, :, : 3 * h] *= gate * (1 - gate)
            dz[:, :, 3 * h :] = dc * gate[:, :, :h] * (1 - cand * cand)
            ds = dz @ rec_t
            dc = dc * gate[:, :, h : 2 * h]
        befores = np.concatenate([np.zeros((1, 2, b, h), np.float32), hs[:-1]], 0)
        for d in range(2):
            flat = dzs[:, d].reshape(-1, 4 * h)
            g["rec"][d] = befores[:, d].reshape(-1, h).T @ flat
            ids = ins[:, d].reshape(-1)
            order = np.argsort(ids, kind="stable")
            found, at = np.unique(ids[order], return_index=True)
            g["table"][d][found] = np.add.reduceat(flat[order], at, 0)
            g["bias"][d] = flat.sum(0)
        return float((logz - gold).sum() * scale), g

    def fit(self, batches, rate: float = 0.01, clip: float = 1.0, steps: int = 1) -> list[float]:
        """Adam over the batches (x, y); the rate falls linearly to a twentieth over ``steps``."""
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v2 = {n: np.zeros_like(v) for n, v in self.p.items()}
        losses = []
        for i, (x, y) in enumerate(batches, 1):
            loss, g = self.loss_and_grads(x, y)
            losses.append(loss)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            f = min(1.0, clip / (norm + 1e-9))
            lr = rate * max(0.05, 1 - i / steps)
            for n, a in g.items():
                a = a * f
                m[n] = 0.9 * m[n] + 0.1 * a
                v2[n] = 0.999 * v2[n] + 0.001 * a * a
                self.p[n] -= (lr * (m[n] / (1 - 0.9**i)) / (np.sqrt(v2[n] / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
        return losses
