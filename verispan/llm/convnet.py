"""A small convolutional text classifier in numpy: embedding, several filter widths, max pooling, softmax.

Symbols are bytes or hashed words; symbol 0 is padding and its embedding stays zero.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

RATE = 0.05
#: Positions whose filters are computed at once.
STRIP = 1 << 15


@dataclass
class ConvNet:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    widths: tuple[int, ...]
    _squares: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fresh(cls, symbols: int, size: int, widths: tuple[int, ...], filters: int, classes: int, seed: int) -> ConvNet:
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, 0.3, (symbols, size)).astype(np.float32)
        embedding[0] = 0
        kernels = [rng.normal(0, 1 / np.sqrt(w * size), (w * size, filters)).astype(np.float32) for w in widths]
        total = filters * len(widths)
        return cls(embedding, kernels, np.zeros(total, np.float32), rng.normal(0, 1 / np.sqrt(total), (total, classes)).astype(np.float32), np.zeros(classes, np.float32), widths)

    @property
    def margin(self) -> int:
        """Padding that keeps one sequence's filters from reaching into the next."""
        return max(self.widths) - 1

    def _kernel(self) -> np.ndarray:
        """All filters as one matrix over the widest window."""
        full = max(self.widths) * self.embedding.shape[1]
        return np.concatenate([np.concatenate([k, np.zeros((full - len(k), k.shape[1]), np.float32)]) for k in self.filters], axis=1)

    def responses(self, symbols: np.ndarray, kernel: np.ndarray | None = None) -> np.ndarray:
        """Filter outputs at every position of symbols but the last ``margin``."""
        kernel = self._kernel() if kernel is None else kernel
        n = len(symbols) - self.margin
        x = self.embedding[symbols]
        cols = np.lib.stride_tricks.as_strided(x, (n, kernel.shape[0]), (x.strides[0], x.strides[1]))
        return cols @ kernel

    def pooled(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each sequence's largest filter outputs, at least zero.

        Sequence k is at starts[k], ``margin`` zeros behind it. Work is done by strips of positions.
        """
        kernel = self._kernel()
        out = np.zeros((len(starts), kernel.shape[1]), np.float32)
        some = np.flatnonzero(lengths > 0)
        for a in range(0, len(symbols) - self.margin, STRIP):
            z = min(a + STRIP, len(symbols) - self.margin)
            low = int(np.searchsorted(starts[some] + lengths[some], a, "right"))
            high = int(np.searchsorted(starts[some], z))
            own = some[low:high]
            if not len(own):
                continue
            y = self.responses(symbols[a : z + self.margin], kernel)
            first = np.maximum(starts[own] - a, 0)
            last = np.minimum(starts[own] + lengths[own] - a, z - a)
            bounds = np.empty(2 * len(own), np.int64)
            bounds[0::2], bounds[1::2] = first, last
            if bounds[-1] >= len(y):
                top = np.maximum.reduceat(y, bounds[:-1], axis=0)[0::2]
            else:
                top = np.maximum.reduceat(y, bounds, axis=0)[0::2]
            out[own] = np.maximum(out[own], top + self.bias)
        out[lengths == 0] = np.maximum(self.bias, 0)  # as of padding alone
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.dense + self.offset

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = self.logits(pooled)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def step(self, sequences: list[np.ndarray], labels: np.ndarray, decay: float) -> float:
        """One Adagrad step on a batch; the loss before it."""
        lengths = np.array([len(s) for s in sequences])
        gap = np.zeros(self.margin, sequences[0].dtype)
        symbols = np.concatenate([x for s in sequences for x in (s, gap)])
        starts = np.cumsum(lengths + self.margin) - lengths - self.margin
        y = self.responses(symbols)
        n, size = len(sequences), self.embedding.shape[1]
        top = np.zeros((n, y.shape[1]), np.float32)
        best = np.zeros((n, y.shape[1]), np.int64)
        for k in range(n):
            if lengths[k]:
                own = y[starts[k] : starts[k] + lengths[k]]
                best[k] = own.argmax(axis=0)
                top[k] = np.take_along_axis(own, best[k][None], 0)[0]
        best += starts[:, None]
        pooled = np.maximum(top + self.bias, 0)
        p = self.probabilities(pooled)
        loss = float(-np.log(p[np.arange(n), labels] + 1e-9).mean())
        p[np.arange(n), labels] -= 1
        p /= n
        back = p @ self.dense.T * (pooled > 0) * (lengths > 0)[:, None]
        self._update("dense", self.dense, pooled.T @ p + decay * self.dense)
        self._update("offset", self.offset, p.sum(axis=0))
        self._update("bias", self.bias, back.sum(axis=0))
        rows, grads = [], []
        for j, (w, kernel) in enumerate(zip(self.widths, self.filters, strict=True)):
            f = kernel.shape[1]
            at = best[:, j * f : (j + 1) * f, None] + np.arange(w)
            d = back[:, j * f : (j + 1) * f]
            seen = symbols[at]
            window = self.embedding[seen].reshape(n, f, w * size)
            rows.append(seen.ravel())
            grads.append((d[:, :, None] * kernel.T[None]).reshape(-1, size))
            self._update(f"filters{j}", kernel, np.einsum("nfk,nf->kf", window, d) + decay * kernel)
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        at, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(at), size), np.float32)
        np.add.at(total, inverse, grads)
        total += decay * self.embedding[at]
        total[at == 0] = 0
        held = self._squares.setdefault("embedding", np.full_like(self.embedding, 1e-4))
        held[at] += total**2
        self.embedding[at] -= RATE * total / np.sqrt(held[at])
        return loss

    def _update(self, name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        held = self._squares.setdefault(name, np.full_like(value, 1e-4))
        held += gradient**2
        value -= RATE * gradient / np.sqrt(held)

    def fit(self, sequences: list[np.ndarray], labels: np.ndarray, epochs: int, batch: int, decay: float, seed: int) -> list[float]:
        rng = np.random.default_rng(seed)
        losses = []
        for _ in range(epochs):
            order = rng.permutation(len(sequences))
            losses.append(float(np.mean([self.step([sequences[i] for i in own], labels[own], decay) for own in np.array_split(order, max(1, len(order) // batch))])))
        self._squares = {}
        return losses
