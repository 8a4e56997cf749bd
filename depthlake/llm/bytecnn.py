"""A small convolutional network over bytes, in numpy: embedding, filters of several widths, max pooling, softmax.

Windows are rows of a ``uint8`` matrix, padded with 0.  One forward step unfolds each window at a
stride, multiplies it with the filters of one width, and keeps every filter's maximum.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Shape:
    classes: int
    widths: tuple[int, ...] = (3, 4, 5)
    filters: int = 16
    dims: int = 8
    stride: int = 2
    length: int = 256


@dataclass
class ByteNet:
    shape: Shape
    embed: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    moments: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fresh(cls, shape: Shape, seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        kernels = [draw(w * shape.dims, shape.filters, scale=(w * shape.dims) ** -0.5) for w in shape.widths]
        total = shape.filters * len(shape.widths)
        return cls(shape, draw(256, shape.dims, scale=0.5), kernels, [np.zeros(shape.filters, np.float32) for _ in shape.widths],
                   draw(total, shape.classes, scale=total ** -0.5), np.zeros(shape.classes, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels, *self.biases, self.out, self.out_bias]

    def _unfold(self, windows: np.ndarray, width: int) -> np.ndarray:
        """Byte positions of every stride step: (windows, steps, width)."""
        return np.lib.stride_tricks.sliding_window_view(windows, width, axis=1)[:, ::self.shape.stride]

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each window, after the rectifier."""
        found = []
        whole = self.embed[windows]  # windows, length, dims
        b, _, d = whole.shape
        for width, kernel, bias in zip(self.shape.widths, self.kernels, self.biases, strict=True):
            steps = np.lib.stride_tricks.sliding_window_view(whole.reshape(b, -1), width * d, axis=1)[:, ::self.shape.stride * d]
            made = steps.reshape(-1, width * d) @ kernel
            found.append(np.maximum(made.reshape(b, -1, kernel.shape[1]).max(axis=1) + bias, 0))
        return np.concatenate(found, axis=1)

    def logits(self, windows: np.ndarray, batch: int = 256) -> np.ndarray:
        if not len(windows):
            return np.zeros((0, self.shape.classes), np.float32)
        return np.concatenate([self.pooled(windows[i:i + batch]) @ self.out + self.out_bias for i in range(0, len(windows), batch)])

    def train(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray, *, epochs: int, batch: int = 128, rate: float = 3e-3, seed: int = 11) -> None:
        """Adam on weighted cross entropy; ``target`` holds class numbers."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            pace = rate * (0.5 ** (2 * epoch / max(1, epochs)))
            for i in range(0, len(order), batch):
                pick = order[i:i + batch]
                step += 1
                for p, g, m, v in zip(params, self._gradients(windows[pick], target[pick], weight[pick]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)

    def _gradients(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        b, d, f = len(windows), self.shape.dims, self.shape.filters
        rows, cols = np.arange(b)[:, None], np.arange(f)[None, :]
        seen, pooled = [], []
        for width, kernel, bias in zip(self.shape.widths, self.kernels, self.biases, strict=True):
            codes = self._unfold(windows, width)
            inputs = self.embed[codes].reshape(b, codes.shape[1], width * d)
            made = inputs @ kernel
            at = made.argmax(axis=1)
            value = made[rows, at, cols] + bias
            seen.append((codes[rows, at], inputs[rows, at], value > 0))  # bytes and inputs under each maximum
            pooled.append(np.maximum(value, 0))
        hidden = np.concatenate(pooled, axis=1)
        scores = hidden @ self.out + self.out_bias
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = scores / scores.sum(axis=1, keepdims=True)
        error[np.arange(b), target] -= 1
        error *= (weight / weight.sum())[:, None]
        back = error @ self.out.T
        g_embed, g_kernels, g_biases = np.zeros_like(self.embed), [], []
        for k, (width, kernel) in enumerate(zip(self.shape.widths, self.kernels, strict=True)):
            codes, inputs, alive = seen[k]
            g = back[:, k * f:(k + 1) * f] * alive
            g_kernels.append(np.einsum("bf,bfi->if", g, inputs))
            g_biases.append(g.sum(axis=0))
            flow = (g[:, :, None] * kernel.T[None]).reshape(-1, d)
            np.add.at(g_embed, codes.reshape(-1), flow)
        return [g_embed, *g_kernels, *g_biases, hidden.T @ error + 1e-4 * self.out, error.sum(axis=0)]


def windows_of(buf: np.ndarray, offsets: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut every row into windows of ``length`` bytes at multiples of ``step`` until its end is covered.

    Returns (windows, row of each, bytes in each); an empty row has none.
    """
    size = np.diff(offsets)
    count = np.where(size > 0, 1 + np.maximum(0, -((length - size) // step)), 0)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * step
    held = np.minimum(length, size[row] - start)
    at = (offsets[:-1][row] + start)[:, None] + np.arange(length)[None, :]
    padded = np.concatenate([buf, np.zeros(length, np.uint8)])
    windows = padded[np.minimum(at, len(padded) - 1)]
    windows[np.arange(length)[None, :] >= held[:, None]] = 0
    return windows, row, held
