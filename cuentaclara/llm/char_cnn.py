"""A small character convolutional network in numpy: embedding, one convolution, pooling over value and context, two dense layers.

Training is repeatable: the seed fixes the start and the order of the rows. ``Calibration`` maps outputs to probabilities
and takes the highest threshold that still finds the wanted share of the validation positives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cuentaclara.llm.common import ship

ship(__name__)

SYMBOLS = 256
EMBED, KERNEL, FILTERS, HIDDEN = 12, 5, 32, 24
BLOCK = 512


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class CharCNN:
    """Rows of ``width`` symbols below 256 in, one number per row out: the larger, the likelier label 1."""

    def __init__(self, width: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, fan: int) -> np.ndarray:
            return (rng.standard_normal(shape) * np.sqrt(2.0 / fan)).astype("float32")

        self.width = width
        self.params = {
            "embed": normal(SYMBOLS, EMBED, fan=EMBED), "conv": normal(KERNEL * EMBED, FILTERS, fan=KERNEL * EMBED),
            "conv_b": np.zeros(FILTERS, "float32"), "dense": normal(2 * FILTERS, HIDDEN, fan=2 * FILTERS),
            "dense_b": np.zeros(HIDDEN, "float32"), "out": normal(HIDDEN, 1, fan=HIDDEN), "out_b": np.zeros(1, "float32")}

    def _forward(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        x = p["embed"][rows]
        windows = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2)
        flat = windows.reshape(len(rows), -1, KERNEL * EMBED)
        h = np.maximum(flat @ p["conv"] + p["conv_b"], 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None, :], axis=1)[:, 0], h.mean(axis=1)], axis=1)
        hidden = np.maximum(pooled @ p["dense"] + p["dense_b"], 0)
        return {"flat": flat, "h": h, "top": top, "pooled": pooled, "hidden": hidden, "logit": (hidden @ p["out"] + p["out_b"])[:, 0]}

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """Blocked, so that memory does not grow with the number of rows."""
        parts = [self._forward(rows[i: i + BLOCK])["logit"] for i in range(0, len(rows), BLOCK)]
        return np.concatenate(parts) if parts else np.zeros(0, "float32")

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        p, f, n = self.params, self._forward(rows), len(rows)
        d_logit = ((sigmoid(f["logit"]) - labels) / n).astype("float32")[:, None]
        d_hidden = (d_logit @ p["out"].T) * (f["hidden"] > 0)
        d_pooled = d_hidden @ p["dense"].T
        d_h = np.repeat(d_pooled[:, None, FILTERS:] / f["h"].shape[1], f["h"].shape[1], axis=1)
        picked = np.take_along_axis(d_h, f["top"][:, None, :], axis=1) + d_pooled[:, None, :FILTERS]
        np.put_along_axis(d_h, f["top"][:, None, :], picked, axis=1)
        d_h *= f["h"] > 0
        d_flat = (d_h @ p["conv"].T).reshape(n, -1, KERNEL, EMBED)
        d_x = np.zeros((n, self.width, EMBED), "float32")
        for k in range(KERNEL):
            d_x[:, k: k + d_flat.shape[1]] += d_flat[:, :, k]
        d_embed = np.zeros_like(p["embed"])
        np.add.at(d_embed, rows.ravel(), d_x.reshape(-1, EMBED))
        return {
            "embed": d_embed, "conv": np.tensordot(f["flat"], d_h, axes=([0, 1], [0, 1])), "conv_b": d_h.sum(axis=(0, 1)),
            "dense": f["pooled"].T @ d_hidden, "dense_b": d_hidden.sum(axis=0), "out": f["hidden"].T @ d_logit, "out_b": d_logit.sum(axis=0)}

    def fit(self, rows: np.ndarray, labels: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 2e-3, seed: int = 0) -> CharCNN:
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.params.items()}
        square = {k: np.zeros_like(v) for k, v in self.params.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                step += 1
                part = order[i: i + batch]
                for k, g in self.gradients(rows[part], labels[part]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    change = (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
                    self.params[k] -= (rate * (change + 1e-4 * self.params[k])).astype("float32")
        return self


@dataclass(frozen=True)
class Calibration:
    scale: float
    shift: float
    threshold: float

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * logits.astype("float64") + self.shift)

    @classmethod
    def fit(cls, logits: np.ndarray, labels: np.ndarray, recall: float) -> Calibration:
        """Logistic scaling by Newton steps; the threshold is the highest with at least ``recall`` on the positives."""
        x = np.stack([logits.astype("float64"), np.ones(len(logits))], axis=1)
        # Smoothed targets keep the scaling finite where the rows can be separated.
        positives = labels.sum()
        target = np.where(labels > 0, (positives + 1) / (positives + 2), 1 / (len(labels) - positives + 2))
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = sigmoid(x @ w)
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
            move = np.linalg.solve(hessian, x.T @ (p - target) + 1e-6 * (w - [1.0, 0.0]))
            w = w - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        scores = np.sort(sigmoid(x @ w)[labels > 0])
        threshold = scores[int(np.floor((1 - recall) * len(scores)))] if len(scores) else 0.5
        return cls(float(w[0]), float(w[1]), float(threshold))
