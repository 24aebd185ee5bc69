"""Losses of predictions against targets, averaged."""

from __future__ import annotations

import numpy as np

from quillframe.nn.autograd import Tensor, tensor


def mse_loss(p, t) -> Tensor:
    d = tensor(p) - tensor(t)
    return (d * d).mean()


def mae_loss(p, t) -> Tensor:
    return (tensor(p) - tensor(t)).abs().mean()


def rmse_loss(p, t) -> Tensor:
    return (mse_loss(p, t) + 1e-300).sqrt()


def huber_loss(p, t, delta: float = 1.0) -> Tensor:
    d = (tensor(p) - tensor(t)).abs()
    near = (d.data <= delta).astype(float)
    return (d * d * 0.5 * near + (d * delta - 0.5 * delta**2) * (1 - near)).mean()


def binary_cross_entropy(p, t) -> Tensor:
    p, t = tensor(p).clip(1e-12, 1 - 1e-12), tensor(t)
    return -(t * p.log() + (1.0 - t) * (1.0 - p).log()).mean()


def binary_cross_entropy_with_logits(x, t) -> Tensor:
    x, t = tensor(x), tensor(t)
    return (x.relu() - x * t + ((-x.abs()).exp() + 1.0).log()).mean()


def cross_entropy(logits, t) -> Tensor:
    """Targets are class numbers, or rows of probabilities."""
    logits, t = tensor(logits), np.asarray(t.data if isinstance(t, Tensor) else t)
    wanted = np.eye(logits.shape[1])[t.astype(int)] if t.ndim == 1 else t
    return -(logits.log_softmax(-1) * wanted).sum(1).mean()
