"""Optimisers, learning-rate schedules, and training on a Spark table."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from quillframe.config import non_negative
from quillframe.nn.autograd import Tensor


class Optimizer:
    """Steps parameters by their gradients; each keeps its own state."""

    def __init__(self, parameters: Sequence[Tensor], lr: float, weight_decay: float = 0.0):
        self.parameters, self.lr, self.weight_decay = list(parameters), non_negative(lr, "lr"), non_negative(weight_decay, "weight_decay")
        self.state: list[dict] = [{} for _ in self.parameters]
        self.t = 0

    def zero_grad(self) -> None:
        for p in self.parameters:
            p.zero_grad()

    def step(self, closure: Callable[[], float] | None = None) -> float | None:
        loss = closure() if closure else None
        self.t += 1
        for p, s in zip(self.parameters, self.state, strict=True):
            if p.grad is not None:
                p.data -= self.update(p, self._decayed(p), s)
        return loss

    def _decayed(self, p: Tensor) -> np.ndarray:
        return p.grad + self.weight_decay * p.data

    def update(self, p: Tensor, g: np.ndarray, s: dict) -> np.ndarray:
        raise NotImplementedError

    @staticmethod
    def _mean(s: dict, name: str, g: np.ndarray, beta: float) -> np.ndarray:
        s[name] = beta * s.get(name, 0.0) + (1 - beta) * g
        return s[name]


class SGD(Optimizer):
    def __init__(self, parameters, lr: float = 0.01, momentum: float = 0.0, dampening: float = 0.0, nesterov: bool = False, weight_decay: float = 0.0):
        super().__init__(parameters, lr, weight_decay)
        self.momentum, self.dampening, self.nesterov = momentum, dampening, nesterov

    def update(self, p, g, s):
        if self.momentum:
            s["v"] = self.momentum * s["v"] + (1 - self.dampening) * g if "v" in s else g
            g = g + self.momentum * s["v"] if self.nesterov else s["v"]
        return self.lr * g


class Adam(Optimizer):
    def __init__(self, parameters, lr: float = 1e-3, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, weight_decay: float = 0.0, amsgrad: bool = False):
        super().__init__(parameters, lr, weight_decay)
        self.betas, self.eps, self.amsgrad = betas, eps, amsgrad

    def _moments(self, g, s):
        m = self._mean(s, "m", g, self.betas[0]) / (1 - self.betas[0] ** self.t)
        v = self._mean(s, "v", g * g, self.betas[1])
        if self.amsgrad:
            v = s["top"] = np.maximum(s.get("top", 0.0), v)
        return m, np.sqrt(v / (1 - self.betas[1] ** self.t)) + self.eps

    def update(self, p, g, s):
        m, root = self._moments(g, s)
        return self.lr * m / root


class AdamW(Adam):
    """Weight decay beside the gradient, not in it."""

    def __init__(self, parameters, lr: float = 1e-3, betas=(0.9, 0.999), eps: float = 1e-8, weight_decay: float = 0.01, amsgrad: bool = False):
        super().__init__(parameters, lr, betas, eps, weight_decay, amsgrad)

    def _decayed(self, p):
        return p.grad

    def update(self, p, g, s):
        return super().update(p, g, s) + self.lr * self.weight_decay * p.data


class Nadam(Adam):
    def update(self, p, g, s):
        m, root = self._moments(g, s)
        return self.lr * (self.betas[0] * m + (1 - self.betas[0]) * g / (1 - self.betas[0] ** self.t)) / root


class RMSprop(Optimizer):
    def __init__(self, parameters, lr: float = 0.01, alpha: float = 0.99, eps: float = 1e-8, weight_decay: float = 0.0, momentum: float = 0.0, centered: bool = False):
        super().__init__(parameters, lr, weight_decay)
        self.alpha, self.eps, self.momentum, self.centered = alpha, eps, momentum, centered

    def update(self, p, g, s):
        v = self._mean(s, "v", g * g, self.alpha)
        if self.centered:
            v = v - self._mean(s, "g", g, self.alpha) ** 2
        step = g / (np.sqrt(np.maximum(v, 0)) + self.eps)
        if self.momentum:
            step = s["b"] = self.momentum * s.get("b", 0.0) + step
        return self.lr * step


class Adagrad(Optimizer):
    def __init__(self, parameters, lr: float = 0.01, eps: float = 1e-10, weight_decay: float = 0.0, lr_decay: float = 0.0):
        super().__init__(parameters, lr, weight_decay)
        self.eps, self.lr_decay = eps, lr_decay

    def update(self, p, g, s):
        s["v"] = s.get("v", 0.0) + g * g
        return self.lr / (1 + (self.t - 1) * self.lr_decay) * g / (np.sqrt(s["v"]) + self.eps)


class AdaDelta(Optimizer):
    def __init__(self, parameters, lr: float = 1.0, rho: float = 0.9, eps: float = 1e-6, weight_decay: float = 0.0):
        super().__init__(parameters, lr, weight_decay)
        self.rho, self.eps = rho, eps

    def update(self, p, g, s):
        v = self._mean(s, "v", g * g, self.rho)
        step = np.sqrt(s.get("d", np.zeros_like(g)) + self.eps) / np.sqrt(v + self.eps) * g
        self._mean(s, "d", step * step, self.rho)
        return self.lr * step


class LRScheduler:
    """rate(epoch, base) says the rate; ``step`` moves to the next epoch."""

    def __init__(self, optimizer: Optimizer, rate: Callable[[int, float], float]):
        self.optimizer, self.rate, self.base, self.epoch = optimizer, rate, optimizer.lr, 0
        optimizer.lr = rate(0, self.base)

    def step(self) -> float:
        self.epoch += 1
        self.optimizer.lr = self.rate(self.epoch, self.base)
        return self.optimizer.lr


def step_lr(o, step: int, gamma: float = 0.1):
    return LRScheduler(o, lambda e, b: b * gamma ** (e // step))


def exponential_lr(o, gamma: float):
    return LRScheduler(o, lambda e, b: b * gamma**e)


def cosine_lr(o, total: int, low: float = 0.0):
    return LRScheduler(o, lambda e, b: low + (b - low) * (1 + math.cos(math.pi * e / total)) / 2)


def multi_step_lr(o, milestones: Sequence[int], gamma: float = 0.1):
    return LRScheduler(o, lambda e, b: b * gamma ** sum(e >= m for m in milestones))


def linear_lr(o, start: float = 1 / 3, end: float = 1.0, total: int = 5):
    return LRScheduler(o, lambda e, b: b * (start + (end - start) * min(e, total) / total))


def warmup_lr(o, warm: int):
    return LRScheduler(o, lambda e, b: b * min(1.0, (e + 1) / warm))


def one_cycle_lr(o, top: float, total: int, start: float = 0.3, divide: float = 25.0, final: float = 1e4):
    """A straight rise to the top, then a cosine down."""
    up, low = max(1, int(total * start)), top / divide

    def rate(e: int, _: float) -> float:
        if e < up:
            return low + (top - low) * e / up
        return top / final + (top - top / final) * (1 + math.cos(math.pi * min(1.0, (e - up) / max(1, total - up)))) / 2

    return LRScheduler(o, rate)


class ReduceLROnPlateau:
    def __init__(self, optimizer: Optimizer, factor: float = 0.1, patience: int = 10, threshold: float = 1e-4, low: float = 0.0):
        self.optimizer, self.factor, self.patience, self.threshold, self.low = optimizer, factor, patience, threshold, low
        self.best, self.bad = math.inf, 0

    def step(self, value: float) -> float:
        self.best, self.bad = (value, 0) if value < self.best * (1 - self.threshold) else (self.best, self.bad + 1)
        if self.bad > self.patience:
            self.optimizer.lr, self.bad = max(self.optimizer.lr * self.factor, self.low), 0
        return self.optimizer.lr


def fit_table(df, model, loss: Callable, optimizer: Optimizer, features: Sequence[str], target: str, steps: int = 20, partitions: int | None = None) -> list[float]:
    """Full-batch training on a table: each task sums the gradients of its rows, Spark adds the sums up, the driver steps.

    loss averages over the rows it is given; one row a partition travels, of the size of the parameters.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    rows = df.select(*(F.col(c).cast("double").alias(c) for c in features), F.col(target).cast("double").alias("__y")).dropna()
    rows = (rows.repartition(partitions) if partitions else rows).persist()
    history = []
    try:
        for _ in range(steps):
            state = model.state_dict()

            def gradients(batches, state=state):
                model.load_state_dict(state)
                model.zero_grad()
                n, total = 0, 0.0
                for b in batches:
                    value = loss(model(b[list(features)].to_numpy()), b["__y"].to_numpy())
                    (value * float(len(b))).backward()
                    n, total = n + len(b), total + value.item() * len(b)
                flat = np.concatenate([(p.grad if p.grad is not None else np.zeros(p.shape)).ravel() for p in model.parameters()])
                yield pd.DataFrame({"k": np.arange(len(flat) + 2), "g": np.concatenate(([n, total], flat))})

            summed = {r.k: r.g for r in rows.mapInPandas(gradients, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).collect()}
            n, at = max(1.0, summed.get(0, 0.0)), 2
            for p in model.parameters():
                p.grad = np.array([summed.get(k, 0.0) for k in range(at, at + p.data.size)]).reshape(p.shape) / n
                at += p.data.size
            optimizer.step()
            history.append(summed.get(1, 0.0) / n)
    finally:
        rows.unpersist()
    return history
