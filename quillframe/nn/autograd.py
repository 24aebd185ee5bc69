"""Arrays with gradients, by a tape of numpy operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

import numpy as np

from quillframe.errors import ShapeError

_recording = [True]


@contextmanager
def no_grad():
    _recording.append(False)
    try:
        yield
    finally:
        _recording.pop()


@contextmanager
def with_grad():
    """Records inside no_grad."""
    _recording.append(True)
    try:
        yield
    finally:
        _recording.pop()


def _fitted(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """g summed over what broadcasting repeated."""
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for k, n in enumerate(shape):
        if n == 1 and g.shape[k] != 1:
            g = g.sum(axis=k, keepdims=True)
    return g


class Tensor:
    __slots__ = ("back", "data", "grad", "parents", "requires_grad")

    def __init__(self, data, requires_grad: bool = False, parents: Sequence[Tensor] = (), back: Callable | None = None):
        self.data = np.asarray(data, float)
        tracked = _recording[-1] and any(p.requires_grad for p in parents)
        self.requires_grad = requires_grad or tracked
        self.grad: np.ndarray | None = None
        self.parents, self.back = (tuple(parents), back) if tracked else ((), None)

    @property
    def shape(self) -> tuple[int, ...]:
        return self.data.shape

    def item(self) -> float:
        return float(self.data.reshape(-1)[0])

    def detach(self) -> Tensor:
        return Tensor(self.data)

    def zero_grad(self) -> None:
        self.grad = None

    def backward(self, grad=None) -> None:
        if grad is None and self.data.size != 1:
            raise ShapeError("a gradient is needed for more than one number")
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p in node.parents]
        grads = {id(self): np.ones_like(self.data) if grad is None else np.asarray(grad, float)}
        for node in reversed(order):
            g = grads.pop(id(node), None)
            if g is None:
                continue
            if not node.parents:
                if node.requires_grad:
                    node.grad = g if node.grad is None else node.grad + g
                continue
            for p, own in zip(node.parents, node.back(g), strict=True):
                if p.requires_grad and own is not None:
                    own = _fitted(own, p.shape)
                    grads[id(p)] = grads[id(p)] + own if id(p) in grads else own

    # -- arithmetic

    def __add__(self, o):
        o = tensor(o)
        return Tensor(self.data + o.data, False, (self, o), lambda g: (g, g))

    def __mul__(self, o):
        o = tensor(o)
        return Tensor(self.data * o.data, False, (self, o), lambda g: (g * o.data, g * self.data))

    def __truediv__(self, o):
        o = tensor(o)
        return Tensor(self.data / o.data, False, (self, o), lambda g: (g / o.data, -g * self.data / o.data**2))

    def __pow__(self, n: float):
        return Tensor(self.data**n, False, (self,), lambda g: (g * n * self.data ** (n - 1),))

    def __matmul__(self, o):
        o = tensor(o)
        if self.data.ndim < 2 or o.data.ndim < 2:
            raise ShapeError("matrices are needed")
        return Tensor(self.data @ o.data, False, (self, o), lambda g: (g @ np.swapaxes(o.data, -1, -2), np.swapaxes(self.data, -1, -2) @ g))

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + -tensor(o)

    def __rsub__(self, o):
        return tensor(o) + -self

    __radd__, __rmul__ = __add__, __mul__

    def __rtruediv__(self, o):
        return tensor(o) / self

    def __getitem__(self, at):
        def back(g):
            out = np.zeros_like(self.data)
            np.add.at(out, at, g)
            return (out,)

        return Tensor(self.data[at], False, (self,), back)

    # -- shapes

    def reshape(self, *shape):
        return Tensor(self.data.reshape(*shape), False, (self,), lambda g: (g.reshape(self.shape),))

    def transpose(self, *axes):
        axes = axes or tuple(reversed(range(self.data.ndim)))
        return Tensor(self.data.transpose(axes), False, (self,), lambda g: (g.transpose(np.argsort(axes)),))

    # -- reductions

    def sum(self, axis=None, keepdims: bool = False):
        def back(g):
            return (np.broadcast_to(g if axis is None or keepdims else np.expand_dims(g, axis), self.shape).copy(),)

        return Tensor(self.data.sum(axis=axis, keepdims=keepdims), False, (self,), back)

    def mean(self, axis=None, keepdims: bool = False):
        n = self.data.size if axis is None else np.prod([self.shape[a] for a in np.atleast_1d(axis)])
        return self.sum(axis, keepdims) * (1.0 / n)

    def var(self, axis=None, keepdims: bool = False):
        d = self - self.mean(axis, True)
        return (d * d).mean(axis, keepdims)

    def max(self, axis=None, keepdims: bool = False):
        top = self.data.max(axis=axis, keepdims=True)
        out = top if keepdims else top.reshape(self.data.max(axis=axis).shape)

        def back(g):
            hit = self.data == top
            wide = g if axis is None or keepdims else np.expand_dims(g, axis)
            return (hit * wide / hit.sum(axis=axis, keepdims=True),)

        return Tensor(out, False, (self,), back)

    # -- functions

    def _map(self, value: np.ndarray, slope: np.ndarray):
        return Tensor(value, False, (self,), lambda g: (g * slope,))

    def exp(self):
        e = np.exp(self.data)
        return self._map(e, e)

    def log(self):
        return self._map(np.log(self.data), 1 / self.data)

    def sqrt(self):
        r = np.sqrt(self.data)
        return self._map(r, 0.5 / r)

    def abs(self):
        return self._map(np.abs(self.data), np.sign(self.data))

    def clip(self, low: float, high: float):
        return self._map(np.clip(self.data, low, high), ((self.data >= low) & (self.data <= high)).astype(float))

    def tanh(self):
        t = np.tanh(self.data)
        return self._map(t, 1 - t * t)

    def sigmoid(self):
        s = 1 / (1 + np.exp(-np.clip(self.data, -700, 700)))
        return self._map(s, s * (1 - s))

    def relu(self):
        return self._map(np.maximum(self.data, 0), (self.data > 0).astype(float))

    def leaky_relu(self, alpha: float = 0.01):
        slope = np.where(self.data > 0, 1.0, alpha)
        return self._map(self.data * slope, slope)

    def elu(self, alpha: float = 1.0):
        low = alpha * np.expm1(np.minimum(self.data, 0))
        return self._map(np.where(self.data > 0, self.data, low), np.where(self.data > 0, 1.0, low + alpha))

    def softplus(self):
        value = np.maximum(self.data, 0) + np.log1p(np.exp(-np.abs(self.data)))
        return self._map(value, 1 / (1 + np.exp(-np.clip(self.data, -700, 700))))

    def gelu(self):
        return self * 0.5 * (((self + self**3 * 0.044715) * 0.7978845608028654).tanh() + 1.0)

    def swish(self):
        return self * self.sigmoid()

    def mish(self):
        return self * self.softplus().tanh()

    def softmax(self, axis: int = -1):
        e = (self - Tensor(self.data.max(axis=axis, keepdims=True))).exp()
        return e / e.sum(axis, True)

    def log_softmax(self, axis: int = -1):
        d = self - Tensor(self.data.max(axis=axis, keepdims=True))
        return d - d.exp().sum(axis, True).log()


def tensor(x) -> Tensor:
    return x if isinstance(x, Tensor) else Tensor(x)


def parameter(x) -> Tensor:
    return Tensor(x, True)


def concatenate(parts: Sequence[Tensor], axis: int = 0) -> Tensor:
    cuts = np.cumsum([p.shape[axis] for p in parts])[:-1]
    return Tensor(np.concatenate([p.data for p in parts], axis), False, tuple(parts), lambda g: tuple(np.split(g, cuts, axis)))


def stack(parts: Sequence[Tensor], axis: int = 0) -> Tensor:
    return Tensor(np.stack([p.data for p in parts], axis), False, tuple(parts), lambda g: tuple(np.moveaxis(g, axis, 0)))


def dropout_mask(shape: tuple[int, ...], p: float, seed: int = 0) -> np.ndarray:
    """0 with probability p, else what keeps the mean: 1 / (1 - p)."""
    return (np.random.default_rng(seed).random(shape) >= p) / (1 - p)


def dropout(x, p: float = 0.5, training: bool = True, seed: int = 0) -> Tensor:
    x = tensor(x)
    return x * dropout_mask(x.shape, p, seed) if training and p else x


def folded(cells: Tensor, shape: tuple[int, int, int, int], kernel: tuple[int, int], stride: tuple[int, int] = (1, 1), padding: tuple[int, int] = (0, 0)) -> Tensor:
    """What ``patches`` spread out, summed up again at its place: (batch, channels, height, width) of the given shape."""
    image = parameter(np.zeros(shape))
    with with_grad():
        patches(image, kernel, stride, padding).backward(tensor(cells).data)
    return Tensor(image.grad, False, (tensor(cells),), lambda g: (patches(Tensor(g), kernel, stride, padding).data,))


def patches(x: Tensor, kernel: tuple[int, int], stride: tuple[int, int] = (1, 1), padding: tuple[int, int] = (0, 0)) -> Tensor:
    """(batch, channels, height, width) to (batch, positions, channels * kernel), as convolutions multiply them."""
    b, c, h, w = x.shape
    (kh, kw), (sh, sw), (ph, pw) = kernel, stride, padding
    oh, ow = (h + 2 * ph - kh) // sh + 1, (w + 2 * pw - kw) // sw + 1
    rows = (np.arange(oh) * sh)[:, None, None, None] + np.arange(kh)[None, None, :, None]
    cols = (np.arange(ow) * sw)[None, :, None, None] + np.arange(kw)[None, None, None, :]
    rows, cols = np.broadcast_arrays(rows, cols)
    padded = np.pad(x.data, ((0, 0), (0, 0), (ph, ph), (pw, pw)))
    out = padded[:, :, rows, cols].transpose(0, 2, 3, 1, 4, 5).reshape(b, oh * ow, c * kh * kw)

    def back(g):
        full = np.zeros_like(padded)
        np.add.at(full, (slice(None), slice(None), rows, cols), g.reshape(b, oh, ow, c, kh, kw).transpose(0, 3, 1, 2, 4, 5))
        return (full[:, :, ph : ph + h, pw : pw + w],)

    return Tensor(out, False, (x,), back)
