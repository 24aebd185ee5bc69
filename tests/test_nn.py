"""Gradients against differences, optimisers on a bowl, layers' shapes, training on a table."""

import numpy as np
import pytest

from quillframe.nn import layers, losses, optim
from quillframe.nn.autograd import Tensor, no_grad, parameter
from quillframe.sources import generated

RNG = np.random.default_rng(0)


def slope(f, x, eps=1e-6):
    g = np.zeros_like(x)
    for i in np.ndindex(*x.shape):
        up, down = x.copy(), x.copy()
        up[i] += eps
        down[i] -= eps
        g[i] = (f(Tensor(up)).item() - f(Tensor(down)).item()) / (2 * eps)
    return g


FUNCTIONS = {
    "chain": lambda x: ((x * x + 1.0).sqrt().log() / 2.0 - x.tanh()).sum(), "softmax": lambda x: (x.softmax(-1) * np.arange(4.0)).sum(), "log_softmax": lambda x: x.log_softmax(0)[1].sum(),
    "gelu": lambda x: x.gelu().sum(), "mish": lambda x: x.mish().sum(), "swish": lambda x: x.swish().mean(), "elu": lambda x: x.elu().sum(), "leaky": lambda x: x.leaky_relu().sum(),
    "max": lambda x: x.max(axis=1).sum(), "var": lambda x: x.var(0).sum(), "matmul": lambda x: (x @ x.transpose()).sum(), "norm": lambda x: (layers.LayerNorm(4)(x) ** 2 * np.arange(4.0)).sum(),
    "conv": lambda x: (layers.Conv2d(1, 2, 2, padding=1)(x.reshape(1, 1, 3, 4)) ** 2).sum(), "pool": lambda x: layers.MaxPool2d(2, 1)(x.reshape(1, 1, 3, 4)).sum(), "lstm": lambda x: layers.LSTM(4, 3)(x.reshape(1, 3, 4))[0].sum(),
    "gru": lambda x: layers.GRU(4, 3)(x.reshape(1, 3, 4))[0].sum(), "rnn": lambda x: layers.RNN(4, 3)(x.reshape(1, 3, 4))[0].sum(), "attention": lambda x: (layers.MultiheadAttention(4, 2)(x.reshape(1, 3, 4)) ** 2).sum(),
    "cross_entropy": lambda x: losses.cross_entropy(x, np.array([0, 3, 1])), "logits": lambda x: losses.binary_cross_entropy_with_logits(x, np.ones((3, 4)) * 0.3), "huber": lambda x: losses.huber_loss(x, np.zeros((3, 4)), 0.5),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_gradients(name):
    x = RNG.normal(size=(3, 4))
    p = parameter(x)
    FUNCTIONS[name](p).backward()
    assert p.grad == pytest.approx(slope(FUNCTIONS[name], x), abs=1e-5)


def test_no_grad_and_state():
    with no_grad():
        assert not (parameter([1.0]) * 2.0).requires_grad
    a, b = (layers.Sequential(layers.Linear(3, 4, seed=s), layers.BatchNorm1d(4), layers.ReLU(), layers.Linear(4, 2, seed=s)) for s in (1, 2))
    a(RNG.normal(size=(8, 3)))
    b.load_state_dict(a.state_dict())
    x = RNG.normal(size=(5, 3))
    assert a.eval()(x).data == pytest.approx(b.eval()(x).data)
    assert layers.TransformerEncoderLayer(8, 2, 16).eval()(RNG.normal(size=(2, 5, 8))).shape == (2, 5, 8)


@pytest.mark.parametrize("make", [lambda p: optim.SGD(p, 0.1, 0.9, nesterov=True), lambda p: optim.Adam(p, 0.1), lambda p: optim.AdamW(p, 0.1), lambda p: optim.Nadam(p, 0.1), lambda p: optim.RMSprop(p, 0.05), lambda p: optim.Adagrad(p, 0.5), lambda p: optim.AdaDelta(p, 5.0)])
def test_optimisers(make):
    p = parameter([3.0, -2.0])
    o = make([p])
    for _ in range(300):
        o.zero_grad()
        (p * p).sum().backward()
        o.step()
    assert np.abs(p.data).max() < 0.3


def test_schedules():
    o = optim.SGD([], 1.0)
    s = optim.step_lr(o, 2, 0.5)
    assert [s.step() for _ in range(4)] == [1.0, 0.5, 0.5, 0.25]
    o.lr = 1.0
    c = optim.cosine_lr(o, 4)
    assert [round(c.step(), 6) for _ in range(4)] == [0.853553, 0.5, 0.146447, 0.0]
    o.lr = 1.0
    r = optim.ReduceLROnPlateau(o, 0.5, 1)
    assert [r.step(v) for v in (1.0, 1.0, 1.0, 1.0)] == [1.0, 1.0, 0.5, 0.5]


def test_training_on_a_table(spark):
    d = generated.make_regression(spark, 200, [1.0, -2.0], 0.0)
    m = layers.Linear(2, 1)
    history = optim.fit_table(d, m, lambda p, y: losses.mse_loss(p.reshape(-1), y), optim.SGD(m.parameters(), 0.3), ["x0", "x1"], "y", 12)
    assert history[-1] < 0.01 * history[0]
    assert m.weight.data[0] == pytest.approx([1, -2], abs=0.1)
