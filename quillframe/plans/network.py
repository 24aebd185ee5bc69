"""Queries on neural networks: layers with set weights over tables, losses, gradients, optimisers and schedules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillframe.nn import autograd, layers, losses, optim, table
from quillframe.plans.registry import query

E = "(embedding::DOUBLE[])"


def _set(model, **weights):
    for name, value in weights.items():
        own = getattr(model, name)
        own.data[...] = np.asarray(value, float).reshape(own.shape)
    return model


def _outputs(t, model, shape, **picked):
    """vec_id and the outputs at the named places, rounded."""
    out = table.forward(t.embeddings.select("vec_id", "embedding"), model, "embedding", shape)
    return out.select("vec_id", *(F.round(F.get("output", k), 6).alias(n) for n, k in picked.items()))


def _select(**parts):
    return "SELECT vec_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in parts.items()) + " FROM embeddings"


# -- layers ---------------------------------------------------------------------------------------------------------

_WEIGHTS = np.stack([(np.arange(64) + 1) / 100, (np.arange(64) % 5 - 2) / 10])


def _weighted(row, bias):
    return f"{bias} + " + " + ".join(f"{float(w):.4f} * {E}[{k + 1}]" for k, w in enumerate(_WEIGHTS[row]))


@query("nn_linear", _select(a=_weighted(0, 0.5), b=_weighted(1, -0.25)))
def nn_linear(t):
    return _outputs(t, _set(layers.Linear(64, 2), weight=_WEIGHTS, bias=[0.5, -0.25]), (64,), a=0, b=1)


@query("nn_sequential", _select(a=f"greatest({_weighted(0, 0.5)}, 0)", b=f"greatest({_weighted(1, -0.25)}, 0)"))
def nn_sequential(t):
    model = layers.Sequential(layers.Linear(64, 2), layers.ReLU())
    state = model.state_dict()
    model.load_state_dict(dict(zip(state, (_WEIGHTS, np.array([0.5, -0.25])), strict=True)))
    return _outputs(t, model.eval(), (64,), a=0, b=1)


_KERNEL = (np.arange(9) + 1) / 10


def _convolved(r, c):
    return "0.1 + " + " + ".join(f"{float(_KERNEL[u * 3 + v])} * {E}[{(r + u) * 8 + c + v + 1}]" for u in range(3) for v in range(3))


@query("nn_conv2d", _select(first=_convolved(0, 0), middle=_convolved(2, 3), last=_convolved(5, 5)))
def nn_conv2d(t):
    return _outputs(t, _set(layers.Conv2d(1, 1, 3), weight=_KERNEL, bias=[0.1]), (1, 8, 8), first=0, middle=2 * 6 + 3, last=35)


@query("nn_conv1d", _select(first=f"0.5 * {E}[1] - {E}[2] + 2 * {E}[3]", padded=f"0.5 * {E}[61] - {E}[62] + 2 * {E}[63]"))
def nn_conv1d(t):
    model = layers.Conv1d(1, 1, 3, stride=2, bias=False)
    _set(model.inner, weight=[0.5, -1.0, 2.0])
    return _outputs(t, model, (1, 64), first=0, padded=30)


def _cell(r, c):
    return [f"{E}[{(2 * r + u) * 8 + 2 * c + v + 1}]" for u in range(2) for v in range(2)]


@query("nn_max_pool", _select(first=f"greatest({', '.join(_cell(0, 0))})", last=f"greatest({', '.join(_cell(3, 3))})"))
def nn_max_pool(t):
    return _outputs(t, layers.MaxPool2d(2), (1, 8, 8), first=0, last=15)


@query("nn_avg_pool", _select(first=f"({' + '.join(_cell(0, 0))}) / 4", last=f"({' + '.join(_cell(3, 3))}) / 4"))
def nn_avg_pool(t):
    return _outputs(t, layers.AvgPool2d(2), (1, 8, 8), first=0, last=15)


@query("nn_patches", _select(a=f"{E}[{(1 + 0) * 8 + 4 + 2 + 1}]", b=f"{E}[{(5 + 2) * 8 + 5 + 2 + 1}]"))
def nn_patches(t):
    return _outputs(t, lambda x: autograd.patches(x, (3, 3)), (1, 8, 8), a=(1 * 6 + 4) * 9 + 2, b=35 * 9 + 8)


@query("nn_folded", _select(corner=f"{E}[1]", side=f"3 * {E}[5]", inside=f"9 * {E}[28]"))
def nn_folded(t):
    return _outputs(t, lambda x: autograd.folded(autograd.patches(x, (3, 3)), x.shape, (3, 3)), (1, 8, 8), corner=0, side=4, inside=27)


@query("nn_layer_norm", _select(a=f"({E}[1] - list_avg({E})) / sqrt(list_var_pop({E}) + 1e-5)", b=f"({E}[64] - list_avg({E})) / sqrt(list_var_pop({E}) + 1e-5)"))
def nn_layer_norm(t):
    return _outputs(t, layers.LayerNorm(64), (64,), a=0, b=63)


@query("nn_batch_norm", _select(a=f"({E}[1] - 0.1) / sqrt(2 + 1e-5)", b=f"({E}[2] - 0.1) / sqrt(2 + 1e-5) * 3 + 1"))
def nn_batch_norm(t):
    model = layers.BatchNorm1d(64).eval()
    model.running_mean[:], model.running_var[:] = 0.1, 2.0
    model.weight.data[1], model.bias.data[1] = 3.0, 1.0
    return _outputs(t, model, (64,), a=0, b=1)


@query("nn_batch_norm_moments", "SELECT round(0.1 * avg(embedding[1]::DOUBLE), 6) AS mean, round(0.9 + 0.1 * var_samp(embedding[1]::DOUBLE), 6) AS var FROM embeddings")
def nn_batch_norm_moments(t):
    def moments(batch: pd.DataFrame) -> pd.DataFrame:  # one group of a few hundred rows: a training batch
        model = layers.BatchNorm1d(1)
        model(batch[["x"]].to_numpy(float))
        return pd.DataFrame({"mean": model.running_mean.round(6), "var": model.running_var.round(6)})

    return t.embeddings.select(F.lit(1).alias("k"), F.get("embedding", 0).alias("x")).groupBy("k").applyInPandas(moments, "mean double, var double")


@query("nn_dropout", f"SELECT vec_id, round({E}[1], 6) AS kept, true AS scaled FROM embeddings")
def nn_dropout(t):
    still, active = layers.Dropout(0.5).eval(), layers.Dropout(0.25)

    def model(x):
        dropped = autograd.dropout(x, 0.25, seed=3).data
        twice = active(x).data
        fits = lambda y: (np.isclose(y, 0) | np.isclose(y, x.data / 0.75)).all(axis=1)
        return autograd.tensor(np.column_stack([still(x).data[:, 0], fits(dropped) & fits(twice) & (autograd.dropout(x, 0.25, training=False).data == x.data).all(axis=1)]))

    out = table.forward(t.embeddings.select("vec_id", "embedding"), model, "embedding", (64,))
    return out.select("vec_id", F.round(F.get("output", 0), 6).alias("kept"), (F.get("output", 1) == 1).alias("scaled"))


_X = f"{E}[1]"
_ACTIVATIONS = {
    "relu": (layers.ReLU, f"greatest({_X}, 0)"), "sigmoid": (layers.Sigmoid, f"1 / (1 + exp(-{_X}))"), "tanh": (layers.Tanh, f"tanh({_X})"),
    "leaky": (layers.LeakyReLU, f"CASE WHEN {_X} > 0 THEN {_X} ELSE 0.01 * {_X} END"), "elu": (layers.ELU, f"CASE WHEN {_X} > 0 THEN {_X} ELSE exp({_X}) - 1 END"),
    "gelu": (layers.GELU, f"0.5 * {_X} * (1 + tanh(0.7978845608028654 * ({_X} + 0.044715 * {_X} * {_X} * {_X})))"), "softplus": (layers.Softplus, f"ln(1 + exp({_X}))"),
    "swish": (layers.Swish, f"{_X} / (1 + exp(-{_X}))"), "mish": (layers.Mish, f"{_X} * tanh(ln(1 + exp({_X})))"),
    "softmax": (layers.Softmax, f"exp({_X}) / list_sum(list_transform({E}, lambda x: exp(x)))"), "log_softmax": (layers.LogSoftmax, f"{_X} - ln(list_sum(list_transform({E}, lambda x: exp(x))))"),
}


@query("nn_activations", _select(**{k: sql for k, (_, sql) in _ACTIVATIONS.items()}))
def nn_activations(t):
    made = [make() for make, _ in _ACTIVATIONS.values()]
    return _outputs(t, lambda x: autograd.stack([f(x)[:, 0] for f in made], 1), (64,), **{k: i for i, k in enumerate(_ACTIVATIONS)})


# -- sequences: the first three numbers of a row, one at a time, through one hidden unit ------------------------------------


def _steps(step, start, columns):
    """A chain of subqueries, each a time step over the state before."""
    sql = f"(SELECT vec_id, {E} AS e, {start} FROM embeddings)"
    for k in range(1, 4):
        sql = step(k, sql)
    return f"SELECT vec_id, {columns} FROM {sql}"


def _sequence(t, model):
    out = table.forward(t.embeddings.select("vec_id", "embedding"), lambda x: model(x.reshape(x.shape[0], 64, 1)[:, :3])[0], "embedding", (64,))
    return out.select("vec_id", F.round(F.get("output", 2), 6).alias("h"))


@query("nn_rnn", _steps(lambda k, sql: f"(SELECT vec_id, e, tanh(0.5 * e[{k}] + 0.1 + 0.8 * h - 0.2) AS h FROM {sql})", "0.0 AS h", "round(h, 6) AS h"))
def nn_rnn(t):
    return _sequence(t, _set(layers.RNN(1, 1), w_x=[0.5], b_x=[0.1], w_h=[0.8], b_h=[-0.2]))


def _gate(w, b, u, x="x"):
    return f"({w} * {x} + {b} + {u} * h)"


def _lstm_step(k, sql):
    s = lambda v: f"(1 / (1 + exp(-{v})))"
    c = f"{s(_gate(0.2, 0.4, -0.3))} * c + {s(_gate(0.5, 0.1, 0.6))} * tanh({_gate(-0.7, 0.2, 0.4)})"
    return f"(SELECT vec_id, e, c, o * tanh(c) AS h FROM (SELECT vec_id, e, {c} AS c, {s(_gate(0.9, -0.1, 0.3))} AS o FROM (SELECT vec_id, e, e[{k}] AS x, h, c FROM {sql})))"


@query("nn_lstm", _steps(_lstm_step, "0.0 AS h, 0.0 AS c", "round(h, 6) AS h"))
def nn_lstm(t):
    return _sequence(t, _set(layers.LSTM(1, 1), w_x=[0.5, 0.2, -0.7, 0.9], b_x=[0.1, 0.4, 0.2, -0.1], w_h=[0.6, -0.3, 0.4, 0.3], b_h=np.zeros(4)))


def _gru_step(k, sql):
    s = lambda v: f"(1 / (1 + exp(-{v})))"
    new = f"tanh(-0.7 * x + 0.2 + {s(_gate(0.5, 0.1, 0.6))} * (0.4 * h + 0.3))"
    return f"(SELECT vec_id, e, (1 - z) * n + z * h AS h FROM (SELECT vec_id, e, h, {s(_gate(0.2, 0.4, -0.3))} AS z, {new} AS n FROM (SELECT vec_id, e, e[{k}] AS x, h FROM {sql})))"


@query("nn_gru", _steps(_gru_step, "0.0 AS h", "round(h, 6) AS h"))
def nn_gru(t):
    return _sequence(t, _set(layers.GRU(1, 1), w_x=[0.5, 0.2, -0.7], b_x=[0.1, 0.4, 0.2], w_h=[0.6, -0.3, 0.4], b_h=[0.0, 0.0, 0.3]))


def _identity(attention):
    for part in (attention.q, attention.k, attention.v, attention.out):
        _set(part, weight=np.eye(2), bias=[0, 0])
    return attention


#: the first two tokens of two numbers: scores of the first, their weights, and the mix of the tokens
_TOKENS = f"(SELECT vec_id, {E}[1] AS a, {E}[2] AS b, {E}[3] AS c, {E}[4] AS d FROM embeddings)"
_MIXED = f"(SELECT vec_id, a, b, (p * a + q * c) / (p + q) AS x, (p * b + q * d) / (p + q) AS y FROM (SELECT *, exp((a * a + b * b) / sqrt(2)) AS p, exp((a * c + b * d) / sqrt(2)) AS q FROM {_TOKENS}))"


@query("nn_attention", f"SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM {_MIXED}")
def nn_attention(t):
    model = _identity(layers.MultiheadAttention(2, 1))
    return _outputs(t, lambda x: model(x[:, :4].reshape(x.shape[0], 2, 2)), (64,), x=0, y=1)


def _norm2(sql):
    """LayerNorm over two numbers x and y."""
    return f"(SELECT vec_id, (x - y) / 2 / sqrt((x - y) * (x - y) / 4 + 1e-5) AS x, (y - x) / 2 / sqrt((x - y) * (x - y) / 4 + 1e-5) AS y FROM {sql})"


@query("nn_transformer", "SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM " + _norm2(f"(SELECT vec_id, x + greatest(x, 0) AS x, y + greatest(y, 0) AS y FROM {_norm2(f'(SELECT vec_id, a + x AS x, b + y AS y FROM {_MIXED})')})"))
def nn_transformer(t):
    model = layers.TransformerEncoderLayer(2, 1, inner=2, dropout=0.0)
    _identity(model.attention)
    _set(model.up, weight=np.eye(2), bias=[0, 0])
    _set(model.down, weight=np.eye(2), bias=[0, 0])
    return _outputs(t, lambda x: model(x[:, :4].reshape(x.shape[0], 2, 2)), (64,), x=0, y=1)


# -- losses and gradients -------------------------------------------------------------------------------------------

_LOSSES = {
    "mse": (losses.mse_loss, "avg((p - y) * (p - y))"), "mae": (losses.mae_loss, "avg(abs(p - y))"), "rmse": (losses.rmse_loss, "sqrt(avg((p - y) * (p - y)))"),
    "huber": (losses.huber_loss, "avg(CASE WHEN abs(p - y) <= 1 THEN 0.5 * (p - y) * (p - y) ELSE abs(p - y) - 0.5 END)"),
    "bce": (lambda p, y: losses.binary_cross_entropy(1 / (1 + np.exp(-p)), y > 0), "avg(CASE WHEN y > 0 THEN ln(1 + exp(-p)) ELSE ln(1 + exp(p)) END)"),
    "bce_logits": (lambda p, y: losses.binary_cross_entropy_with_logits(p, y > 0), "avg(CASE WHEN y > 0 THEN ln(1 + exp(-p)) ELSE ln(1 + exp(p)) END)"),
    "cross": (lambda p, y: losses.cross_entropy(np.stack([p, y], 1), (p > 0).astype(int)), "avg(ln(exp(p) + exp(y)) - CASE WHEN p > 0 THEN y ELSE p END)"),
}


@query("nn_losses", "SELECT label, " + ", ".join(f"round({sql}, 6) AS {k}" for k, (_, sql) in _LOSSES.items()) + f" FROM (SELECT label, 3 * {E}[1] AS p, 3 * {E}[2] AS y FROM embeddings) GROUP BY label")
def nn_losses(t):
    def scored(group: pd.DataFrame) -> pd.DataFrame:
        p, y = group["p"].to_numpy(), group["y"].to_numpy()
        return pd.DataFrame({"label": group["label"].iloc[:1], **{k: [round(f(p, y).item(), 6)] for k, (f, _) in _LOSSES.items()}})

    d = t.embeddings.select("label", *((F.get("embedding", k).cast("double") * 3).alias(n) for k, n in ((0, "p"), (1, "y"))))
    return d.groupBy("label").applyInPandas(scored, f"label {t.embeddings.schema['label'].dataType.simpleString()}, " + ", ".join(f"{k} double" for k in _LOSSES))


@query(
    "nn_gradients",
    _select(x=f"2 * {_X} * (1 - tanh({_X} * {_X}) ** 2) + exp({_X})", y=f"2 / ({E}[2] * {E}[2] + 1) - 2 * {E}[2] * (2 * {E}[2] + 1) / ({E}[2] * {E}[2] + 1) ** 2", none="0"),
)
def nn_gradients(t):
    def model(x):
        with autograd.with_grad():  # forward() itself records nothing
            a, b = autograd.parameter(x.data[:, 0]), autograd.parameter(x.data[:, 1])
            (((a * a).tanh() + a.exp()).sum() + ((b * 2 + 1) / (b**2 + 1)).sum()).backward()
            with autograd.no_grad():
                untracked = (a * 2).requires_grad
        return autograd.tensor(np.column_stack([a.grad, b.grad, np.full(len(a.data), float(untracked))]))

    return _outputs(t, model, (64,), x=0, y=1, none=2)


# -- optimisers: (p - 3) ** 2 from 0, six steps; and schedules ------------------------------------------------------------

#: name -> (optimiser, state columns at the start, and each column's next value from g = 2 (p - 3), the others and the step n)
_OPTIMISERS = {
    "sgd": (lambda p: optim.SGD(p, 0.1), {}, {"p": "p - 0.1 * g"}),
    "momentum": (lambda p: optim.SGD(p, 0.1, 0.9), {"v": "0.0"}, {"v": "0.9 * v + g", "p": "p - 0.1 * (0.9 * v + g)"}),
    "nesterov": (lambda p: optim.SGD(p, 0.1, 0.5, nesterov=True), {"v": "0.0"}, {"v": "0.5 * v + g", "p": "p - 0.1 * (g + 0.5 * (0.5 * v + g))"}),
    "adam": (lambda p: optim.Adam(p, 0.2), {"m": "0.0", "v": "0.0"}, {"m": "0.9 * m + 0.1 * g", "v": "0.999 * v + 0.001 * g * g", "p": "p - 0.2 * (0.9 * m + 0.1 * g) / (1 - 0.9 ** n) / (sqrt((0.999 * v + 0.001 * g * g) / (1 - 0.999 ** n)) + 1e-8)"}),
    "adamw": (lambda p: optim.AdamW(p, 0.2, weight_decay=0.1), {"m": "0.0", "v": "0.0"}, {"m": "0.9 * m + 0.1 * g", "v": "0.999 * v + 0.001 * g * g", "p": "p - 0.02 * p - 0.2 * (0.9 * m + 0.1 * g) / (1 - 0.9 ** n) / (sqrt((0.999 * v + 0.001 * g * g) / (1 - 0.999 ** n)) + 1e-8)"}),
    "nadam": (lambda p: optim.Nadam(p, 0.2), {"m": "0.0", "v": "0.0"}, {"m": "0.9 * m + 0.1 * g", "v": "0.999 * v + 0.001 * g * g", "p": "p - 0.2 * (0.9 * (0.9 * m + 0.1 * g) / (1 - 0.9 ** n) + 0.1 * g / (1 - 0.9 ** n)) / (sqrt((0.999 * v + 0.001 * g * g) / (1 - 0.999 ** n)) + 1e-8)"}),
    "rmsprop": (lambda p: optim.RMSprop(p, 0.1), {"v": "0.0"}, {"v": "0.99 * v + 0.01 * g * g", "p": "p - 0.1 * g / (sqrt(0.99 * v + 0.01 * g * g) + 1e-8)"}),
    "adagrad": (lambda p: optim.Adagrad(p, 0.5), {"v": "0.0"}, {"v": "v + g * g", "p": "p - 0.5 * g / (sqrt(v + g * g) + 1e-10)"}),
    "adadelta": (lambda p: optim.AdaDelta(p), {"v": "0.0", "d": "0.0"}, {"v": "0.9 * v + 0.1 * g * g", "d": "0.9 * d + 0.1 * (sqrt(d + 1e-6) / sqrt(0.9 * v + 0.1 * g * g + 1e-6) * g) ** 2", "p": "p - sqrt(d + 1e-6) / sqrt(0.9 * v + 0.1 * g * g + 1e-6) * g"}),
}


def _optimised(name):
    _, start, then = _OPTIMISERS[name]
    state = ", ".join(start)
    first = "".join(f", {v}::DOUBLE AS {k}" for k, v in start.items())
    moved = "".join(f", ({then[k]})::DOUBLE" for k in start)
    return (
        f"SELECT '{name}' AS name, n, round(p, 6) AS p FROM (WITH RECURSIVE r AS (SELECT 0 AS n, 0.0::DOUBLE AS p{first} UNION ALL"
        f" SELECT n, ({then['p']})::DOUBLE{moved} FROM (SELECT n + 1 AS n, p, 2 * (p - 3) AS g{', ' + state if state else ''} FROM r WHERE n < 6)) SELECT n, p FROM r)"
    )


@query("nn_optimisers", " UNION ALL ".join(map(_optimised, _OPTIMISERS)))
def nn_optimisers(t):
    rows = []
    for name, (make, _, _) in _OPTIMISERS.items():
        p = autograd.parameter([0.0])
        optimiser = make([p])
        rows.append((name, 0, 0.0))
        for n in range(1, 7):
            optimiser.zero_grad()
            ((p - 3) ** 2).sum().backward()
            optimiser.step()
            rows.append((name, n, round(p.data.item(), 6)))
    return t.region.sparkSession.createDataFrame(rows, "name string, n int, p double")


_SCHEDULES = {
    "step": (lambda o: optim.step_lr(o, 3, 0.5), "0.5 ** floor(e / 3)"), "exponential": (lambda o: optim.exponential_lr(o, 0.9), "0.9 ** e"),
    "cosine": (lambda o: optim.cosine_lr(o, 12, 0.1), "0.1 + 0.9 * (1 + cos(pi() * e / 12)) / 2"), "multi_step": (lambda o: optim.multi_step_lr(o, [2, 7], 0.1), "0.1 ** ((e >= 2)::INT + (e >= 7)::INT)"),
    "linear": (lambda o: optim.linear_lr(o, 0.5, 1.0, 4), "0.5 + 0.5 * least(e, 4) / 4"), "warmup": (lambda o: optim.warmup_lr(o, 5), "least(1.0, (e + 1) / 5)"),
    "one_cycle": (lambda o: optim.one_cycle_lr(o, 1.0, 10), "CASE WHEN e < 3 THEN 0.04 + 0.96 * e / 3 ELSE 1e-4 + (1 - 1e-4) * (1 + cos(pi() * least(1.0, (e - 3) / 7))) / 2 END"),
}


@query("nn_schedules", " UNION ALL ".join(f"SELECT '{k}' AS name, e::INT AS epoch, round(({sql})::DOUBLE, 8) AS rate FROM (SELECT range::DOUBLE AS e FROM range(10))" for k, (_, sql) in _SCHEDULES.items()))
def nn_schedules(t):
    rows = []
    for name, (make, _) in _SCHEDULES.items():
        optimiser = optim.SGD([autograd.parameter([0.0])], 1.0)
        schedule = make(optimiser)
        rows += [(name, e, round(float(optimiser.lr if e == 0 else schedule.step()), 8)) for e in range(10)]
    return t.region.sparkSession.createDataFrame(rows, "name string, epoch int, rate double")


@query("nn_plateau", "SELECT i::INT AS i, 0.5 ** greatest(0, floor((i - 2) / 2)) AS rate FROM range(9) r(i)")
def nn_plateau(t):
    """A loss that falls twice and then stays: the rate halves after every two steps without progress."""
    schedule = optim.ReduceLROnPlateau(optim.SGD([autograd.parameter([0.0])], 1.0), 0.5, patience=1)
    rows = [(i, schedule.step(value)) for i, value in enumerate([3.0, 2.0, 1.0, *[1.0] * 6])]
    return t.region.sparkSession.createDataFrame(rows, "i int, rate double")


def _descent(steps, rate):
    """Gradient steps of a line's mean squared error, one subquery each."""
    sql = "(SELECT 0.0::DOUBLE AS w, 0.0::DOUBLE AS b)"
    for _ in range(steps):
        sql = f"(SELECT w - {rate} * 2 * (w * xx + b * x - xy) AS w, b - {rate} * 2 * (w * x + b - y) AS b FROM {sql}, m)"
    return sql


@query(
    "nn_fit_table",
    f"WITH m AS (SELECT avg(x) AS x, avg(y) AS y, avg(x * x) AS xx, avg(x * y) AS xy FROM (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem)) SELECT round(w, 6) AS w, round(b, 6) AS b FROM {_descent(5, 0.3)}",
)
def nn_fit_table(t):
    d = t.lineitem.select((F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y"))
    model = _set(layers.Linear(1, 1), weight=[0.0], bias=[0.0])
    optim.fit_table(d, model, lambda out, y: losses.mse_loss(out.reshape(-1), y), optim.SGD(model.parameters(), 0.3), ["x"], "y", steps=5)
    return d.sparkSession.createDataFrame([(round(model.weight.data.item(), 6), round(model.bias.data.item(), 6))], "w double, b double")
