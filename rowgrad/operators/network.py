"""Network descriptions and the matrix arithmetic for one Arrow batch of rows.

A network is a tuple of stages.  Each stage has a weight tensor, stored as a matrix with one row
per input of a unit, and a bias vector.  Gradients are kept factored, as (inputs, deltas) per
stage, until rows are summed: the same factors then serve any grouping of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.draws import uniforms
from ..functions.optim import Adam, Optimizer

XENT = "xent"
MSE = "mse"

# The driver holds and broadcasts one copy of the parameters; larger models are refused.
MODEL_LIMIT_BYTES = 1 << 30
BLOCK_BYTES = 64 << 20


@dataclass(frozen=True)
class Dense:
    """``x W + b``, followed by relu for hidden stages."""

    n_in: int
    n_out: int
    relu: bool = True

    @property
    def shape(self) -> tuple[int, int]:
        return (self.n_in, self.n_out)

    @property
    def row_floats(self) -> int:
        return self.n_in + 2 * self.n_out

    def forward(self, x, w, b):
        z = x @ w + b
        out = np.maximum(z, 0.0) if self.relu else z
        return out, (x[:, None, :], out)

    def deltas(self, kept, grad):
        if self.relu:
            grad = grad * (kept[1] > 0)
        return grad[:, None, :]

    def input_grad(self, kept, delta, w):
        return delta[:, 0, :] @ w.T


@dataclass(frozen=True)
class ConvPool:
    """Same-size convolution with stride 1, relu, then 2x2 max pooling (odd edges padded)."""

    side: int
    c_in: int
    c_out: int
    kernel: int = 5

    @property
    def shape(self) -> tuple[int, int]:
        return (self.kernel * self.kernel * self.c_in, self.c_out)

    @property
    def out_side(self) -> int:
        return (self.side + 1) // 2

    @property
    def n_in(self) -> int:
        return self.side * self.side * self.c_in

    @property
    def row_floats(self) -> int:
        return 2 * self.side * self.side * (self.shape[0] + 2 * self.c_out)

    def forward(self, x, w, b):
        n, s, k, c = len(x), self.side, self.kernel, self.c_out
        before = (k - 1) // 2
        image = np.pad(x.reshape(n, s, s, self.c_in), ((0, 0), (before, k - 1 - before), (before, k - 1 - before), (0, 0)))
        windows = np.lib.stride_tricks.sliding_window_view(image, (k, k), axis=(1, 2))
        patches = windows.transpose(0, 1, 2, 4, 5, 3).reshape(n, s * s, -1)
        z = np.maximum(patches @ w + b, 0.0).reshape(n, s, s, c)
        edge, o = 2 * self.out_side - s, self.out_side
        z = np.pad(z, ((0, 0), (0, edge), (0, edge), (0, 0)), constant_values=-np.inf)
        blocks = z.reshape(n, o, 2, o, 2, c).transpose(0, 1, 3, 5, 2, 4).reshape(n, o, o, c, 4)
        best = blocks.argmax(axis=-1)
        out = np.take_along_axis(blocks, best[..., None], axis=-1)[..., 0]
        return out.reshape(n, -1), (patches, best, out)

    def deltas(self, kept, grad):
        _, best, out = kept
        n, o, s, c = len(out), self.out_side, self.side, self.c_out
        grad = grad.reshape(out.shape) * (out > 0)
        blocks = np.zeros((*out.shape, 4))
        np.put_along_axis(blocks, best[..., None], grad[..., None], axis=-1)
        full = blocks.reshape(n, o, o, c, 2, 2).transpose(0, 1, 4, 2, 5, 3).reshape(n, 2 * o, 2 * o, c)
        return full[:, :s, :s, :].reshape(n, s * s, c)

    def input_grad(self, kept, delta, w):
        n, s, k = len(delta), self.side, self.kernel
        before = (k - 1) // 2
        parts = (delta @ w.T).reshape(n, s, s, k, k, self.c_in)
        image = np.zeros((n, s + k - 1, s + k - 1, self.c_in))
        for dy in range(k):
            for dx in range(k):
                image[:, dy : dy + s, dx : dx + s] += parts[:, :, :, dy, dx]
        return image[:, before : before + s, before : before + s].reshape(n, -1)


@dataclass(frozen=True)
class ModelSpec:
    """Everything a scoring or fitting job needs to know about a network."""

    stages: tuple
    loss: str = XENT
    optimizer: Optimizer = Adam()
    keep_prob: float = 0.5
    weight_std: float = 0.1
    bias: float = 0.1

    def __post_init__(self):
        if self.loss not in (XENT, MSE):
            raise ValueError(f"unknown loss {self.loss!r}")
        if self.size_bytes > MODEL_LIMIT_BYTES:
            raise ValueError(f"{self.n_params} parameters do not fit on the driver")

    @property
    def n_in(self) -> int:
        return self.stages[0].n_in

    @property
    def n_out(self) -> int:
        return self.stages[-1].n_out

    @property
    def block_rows(self) -> int:
        """How many rows a task works on at a time, so that what the stages keep stays small."""
        return max(1, BLOCK_BYTES // (8 * sum(s.row_floats for s in self.stages)))

    @property
    def answer(self) -> str:
        return "label" if self.loss == XENT else "target"

    @property
    def n_params(self) -> int:
        return sum(s.shape[0] * s.shape[1] + s.shape[1] for s in self.stages)

    @property
    def size_bytes(self) -> int:
        return 8 * self.n_params

    def tensors(self) -> list[tuple[int, str, tuple[int, ...]]]:
        """``(layer, name, shape)`` in parameter order."""
        out = []
        for i, stage in enumerate(self.stages):
            out += [(i, "W", stage.shape), (i, "b", stage.shape[1:])]
        return out


def dense_model(widths: list[int] | tuple[int, ...], **options) -> ModelSpec:
    """Relu hidden layers and a linear output layer of the given widths."""
    pairs = list(zip(widths, widths[1:]))
    stages = tuple(Dense(a, b, relu=i < len(pairs) - 1) for i, (a, b) in enumerate(pairs))
    return ModelSpec(stages, **options)


def conv_model(side: int, channels: tuple[int, ...], hidden: int, n_out: int, kernel: int = 5, **options) -> ModelSpec:
    """Convolution and pooling stages, one hidden dense layer, and a linear output layer."""
    stages, c_in = [], 1
    for c_out in channels:
        stages.append(ConvPool(side, c_in, c_out, kernel))
        side, c_in = stages[-1].out_side, c_out
    stages += [Dense(side * side * c_in, hidden), Dense(hidden, n_out, relu=False)]
    return ModelSpec(tuple(stages), **options)


def dropout_mask(row_hash: np.ndarray, units: int, keep_prob: float, salt: int) -> np.ndarray:
    """0 or 1/keep per row and unit, a function of the row's hash and the salt alone."""
    return (uniforms(row_hash[:, None], salt, np.arange(1, units + 1)) < keep_prob) / keep_prob


def forward(model: ModelSpec, params: list[np.ndarray], x: np.ndarray, mask: np.ndarray | None = None):
    """Scores of a block of rows, and what each stage keeps for the way back."""
    kept = []
    last = len(model.stages) - 1
    for i, stage in enumerate(model.stages):
        if i == last and mask is not None:
            x = x * mask
        x, memory = stage.forward(x, params[2 * i], params[2 * i + 1])
        kept.append(memory)
    return x, kept


def score_grad(model: ModelSpec, scores: np.ndarray, answer: np.ndarray) -> np.ndarray:
    """Gradient by the scores: per row for cross-entropy, per row *sum* of squares for MSE."""
    if model.loss == MSE:
        return 2.0 * (scores - answer)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    e[np.arange(len(e)), answer] -= 1.0
    return e


def row_factors(model: ModelSpec, params: list[np.ndarray], x, answer, mask=None):
    """Scores and, per stage, the ``(inputs, deltas)`` whose products summed over rows are the gradient."""
    scores, kept = forward(model, params, x, mask)
    grad = score_grad(model, scores, answer)
    factors = [None] * len(model.stages)
    for i in range(len(model.stages) - 1, -1, -1):
        stage = model.stages[i]
        delta = stage.deltas(kept[i], grad)
        factors[i] = (kept[i][0], delta)
        if i:
            grad = stage.input_grad(kept[i], delta, params[2 * i])
            if i == len(model.stages) - 1 and mask is not None:
                grad = grad * mask
    return scores, factors


def weighted_gradient(factors, rows: np.ndarray | slice, weight: np.ndarray) -> list[np.ndarray]:
    """Weighted sum of row gradients over the chosen rows, in parameter order."""
    out = []
    for inputs, deltas in factors:
        a = inputs[rows]
        d = deltas[rows] * weight[rows][:, None, None]
        d = d.reshape(-1, d.shape[-1])
        out += [a.reshape(len(d), -1).T @ d, d.sum(axis=0)]
    return out
