"""Update rules, written once for Columns and for numpy arrays.

Every rule keeps running averages ("slots") of the form ``s' = decay * s + gain * u(g)`` and moves
the parameter by an amount that depends on the new slots, the gradient and the step number.  The
rules only use ``+ - * /`` and the square root handed in.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Adam:
    # The usual defaults of the method; the rate is the data sets' own.
    lr: float = 1e-4
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8

    slots = ("m", "v")
    slot_start = (0.0, 0.0)

    @property
    def decays(self):
        return (self.beta1, self.beta2)

    def advance(self, slots, g):
        m, v = slots
        return (m * self.beta1 + g * (1 - self.beta1), v * self.beta2 + g * g * (1 - self.beta2))

    def change(self, slots, g, step, sqrt):
        m, v = slots
        # b ** step works for numbers and Columns alike
        rate = sqrt(1 - self._power(self.beta2, step)) * self.lr / (1 - self._power(self.beta1, step))
        return m * rate / (sqrt(v) + self.eps) * -1.0

    @staticmethod
    def _power(base, step):
        return base**step


@dataclass(frozen=True)
class Momentum:
    # Fixed values of the single-target data set.
    lr: float = 1e-7
    momentum: float = 0.9995

    slots = ("accum",)
    slot_start = (0.0,)

    @property
    def decays(self):
        return (self.momentum,)

    def advance(self, slots, g):
        return (slots[0] * self.momentum + g,)

    def change(self, slots, g, step, sqrt):
        return slots[0] * -self.lr


@dataclass(frozen=True)
class RMSProp:
    # Fixed values of the multi-target data set; the mean square starts at one.
    lr: float = 1e-4
    decay: float = 0.9
    eps: float = 1e-10
    start: float = 1.0

    slots = ("ms",)

    @property
    def slot_start(self):
        return (self.start,)

    @property
    def decays(self):
        return (self.decay,)

    def advance(self, slots, g):
        return (slots[0] * self.decay + g * g * (1 - self.decay),)

    def change(self, slots, g, step, sqrt):
        return g * -self.lr / sqrt(slots[0] + self.eps)


Optimizer = Adam | Momentum | RMSProp
