"""Random numbers out of a key and a counter, the same on every cluster, whatever the layout of the data.

There is no state: a draw is a hash of its key and its counter, so a repeated task draws the same, and SQL can do so too.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
# Odd multipliers of the hash.
KEY_STEP, COUNTER_STEP = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)
ROUNDS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
LAST_SHIFT = 31


def uniforms(keys: np.ndarray, salt: int, counters: np.ndarray) -> np.ndarray:
    """Draws from [0, 1), one for each pair of ``keys`` and ``counters``, which broadcast against each other."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + U(salt) * KEY_STEP
        h = h ^ counters.astype(np.uint64) * COUNTER_STEP
        for shift, factor in ROUNDS:
            h = (h ^ (h >> U(shift))) * U(factor)
        h = h ^ (h >> U(LAST_SHIFT))
    return (h >> U(11)) / float(1 << 53)


# Rational approximation of the inverse normal distribution (Wichura, algorithm AS 241), lowest power first.
CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
)
CENTRE_HALF, CENTRE_SQUARE, TAIL_FROM = 0.425, 0.180625, 1.6
# The normal distribution at two deviations below its mean.
BELOW_TWO = 0.022750131948179195


def _ratio(coefficients, x: np.ndarray) -> np.ndarray:
    over, under = (np.polynomial.polynomial.polyval(x, c) for c in coefficients)
    return over / under


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The inverse normal distribution, for probabilities between 1e-11 and 1 - 1e-11."""
    q = p - 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        centre = q * _ratio(CENTRE, CENTRE_SQUARE - q * q)
        far = np.sqrt(-np.log(np.minimum(p, 1 - p))) - TAIL_FROM
        tail = np.sign(q) * _ratio(TAIL, far)
    return np.where(np.abs(q) <= CENTRE_HALF, centre, tail)


def cut_normals(uniform: np.ndarray) -> np.ndarray:
    """Normal draws that stay within two deviations, as if those beyond were drawn again."""
    return normal_quantile(BELOW_TWO + uniform * (1 - 2 * BELOW_TWO))
