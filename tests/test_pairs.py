"""Features of pairs of points by sorted sweeps against all pairs."""

import math
import time

import numpy as np
import pytest

from starflow.functions import grouped


def all_pairs_share(x, e):
    values = np.unique(x)
    return float(np.mean([(np.abs(x - v) <= e + 1e-5 * np.abs(v)).sum() > 1 for v in values]))


def all_pairs_entropy(x, m=2):
    r = 0.2 * x.std()

    def matches(k):
        t = np.stack([x[i : len(x) - k + 1 + i] for i in range(k)], 1)
        return int((np.abs(t[:, None] - t[None]).max(2) <= r).sum()) - len(t)

    b, a = matches(m), matches(m + 1)
    return -math.log(a / b) if a and b else None


@pytest.mark.parametrize("seed", range(40))
def test_equal_to_all_pairs(seed):
    draw = np.random.default_rng(seed)
    n = int(draw.integers(3, 90))
    x = draw.normal(size=n) * 10.0 ** draw.integers(-3, 5)
    x = np.round(x, int(draw.integers(0, 4))) if seed % 2 else x
    e = draw.choice([0.0, 0.01, 0.5], n) * np.abs(x).max() * draw.choice([1e-4, 0.1])
    assert grouped.recurring_share(x, e, True) == all_pairs_share(x, e)
    assert grouped.sample_entropy(x, e, True) == all_pairs_entropy(x)


def test_ends_on_the_border():
    """Values whose distance is the error itself, of both signs and around zero."""
    x = np.array([-1.0, -0.75, -0.5, 0.0, 0.25, 0.5, 1.5, 1.75])
    for e in (0.25, 0.2499, 0.25000001, 0.0):
        assert grouped.recurring_share(x, np.full(8, e), True) == all_pairs_share(x, np.full(8, e))


def test_long_series():
    draw = np.random.default_rng(3)
    x, began = draw.normal(size=100_000), time.time()
    share, entropy = grouped.recurring_share(x, np.full(100_000, 1e-6), True), grouped.sample_entropy(x, None, True)
    assert 0 < share < 1 and entropy == pytest.approx(-math.log(0.1125), abs=0.05) and time.time() - began < 120
