"""Own features beside the built-in ones: a registered feature becomes a column of ``extract``.

``register_sql("range_", lambda weighted: "max(x) - min(x)")`` adds an aggregate over the shared columns of
``functions.features`` (x, e, time, w, n, med, mu and so on); ``register_series("peak_to_peak", f)`` a function
``f(values, errors, weighted)`` of one series in time order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from starflow.functions import features, grouped


def _checked(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", name) or name.endswith("_deriv"):
        raise ValueError(f"not a feature's name: {name}")
    if name in features.BUILT_IN:
        raise ValueError(f"there is such a feature already: {name}")
    return name


def register_sql(name: str, expression: Callable[[bool], str]) -> None:
    """A feature as an aggregate expression, given whether to weight."""
    grouped.FEATURES.pop(_checked(name), None)
    features.OWN[name] = expression


def register_series(name: str, function: Callable) -> None:
    """A feature as a function of one series."""
    features.OWN.pop(_checked(name), None)
    grouped.FEATURES[name] = function


def unregister(name: str) -> None:
    features.OWN.pop(_checked(name), None)
    grouped.FEATURES.pop(name, None)
