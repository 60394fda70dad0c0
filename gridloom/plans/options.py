"""Per-variable options: how a method, reducer, NaN rule or fill value is settled for a variable."""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping
from typing import Any

LOG = logging.getLogger("gridloom")

#: Names of interpolation methods and of reducers, and the limit under which sources are scaled down first.
METHODS = ("nearest", "bilinear", "triangular")
REDUCERS = ("center", "count", "first", "last", "max", "mean", "median", "mode", "min", "prod", "std", "sum", "var")
SCALE_LIMIT, UV_DELTA = 0.95, 1e-3
#: Fill values of integers by kind; all other integers have -1.
FILLS = {"uint8": 255, "uint16": 65535}

INTEGERS = ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64")


def is_integer(dtype: str) -> bool:
    return dtype in INTEGERS


def _chosen(option: Any, name: str, dtype: str, what: str, default: Any) -> Any:
    """An option given for all variables, or by name, or by dtype; else the default, with a warning if others were given."""
    if isinstance(option, Mapping):
        for key in (str(name), dtype):
            if key in option:
                return option[key]
        LOG.warning("%s of variable %r (%s) isn't given; taking the default %r", what, name, dtype, default)
        return default
    return default if option is None else option


def method_of(option: Any, name: str, dtype: str, allowed: tuple[str, ...] = METHODS) -> str:
    """The interpolation method of a variable: by default nearest for integers, else bilinear."""
    method = _chosen(option, name, dtype, "interpolation method", "nearest" if is_integer(dtype) else "bilinear")
    if isinstance(method, int) and not isinstance(method, bool):
        if method in (0, 1):
            return METHODS[method]
        if "triangular" in allowed:
            raise KeyError(method)
        raise ValueError("interp_methods must be one of 0, 1, 'nearest', 'bilinear'; higher orders aren't supported")
    if method not in allowed:
        if "triangular" in allowed:
            raise NotImplementedError(f"interp_methods must be one of 0, 1, {', '.join(map(repr, METHODS))}, was {method!r}")
        raise KeyError(method)
    return method


def downscale_methods(option: Any) -> Any:
    """The methods for scaling a source down first, where triangular stands for bilinear."""
    if isinstance(option, Mapping):
        return {k: downscale_methods(v) for k, v in option.items()}
    return "bilinear" if option == "triangular" else option


def reducer_of(option: Any, name: str, dtype: str) -> str:
    """The reducer of a variable: by default center for integers, else mean."""
    reducer = _chosen(option, name, dtype, "aggregation method", "center" if is_integer(dtype) else "mean")
    if reducer not in REDUCERS:
        raise KeyError(reducer)
    return reducer


def recover_of(option: Any, name: str, dtype: str) -> bool:
    return bool(_chosen(option, name, dtype, "NaN recovery", False))


def fill_of(option: Any, name: str, dtype: str) -> float | int:
    """The fill value of a variable: by default NaN, or for integers 255, 65535 or -1 by kind."""
    return _chosen(option, name, dtype, "fill value", FILLS.get(dtype, -1) if is_integer(dtype) else math.nan)
