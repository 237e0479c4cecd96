"""Column types of the dialect and Spark's."""

from __future__ import annotations

import struct
from typing import Any

from pyspark.sql import types as T

SPARK = {
    "bool": T.BooleanType(),
    "smallint": T.ShortType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "single": T.FloatType(),
    "double": T.DoubleType(),
    "serial": T.IntegerType(),  # a plain int: values are given, never made
    "varchar": T.StringType(),
    "char": T.StringType(),
}
_BITS = {"smallint": 16, "int": 32, "serial": 32, "bigint": 64}


def fits(value: Any, kind: str) -> Any:
    """The value as its column holds it; ValueError if it is of another type or out of range. NULL fits all."""
    if value is None:
        return None
    if kind in _BITS:
        if isinstance(value, int) and not isinstance(value, bool) and -(1 << _BITS[kind] - 1) <= value < 1 << _BITS[kind] - 1:
            return value
    elif kind in ("single", "double"):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            try:
                struct.pack("f" if kind == "single" else "d", value)
                return float(value)
            except OverflowError:
                pass
    elif kind == "bool":
        if isinstance(value, bool):
            return value
    elif isinstance(value, str):
        return value
    raise ValueError(f"{value!r} is no {kind}")
