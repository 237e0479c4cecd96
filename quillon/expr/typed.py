"""A compiled expression: its kind, its Spark column, and what is known of it before any row is read."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors as E

UNKNOWN = object()
WRONG = {"string": E.ExpectedString, "int": E.ExpectedInt, "float": E.ExpectedFloat, "boolean": E.ExpectedBoolean, "tuple": E.ExpectedTuple, "empty": E.ExpectedEmpty}


@dataclass(frozen=True)
class Typed:
    """kind: string, int, float, boolean, tuple, empty or other (a Spark type that the language only passes on).

    const is the value if it is known, parts the elements of a tuple. nullable: whether the column may hold NULL.
    """

    kind: str
    column: Column
    nullable: bool = False
    const: Any = UNKNOWN
    parts: tuple[Typed, ...] = ()

    @property
    def known(self) -> bool:
        return self.const is not UNKNOWN

    @property
    def nan(self) -> bool:
        return self.kind == "float" and (not self.known or self.const != self.const)

    def need(self, *kinds: str) -> Typed:
        if self.kind not in kinds:
            wrong = E.ExpectedNumber if set(kinds) == {"int", "float"} else E.ExpectedNumberOrString if set(kinds) == {"int", "float", "string"} else WRONG.get(kinds[0], E.TypeError_)
            raise wrong(f"expected {' or '.join(kinds)}, got {self.kind}")
        return self

    def long(self) -> Column:
        return self.need("int").column.cast("long")

    def double(self) -> Column:
        return self.need("int", "float").column.cast("double")


class Constant(Typed):
    """A known value. Its column is made when it is asked for: most constants go into others."""

    def __init__(self, kind: str, const: Any):
        for name, value in (("kind", kind), ("nullable", kind == "empty"), ("const", const), ("parts", ())):
            object.__setattr__(self, name, value)

    @property
    def column(self) -> Column:
        return F.lit(self.const).cast("long") if self.kind == "int" else F.lit(self.const)


_KINDS = {type(None): "empty", bool: "boolean", int: "int", float: "float", str: "string"}


def constant(value: Any) -> Typed:
    if type(value) in _KINDS:
        return Constant(_KINDS[type(value)], value)
    if isinstance(value, (tuple, list)):
        return tuple_of(tuple(constant(v) for v in value))
    raise E.TypeError_(f"no value of the language: {value!r}")


def tuple_of(parts: tuple[Typed, ...]) -> Typed:
    """An array if all parts are of one simple kind, else a struct with fields _1, _2, ..."""
    kinds = {p.kind for p in parts}
    if len(kinds) == 1 and not kinds & {"tuple", "empty", "other"}:
        column = F.array(*(p.column for p in parts))
    else:
        column = F.struct(*(p.column.alias(f"_{i + 1}") for i, p in enumerate(parts)))
    const = tuple(p.const for p in parts) if all(p.known for p in parts) else UNKNOWN
    return Typed("tuple", column, False, const, parts)


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return "boolean" if isinstance(kind, T.BooleanType) else "empty" if isinstance(kind, T.NullType) else "other"


def of_field(field: T.StructField, column: Column) -> Typed:
    return Typed(kind_of(field.dataType), column, field.nullable)
