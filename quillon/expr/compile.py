"""Tree of an expression -> Spark column. Nothing here runs a job; only evaluate() does, on one row."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.builtins import BUILTINS, CONSTANTS, divide, remainder
from ..operators.compare import compare, decided, like, like_column
from . import errors as E
from .syntax import Node, parse
from .typed import UNKNOWN, Typed, constant, kind_of, of_field, tuple_of


class Registry:
    """User functions. They are looked up before the built-in ones, so they shadow them."""

    def __init__(self):
        self.functions: dict[str, Callable[[list[Typed]], Typed]] = {}

    def register(self, name: str, function: Callable[..., Any], return_type: T.DataType | str, vectorised: bool = True) -> None:
        """function of one or more arguments: of pandas Series if vectorised (an Arrow-batched UDF), else of values."""
        kind = kind_of(return_type if isinstance(return_type, T.DataType) else T._parse_datatype_string(return_type))
        udf = (F.pandas_udf if vectorised else F.udf)(function, return_type)
        self.functions[name] = lambda args: Typed(kind, udf(*(a.column for a in args)), True)

    def register_column(self, name: str, rule: Callable[..., Column], return_type: T.DataType | str) -> None:
        """rule: columns -> column, made of Spark's own functions; stays in generated code."""
        kind = kind_of(return_type if isinstance(return_type, T.DataType) else T._parse_datatype_string(return_type))
        self.functions[name] = lambda args: Typed(kind, rule(*(a.column for a in args)), True)


@dataclass
class Context:
    """Variables and functions of an expression; mutable ones take assignments."""

    variables: dict[str, Typed] = field(default_factory=dict)
    registry: Registry = field(default_factory=Registry)
    mutable: bool = True

    @classmethod
    def of(cls, df: DataFrame, registry: Registry | None = None) -> Context:
        return cls({f.name: of_field(f, df[f"`{f.name}`"]) for f in df.schema.fields}, registry or Registry())

    @classmethod
    def with_values(cls, values: dict[str, Any], registry: Registry | None = None) -> Context:
        return cls({k: constant(v) for k, v in values.items()}, registry or Registry())

    @classmethod
    def with_constants(cls) -> Context:
        """The named mathematical constants."""
        return cls.with_values(CONSTANTS)

    def set_value(self, name: str, value: Any) -> None:
        self.assign(name, value if isinstance(value, Typed) else constant(value))

    def assign(self, name: str, value: Typed) -> None:
        if not self.mutable:
            raise E.ContextNotMutable(name)
        if name in self.variables:
            value.need(self.variables[name].kind)  # a variable keeps its kind
        self.variables[name] = value


def _quotient(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        if b == 0:
            raise E.DivisionError(f"{a} / 0")
        return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    if b == 0:
        return math.nan if a == 0 or a != a else math.copysign(math.inf, a)
    return a / b


def _remainder(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        if b == 0:
            raise E.ModulationError(f"{a} % 0")
        return a - b * _quotient(a, b)
    return math.nan if b == 0 or math.isinf(a) else math.fmod(a, b)


def _power(a: float, b: float) -> Any:
    try:
        return math.pow(a, b)
    except (OverflowError, ValueError):
        return UNKNOWN  # infinities and NaN as Spark has them


_FOLD: dict[str, Callable[[Any, Any], Any]] = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": _quotient, "%": _remainder, "^": _power,
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "&&": lambda a, b: a and b, "||": lambda a, b: a or b,
}
_OVERFLOW = {"+": E.AdditionError, "-": E.SubtractionError, "*": E.MultiplicationError}


def _folded(op: str, a: Typed, b: Typed) -> Typed | None:
    """The value if it is known already; overflows are found here rather than in the first row."""
    if not (a.known and b.known) or a.const is None or b.const is None or "tuple" in (a.kind, b.kind):
        return None
    x, y = a.const, b.const
    if "float" in (a.kind, b.kind) or op == "^":
        x, y = float(x), float(y)
    value = _FOLD[op](x, y)
    if value is UNKNOWN:
        return None
    if type(value) is int and not -(1 << 63) <= value < 1 << 63:
        raise _OVERFLOW.get(op, E.DivisionError)(f"{a.const} {op} {b.const}")
    return constant(value)


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if op == "+" and a.kind == b.kind == "string":
        return _folded(op, a, b) or Typed("string", F.concat(a.column, b.column), a.nullable or b.nullable)
    if op == "+":
        if not {a.kind, b.kind} <= {"int", "float"}:
            raise E.WrongTypeCombination(f"{a.kind} + {b.kind}")
    else:
        a.need("int", "float")
        b.need("int", "float")
    if known := _folded(op, a, b):
        return known
    nullable = a.nullable or b.nullable
    if op == "^":
        return Typed("float", F.pow(a.double(), b.double()), nullable)
    if a.kind == b.kind == "int":
        x, y = a.long(), b.long()
        column = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.call_function("div", x, y), "%": lambda: x % y}[op]()
        return Typed("int", column, nullable)
    x, y = a.double(), b.double()
    column = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: divide(x, y), "%": lambda: remainder(x, y)}[op]()
    return Typed("float", column, nullable)


def comparison(op: str, a: Typed, b: Typed) -> Typed:
    """Two-valued comparison as a filter column (NULL stands for false); equality of unlike kinds is false."""
    numbers = {"int", "float"}
    if a.kind == b.kind == "tuple":
        if op not in ("==", "!="):
            raise E.ExpectedNumberOrString("tuples have no order")
        if len(a.parts) != len(b.parts):
            return constant(op == "!=")
        same = constant(True)
        for x, y in zip(a.parts, b.parts, strict=True):
            same = _logic("&&", same, decided_(comparison("==", x, y)))
        return same if op == "==" else _not(same)
    if a.kind == b.kind == "empty":
        return constant(op in ("==", "<=", ">="))
    alike = a.kind == b.kind or {a.kind, b.kind} <= numbers or "empty" in (a.kind, b.kind)
    if not alike:
        if op in ("==", "!="):
            return constant(op == "!=")
        raise E.ExpectedNumberOrString(f"{a.kind} {op} {b.kind}")
    if op not in ("==", "!=") and not {a.kind, b.kind} <= numbers | {"string", "empty", "other"}:
        raise E.ExpectedNumberOrString(f"{a.kind} {op} {b.kind}")
    if known := _folded(op, a, b):
        return known
    column = compare(op, a.column, b.column, a.nullable, b.nullable, a.nan, b.nan)
    return Typed("boolean", column, a.nullable or b.nullable)


def decided_(t: Typed) -> Typed:
    return Typed(t.kind, decided(t.column), False, t.const) if t.nullable else t


def _logic(op: str, a: Typed, b: Typed) -> Typed:
    a.need("boolean")
    b.need("boolean")
    if known := _folded(op, a, b):
        return known
    column = a.column & b.column if op == "&&" else a.column | b.column
    return Typed("boolean", column, a.nullable or b.nullable)


def _not(a: Typed) -> Typed:
    a = decided_(a.need("boolean"))
    return constant(not a.const) if a.known else Typed("boolean", ~a.column)


def wildcard(a: Typed, b: Typed) -> Typed:
    """a LIKE b; a NULL side is no match."""
    for x in (a, b):
        if x.kind != "empty":
            x.need("string")
    if "empty" in (a.kind, b.kind):
        return constant(False)
    return Typed("boolean", like(a.column, b.const) if b.known else like_column(a.column, b.column), a.nullable or b.nullable)


def binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("&&", "||"):
        return _logic(op, a, b)
    if op == "LIKE":
        return wildcard(a, b)
    return comparison(op, a, b) if op in ("==", "!=", "<", "<=", ">", ">=") else _arithmetic(op, a, b)


def compile_node(node: Node, context: Context) -> Typed:
    """Children before their parents, from left to right, on a stack of its own."""
    waiting: list[tuple[Node, bool]] = [(node, False)]
    made: list[Typed] = []
    while waiting:
        n, entered = waiting.pop()
        if entered or not n.children:
            cut = len(made) - len(n.children)
            made[cut:] = [_combined(n, made[cut:], context)]
        else:
            waiting.append((n, True))
            waiting += ((c, False) for c in reversed(n.children))
    return made[0]


def _combined(node: Node, values: list[Typed], context: Context) -> Typed:
    """A node's value from those of its children."""
    if node.kind == "const":
        return constant(node.value)
    if node.kind == "empty":
        return constant(None)
    if node.kind == "name":
        if node.value not in context.variables:
            raise E.VariableIdentifierNotFound(node.value)
        return context.variables[node.value]
    if node.kind == "tuple":
        return tuple_of(tuple(map(_shown, values)))
    if node.kind == "chain":
        return values[-1]
    if node.kind == "assign":
        name, op = node.value
        value = values[0]
        if op:
            if name not in context.variables:
                raise E.VariableIdentifierNotFound(name)
            value = binary(op, context.variables[name], value)
        context.assign(name, _shown(value))
        return constant(None)
    if node.kind == "call":
        argument = values[0]
        args = [] if argument.kind == "empty" and node.children[0].kind == "empty" else list(argument.parts) if argument.kind == "tuple" else [argument]
        rule = context.registry.functions.get(node.value) or BUILTINS.get(node.value)
        if rule is None:
            raise E.FunctionIdentifierNotFound(node.value)
        return rule([_shown(a) for a in args])
    if node.value == "!":
        return _not(values[0])
    if node.value == "neg":
        first = values[0].need("int", "float")
        if first.known:
            if first.const == -(1 << 63) and first.kind == "int":
                raise E.NegationError(str(first.const))
            return constant(-first.const)
        return Typed(first.kind, -(first.long() if first.kind == "int" else first.double()), first.nullable)
    return binary(node.value, *values)


def _shown(t: Typed) -> Typed:
    """A value that is kept or shown: conditions are true or false, never NULL."""
    return decided_(t) if t.kind == "boolean" else t


def compile_text(text: str | Node, context: Context | DataFrame | None = None) -> Typed:
    """An expression over a frame's columns (or a context's variables) as a typed column; columns that hold NULL stay so."""
    context = Context.of(context) if isinstance(context, DataFrame) else context or Context()
    node = parse(text) if isinstance(text, str) else text
    out = compile_node(node, context)
    return out if node.kind == "name" else _shown(out)


def apply(df: DataFrame, text: str, registry: Registry | None = None) -> DataFrame:
    """df with the columns that the text assigns, in the order of their first assignment."""
    context = Context.of(df, registry)
    node = parse(text)
    compile_node(node, context)
    return df.withColumns({name: context.variables[name].column for name in dict.fromkeys(node.write_variables())})


def _python(value: Any, t: Typed) -> Any:
    if t.kind == "tuple":
        items = list(value) if value is not None else [None] * len(t.parts)
        return tuple(_python(v, p) for v, p in zip(items, t.parts, strict=True))
    return value


def evaluate(spark: SparkSession, text: str | Node, context: Context | None = None) -> Any:
    """The value of an expression without rows: str, float, int, bool, tuple, or None for the empty value."""
    return _value(spark, compile_text(text, context or Context()))


def _value(spark: SparkSession, t: Typed) -> Any:
    """Known values need no job."""
    return t.const if t.known else _python(spark.range(1).select(t.column.alias("v")).first()["v"], t)


def evaluate_as(spark: SparkSession, kind: str, text: str | Node, context: Context | None = None) -> Any:
    """evaluate(), but raise unless the value is of this kind; `number` takes ints and floats and gives a float.

    text may be a tree that was parsed before. A context that takes assignments keeps them.
    """
    t = compile_text(text, context or Context())
    if kind == "number":
        return float(_value(spark, t.need("int", "float")))
    return _value(spark, t.need(kind))


def _of_kind(kind: str, spark: SparkSession, text: str | Node, context: Context | None = None) -> Any:
    """evaluate_as() with the kind first."""
    return evaluate_as(spark, kind, text, context)


evaluate_string, evaluate_int, evaluate_float, evaluate_number, evaluate_boolean, evaluate_tuple, evaluate_empty = (functools.partial(_of_kind, k) for k in ("string", "int", "float", "number", "boolean", "tuple", "empty"))
