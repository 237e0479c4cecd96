"""The built-in functions, each a rule from typed arguments to a typed column of Spark's own expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..expr import errors as E
from ..expr.typed import UNKNOWN, Typed, constant

INF, NAN = float("inf"), float("nan")
#: Fixed value: the smallest positive normal double.
NORMAL = 2.2250738585072014e-308


def ieee(log: Callable[[Column], Column], x: Column) -> Column:
    """A logarithm as IEEE has it: -inf at 0 and NaN below, where Spark says NULL."""
    return F.when(x > 0, log(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


def divide(a: Column, b: Column) -> Column:
    """Division of doubles as IEEE has it; the sign of a zero divisor is ignored."""
    by_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a.isNotNull(), F.lit(NAN))
    return F.when(b == 0, F.when(F.isnan(a), F.lit(NAN)).otherwise(by_zero)).otherwise(a / b)


def remainder(a: Column, b: Column) -> Column:
    return F.when((b == 0) & a.isNotNull(), F.lit(NAN)).otherwise(a % b)


def text(value: Typed) -> Column:
    """How a value is written: strings in quotes, floats without a needless fraction, tuples in braces."""
    c = value.column
    if value.kind == "empty":
        return F.lit("()")
    if value.kind == "tuple":
        return F.concat(F.lit("("), F.concat_ws(", ", *(text(p) for p in value.parts)), F.lit(")"))
    if value.kind == "string":
        return F.concat(F.lit('"'), c, F.lit('"'))
    if value.kind == "float":
        c = c.cast("double")
        shown = c.cast("string")
        digits = F.coalesce(*(c.try_cast(f"decimal(38,{n})").cast("string") for n in (20, 0)))
        plain = F.when(shown.contains("E"), F.coalesce(digits, shown)).otherwise(shown)
        plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
        return F.when(F.isnan(c), F.lit("NaN")).when(c == INF, F.lit("inf")).when(c == -INF, F.lit("-inf")).otherwise(plain)
    return c.cast("string")


def _float(f: Callable[..., Column], n: int) -> Callable[[list[Typed]], Typed]:
    def rule(args: list[Typed]) -> Typed:
        counted(args, n)
        return Typed("float", f(*(a.double() for a in args)), any(a.nullable for a in args))

    return rule


def counted(args: list[Typed], n: int) -> None:
    if len(args) != n:
        raise E.WrongFunctionArgumentAmount(f"expected {n}, got {len(args)}")


def _test(f: Callable[[Column], Column]) -> Callable[[list[Typed]], Typed]:
    def rule(args: list[Typed]) -> Typed:
        counted(args, 1)
        return Typed("boolean", f(args[0].double()), args[0].nullable)

    return rule


def _bits(f: Callable[..., Column], n: int) -> Callable[[list[Typed]], Typed]:
    def rule(args: list[Typed]) -> Typed:
        counted(args, n)
        return Typed("int", f(*(a.long() for a in args)), any(a.nullable for a in args))

    return rule


def _string(f: Callable[[Column], Column]) -> Callable[[list[Typed]], Typed]:
    def rule(args: list[Typed]) -> Typed:
        counted(args, 1)
        return Typed("string", f(args[0].need("string").column), args[0].nullable)

    return rule


def _extreme(least: bool) -> Callable[[list[Typed]], Typed]:
    """Ints stay ints; of a mix the int wins only if it is strictly better, and then as an int if that is known now.

    NaN and NULL are left out; what is left of NaN and NULL alone is NaN.
    """

    def rule(args: list[Typed]) -> Typed:
        if not args:
            raise E.WrongFunctionArgumentAmount("at least one argument")
        for a in args:
            a.need("int", "float")
        pick, better = (min, lambda a, b: a < b) if least else (max, lambda a, b: a > b)
        floats = [a for a in args if a.kind == "float"]
        if all(a.known for a in args):
            i = pick((a.const for a in args if a.kind == "int"), default=None)
            f = pick((a.const for a in floats if a.const == a.const), default=NAN if floats else None)
            return constant(i if f is None or i is not None and (f != f or better(float(i), f)) else f)
        if not floats:
            columns = [a.long() for a in args]
            one = columns[0] if len(columns) == 1 else (F.least if least else F.greatest)(*columns)
            return Typed("int", one, all(a.nullable for a in args))
        columns = [a.double() for a in args]
        real = [F.when(~F.isnan(c), c) if a.nan else c for a, c in zip(args, columns, strict=True)]
        one = real[0] if len(real) == 1 else (F.least if least else F.greatest)(*real)
        return Typed("float", F.coalesce(one, *columns), all(a.nullable for a in args))

    return rule


def _if(args: list[Typed]) -> Typed:
    counted(args, 3)
    test, yes, no = args
    test.need("boolean")
    if test.known:
        return yes if test.const else no
    if yes.kind != no.kind:
        if {yes.kind, no.kind} == {"int", "float"}:
            yes, no = (Typed("float", x.double(), x.nullable) for x in (yes, no))
        elif "empty" not in (yes.kind, no.kind):
            raise E.TypeError_(f"a column cannot be {yes.kind} in some rows and {no.kind} in others")
    kind = no.kind if yes.kind == "empty" else yes.kind
    return Typed(kind, F.when(test.column, yes.column).otherwise(no.column), yes.nullable or no.nullable, UNKNOWN, yes.parts if kind == "tuple" else ())


def _len(args: list[Typed]) -> Typed:
    if len(args) == 1 and args[0].kind == "string":
        return Typed("int", F.octet_length(args[0].column).cast("long"), args[0].nullable)
    if len(args) == 1:
        args[0].need("string", "tuple")
        return constant(len(args[0].parts))
    return constant(len(args))


def _typeof(args: list[Typed]) -> Typed:
    return constant("empty" if not args else args[0].kind if len(args) == 1 else "tuple")


def _from(args: list[Typed]) -> Typed:
    if len(args) == 1:
        return Typed("string", text(args[0]), args[0].nullable and args[0].kind != "empty")
    joined = F.concat(F.lit("("), F.concat_ws(", ", *(text(a) for a in args)), F.lit(")"))
    return Typed("string", joined)


def _pattern(p: Typed) -> None:
    """A known pattern is compiled once by the engine that will run it."""
    if p.known:
        try:
            SparkSession.active()._jvm.java.util.regex.Pattern.compile(p.const)
        except IllegalArgumentException as e:
            raise E.InvalidRegex(f"{p.const}: {e}") from e


def _matches(args: list[Typed]) -> Typed:
    counted(args, 2)
    for a in args:
        a.need("string")
    _pattern(args[1])
    return Typed("boolean", F.regexp_like(args[0].column, args[1].column), any(a.nullable for a in args))


def _replace(args: list[Typed]) -> Typed:
    counted(args, 3)
    for a in args:
        a.need("string")
    _pattern(args[1])
    return Typed("string", F.regexp_replace(*(a.column for a in args)), any(a.nullable for a in args))


def _random(args: list[Typed]) -> Typed:
    counted(args, 0)
    return Typed("float", F.rand())


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < INF)


def _shift(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: f(a, b.cast("int"))


#: The functions' names.
BUILTINS: dict[str, Callable[[list[Typed]], Typed]] = {
    "math::ln": _float(lambda x: ieee(F.log, x), 1),
    "math::log": _float(lambda x, base: divide(ieee(F.log, x), ieee(F.log, base)), 2),
    "math::log2": _float(lambda x: ieee(F.log2, x), 1),
    "math::log10": _float(lambda x: ieee(F.log10, x), 1),
    "math::exp": _float(F.exp, 1),
    "math::exp2": _float(lambda x: F.pow(F.lit(2.0), x), 1),
    "math::pow": _float(F.pow, 2),
    "math::atan2": _float(F.atan2, 2),
    "math::hypot": _float(F.hypot, 2),
    "floor": _float(lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x), 1),
    "ceil": _float(lambda x: F.when(F.abs(x) < 2.0**52, F.ceil(x).cast("double")).otherwise(x), 1),
    "round": _float(lambda x: F.when(F.abs(x) < 2.0**52, F.round(x)).otherwise(x), 1),
    "math::is_nan": _test(F.isnan),
    "math::is_finite": _test(_finite),
    "math::is_infinite": _test(lambda x: F.abs(x) == INF),
    "math::is_normal": _test(lambda x: _finite(x) & (F.abs(x) >= NORMAL)),
    "typeof": _typeof,
    "min": _extreme(True),
    "max": _extreme(False),
    "if": _if,
    "len": _len,
    "str::regex_matches": _matches,
    "str::regex_replace": _replace,
    "str::to_lowercase": _string(F.lower),
    "str::to_uppercase": _string(F.upper),
    "str::trim": _string(lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")),
    "str::from": _from,
    "random": _random,
    "bitand": _bits(lambda a, b: a.bitwiseAND(b), 2),
    "bitor": _bits(lambda a, b: a.bitwiseOR(b), 2),
    "bitxor": _bits(lambda a, b: a.bitwiseXOR(b), 2),
    "bitnot": _bits(F.bitwise_not, 1),
    "shl": _bits(_shift(lambda a, b: F.call_function("shiftleft", a, b)), 2),
    "shr": _bits(_shift(lambda a, b: F.call_function("shiftright", a, b)), 2),
} | {f"math::{f}": _float(getattr(F, f), 1) for f in ("cos", "acos", "cosh", "acosh", "sin", "asin", "sinh", "asinh", "tan", "atan", "tanh", "atanh", "sqrt", "cbrt")}

#: Named constants that a context can offer.
CONSTANTS = {
    "PI": math.pi,
    "TAU": math.tau,
    "FRAC_PI_2": math.pi / 2,
    "FRAC_PI_3": math.pi / 3,
    "FRAC_PI_4": math.pi / 4,
    "FRAC_PI_6": math.pi / 6,
    "FRAC_PI_8": math.pi / 8,
    "FRAC_1_PI": 1 / math.pi,
    "FRAC_2_PI": 2 / math.pi,
    "FRAC_2_SQRT_PI": 2 / math.sqrt(math.pi),
    "SQRT_2": math.sqrt(2),
    "FRAC_1_SQRT_2": math.sqrt(0.5),
    "E": math.e,
    "LOG2_E": math.log2(math.e),
    "LOG2_10": math.log2(10),
    "LOG10_E": math.log10(math.e),
    "LOG10_2": math.log10(2),
    "LN_2": math.log(2),
    "LN_10": math.log(10),
}
