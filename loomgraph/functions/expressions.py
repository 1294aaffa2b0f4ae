"""Expressions of the query language as Spark columns, with static types.

Operands of types that an operator does not take are an error when the query is
compiled, rather than a silent cast. A comparison with null is false; in a filter's
positive positions the plain comparison has the same effect and stays visible to
Parquet and to joins, so only where a difference could show (below NOT, or as a value)
is it written out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import tree as t
from ..lang.errors import SemanticError, TypeMismatch

#: Types: null, bool, int, float, string, bytes, datetime, list, node, edge, subgraph, hyperedge, any.
_NUMBERS = ("int", "float")
_IDS = ("node", "edge", "subgraph", "hyperedge")
AGGREGATES = frozenset(["count", "sum", "avg", "min", "max", "collect"])


@dataclass(frozen=True)
class Typed:
    col: F.Column
    type: str


def type_of(data: T.DataType) -> str:
    """The language's type of a column's."""
    for kinds, name in (
        ((T.NullType,), "null"), ((T.BooleanType,), "bool"), ((T.LongType, T.IntegerType, T.ShortType, T.ByteType), "int"),
        ((T.DoubleType, T.FloatType, T.DecimalType), "float"), ((T.StringType,), "string"), ((T.BinaryType,), "bytes"),
        ((T.TimestampType, T.TimestampNTZType), "datetime"), ((T.ArrayType,), "list"),
    ):
        if isinstance(data, kinds):
            return name
    return "any"


def literal(value) -> Typed:
    """A Python value as a typed column."""
    if value is None:
        return Typed(F.lit(None), "null")
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise SemanticError(f"integer {value} is out of range")
        return Typed(F.lit(value).cast("long"), "int")
    if isinstance(value, float):
        return Typed(F.lit(value), "float")
    if isinstance(value, str):
        return Typed(F.lit(value), "string")
    if isinstance(value, (bytes, bytearray)):
        return Typed(F.lit(bytes(value)), "bytes")
    if isinstance(value, datetime):
        return Typed(timestamp(millis_of(value)), "datetime")
    if isinstance(value, (list, tuple)):
        return list_of([literal(v) for v in value])
    raise SemanticError(f"no type for {type(value).__name__}")


def list_of(items: list[Typed]) -> Typed:
    kinds = {x.type for x in items} - {"null"}
    if len(kinds) > 1 and not kinds <= set(_NUMBERS):
        raise TypeMismatch(f"a list of mixed types: {', '.join(sorted(kinds))}")
    cast = "double" if kinds == set(_NUMBERS) else "string" if not kinds else None
    return Typed(F.array(*[x.col.cast(cast) if cast else x.col for x in items]) if items else F.array().cast("array<string>"), "list")


def millis_of(value: datetime) -> int:
    aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    return (aware - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


def timestamp(millis: int) -> F.Column:
    return F.timestamp_millis(F.lit(millis).cast("long"))


_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2}):(\d{2})(Z|[+-]\d{2}:\d{2})?)?")


def parse_datetime(text: str) -> int:
    """Milliseconds of YYYY-MM-DD[Thh:mm:ss[Z|±hh:mm]]."""
    m = _ISO.fullmatch(text)
    if not m:
        raise SemanticError(f"not a date and time: {text!r}")
    y, mo, d, h, mi, s, zone = m.groups()
    try:
        base = datetime(int(y), int(mo), 1, int(h or 0), int(mi or 0), int(s or 0), tzinfo=timezone.utc)
    except ValueError as e:
        raise SemanticError(f"not a date and time: {text!r}") from e
    if not 1 <= int(d) <= 31:
        raise SemanticError(f"not a date and time: {text!r}")
    millis = millis_of(base) + (int(d) - 1) * 86_400_000  # days up to 31 in every month
    if zone and zone != "Z":
        sign = 1 if zone[0] == "+" else -1
        millis -= sign * (int(zone[1:3]) * 60 + int(zone[4:6])) * 60_000
    return millis


@dataclass
class Scope:
    """What an expression can see.

    lookup: a variable's value; prop: a property of a variable; params by name; functions:
    registered ones by lower-case name; given: columns that stand for whole expressions
    (aggregates, group keys)."""

    lookup: Callable[[str], Typed]
    prop: Callable[[str, str], Typed]
    params: dict
    now_ms: int
    functions: dict[str, Callable[[list[Typed]], Typed]]
    null_is_false: bool = True
    wrap: bool = True
    given: dict | None = None


def compile_value(e: t.Expr, s: Scope) -> Typed:
    """An expression as a value: three-valued logic, comparisons with null as the scope says."""
    if s.given and e in s.given:
        return s.given[e]
    match e:
        case t.Literal():
            return literal(e.value)
        case t.Param():
            return literal(s.params.get(e.name))
        case t.Var():
            return s.lookup(e.name)
        case t.Prop():
            if isinstance(e.base, t.Var):
                return s.prop(e.base.name, e.key)
            base = compile_value(e.base, s)
            if base.type == "null":
                return Typed(F.lit(None), "null")
            raise TypeMismatch(f"a {base.type} has no properties")
        case t.ListOf():
            return list_of([compile_value(x, s) for x in e.items])
        case t.IsNull():
            x = compile_value(e.operand, s).col
            return Typed(x.isNotNull() if e.negated else x.isNull(), "bool")
        case t.Unary(op="not"):
            return Typed(~_boolean(compile_value(e.operand, s)), "bool")
        case t.Unary():
            x = compile_value(e.operand, s)
            if x.type == "null":
                return x
            if x.type not in _NUMBERS:
                raise TypeMismatch(f"- of a {x.type}")
            return Typed(_wrapped("-", F.lit(0).cast("long"), x.col) if s.wrap and x.type == "int" else -x.col, x.type)
        case t.Binary(op="and" | "or"):
            a, b = _boolean(compile_value(e.left, s)), _boolean(compile_value(e.right, s))
            return Typed(a & b if e.op == "and" else a | b, "bool")
        case t.Binary(op="+" | "-" | "*" | "/" | "%"):
            return _arithmetic(e.op, compile_value(e.left, s), compile_value(e.right, s), s.wrap)
        case t.Binary():
            plain = compare(e.op, compile_value(e.left, s), compile_value(e.right, s))
            return Typed(F.coalesce(plain, F.lit(False)) if s.null_is_false else plain, "bool")
        case t.Call():
            return _call(e, s)
    raise SemanticError("AT TIME belongs to the participants of a hyperedge")


def compile_filter(e: t.Expr, s: Scope) -> F.Column:
    """A condition that keeps rows where it is exactly true."""
    if isinstance(e, t.Binary) and e.op in ("and", "or"):
        a, b = compile_filter(e.left, s), compile_filter(e.right, s)
        return a & b if e.op == "and" else a | b
    if isinstance(e, t.Binary) and e.op in ("=", "<>", "<", "<=", ">", ">="):
        return compare(e.op, compile_value(e.left, s), compile_value(e.right, s))
    return _boolean(compile_value(e, s))


def _boolean(x: Typed) -> F.Column:
    if x.type == "null":
        return F.lit(None).cast("boolean")
    if x.type not in ("bool", "any"):
        raise TypeMismatch(f"a condition is a {x.type}")
    return x.col


def compare(op: str, a: Typed, b: Typed) -> F.Column:
    """A comparison (null with null), or TypeMismatch."""
    if "null" in (a.type, b.type):
        return F.lit(None).cast("boolean")
    both = {a.type, b.type}
    ordered = both <= set(_NUMBERS) or (len(both) == 1 and both <= {"string", "datetime"})
    equal = ordered or (len(both) == 1 and both <= {"bool", *_IDS})
    if "any" not in both and not (equal if op in ("=", "<>") else ordered):
        raise TypeMismatch(f"{a.type} {op} {b.type}")
    x, y = a.col, b.col
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _arithmetic(op: str, a: Typed, b: Typed, wrap: bool) -> Typed:
    if "null" in (a.type, b.type):
        return Typed(F.lit(None), "null")
    if not {a.type, b.type} <= {*_NUMBERS, "any"}:
        raise TypeMismatch(f"{a.type} {op} {b.type}")
    if a.type == b.type == "int":
        if op == "/":
            return Typed(F.call_function("div", a.col, b.col), "int")
        if op == "%":
            return Typed(a.col % b.col, "int")
        plain = {"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op]
        return Typed(_wrapped(op, a.col, b.col) if wrap else plain, "int")
    x, y = a.col.cast("double"), b.col.cast("double")
    return Typed({"+": x + y, "-": x - y, "*": x * y, "/": x / y, "%": x % y}[op], "float")


def _wrapped(op: str, a: F.Column, b: F.Column) -> F.Column:
    """64-bit arithmetic that wraps: the checked result, else one made of 32-bit halves."""
    mask = F.lit(0xFFFFFFFF).cast("long")

    def halves(x):
        return F.shiftrightunsigned(x, 32), x.bitwiseAND(mask)

    def joined(high, low):  # low below 2^34
        return F.shiftleft(high + F.shiftrightunsigned(low, 32), 32).bitwiseOR(low.bitwiseAND(mask))

    (ah, al), (bh, bl) = halves(a), halves(b)
    if op == "+":
        tried, slow = F.try_add(a, b), joined(ah + bh, al + bl)
    elif op == "-":
        nh, nl = halves(F.bitwise_not(b))
        tried, slow = F.try_subtract(a, b), joined(ah + nh, al + nl + 1)
    else:
        b1, b0 = F.shiftrightunsigned(bl, 16), bl.bitwiseAND(F.lit(0xFFFF).cast("long"))
        low = (al * b0).bitwiseAND(mask) + F.shiftleft((al * b1).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
        carry = F.shiftrightunsigned(al * b0, 32) + F.shiftrightunsigned(al * b1, 16) + F.shiftrightunsigned(low, 32)

        def low_product(x, y):  # the low 32 bits of a product of 32-bit numbers
            y1, y0 = F.shiftrightunsigned(y, 16), y.bitwiseAND(F.lit(0xFFFF).cast("long"))
            return (x * y0 + F.shiftleft((x * y1).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)).bitwiseAND(mask)

        high = (carry + low_product(ah, bl) + low_product(al, bh)).bitwiseAND(mask)
        tried, slow = F.try_multiply(a, b), F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))
    return F.coalesce(tried, F.when(a.isNotNull() & b.isNotNull(), slow))


def _call(e: t.Call, s: Scope) -> Typed:
    name = e.name
    if name in AGGREGATES:
        raise SemanticError(f"{name}() stands where nothing is grouped")
    args = [compile_value(a, s) for a in e.args] if name not in ("labels", "type", "id") else []
    if name in ("id", "type", "labels"):
        if len(e.args) != 1 or not isinstance(e.args[0], t.Var):
            raise SemanticError(f"{name}() takes one variable")
        x = s.lookup(e.args[0].name)
        if name == "id" and x.type in _IDS:
            return Typed(x.col, "int")
        if name == "type" and x.type in ("edge", "hyperedge"):
            return s.prop(e.args[0].name, "_type")
        if name == "labels" and x.type == "node":
            return s.prop(e.args[0].name, "_labels")
        raise TypeMismatch(f"{name}() of a {x.type}")
    if name == "datetime":
        if len(args) != 1:
            raise SemanticError("datetime() takes one text")
        if isinstance(e.args[0], (t.Literal, t.Param)):
            text = e.args[0].value if isinstance(e.args[0], t.Literal) else s.params.get(e.args[0].name)
            if not isinstance(text, str):
                raise TypeMismatch("datetime() takes a text")
            return Typed(timestamp(parse_datetime(text)), "datetime")
        if args[0].type != "string":
            raise TypeMismatch(f"datetime() of a {args[0].type}")
        ok = args[0].col.rlike(f"^(?:{_ISO.pattern})$")
        bad = F.raise_error(F.concat(F.lit("not a date and time: "), args[0].col)).cast("timestamp")
        return Typed(F.when(args[0].col.isNull(), F.lit(None)).when(ok, F.to_timestamp(args[0].col)).otherwise(bad), "datetime")
    if name == "now":
        return Typed(timestamp(s.now_ms), "datetime")
    if name in s.functions:
        return s.functions[name](args)
    raise SemanticError(f"unknown function {name}()")


def rendered(e: t.Expr) -> str:
    """The text of an expression, as the name of a result column without an alias."""
    match e:
        case t.Literal():
            return repr(e.value) if isinstance(e.value, str) else "null" if e.value is None else str(e.value).lower() if isinstance(e.value, bool) else str(e.value)
        case t.Param():
            return f"${e.name}"
        case t.Var():
            return e.name
        case t.Prop():
            return f"{rendered(e.base)}.{e.key}"
        case t.ListOf():
            return f"[{', '.join(map(rendered, e.items))}]"
        case t.Call():
            return f"{e.name}({'DISTINCT ' if e.distinct else ''}{'*' if e.star else ', '.join(map(rendered, e.args))})"
        case t.Unary():
            return f"{'NOT ' if e.op == 'not' else '-'}{rendered(e.operand)}"
        case t.IsNull():
            return f"{rendered(e.operand)} IS {'NOT ' if e.negated else ''}NULL"
        case t.Binary():
            return f"{rendered(e.left)} {e.op.upper()} {rendered(e.right)}"
    return "expr"


def has_aggregate(e: t.Expr) -> bool:
    return any(isinstance(x, t.Call) and x.name in AGGREGATES for x in t.walk(e))
