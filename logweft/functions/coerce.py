"""Lenient typing, decided once a plan: every value is a column with its static type."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DAY_TIME = T.DayTimeIntervalType()


@dataclass(frozen=True)
class Typed:
    col: Column
    type: T.DataType
    literal: Any = None
    constant: bool = False


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType)


def is_span(t: T.DataType) -> bool:
    return isinstance(t, T.DayTimeIntervalType)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def span_us(c: Column) -> Column:
    """A duration in microseconds."""
    return F.unix_micros(F.timestamp_micros(F.lit(0)) + c)


def num(x: Typed) -> Column:
    """A number or null: text is trimmed and read, booleans are 1 and 0, durations seconds."""
    if is_number(x.type):
        return x.col.cast("double") if isinstance(x.type, T.DecimalType) else x.col
    if is_text(x.type):
        s = F.trim(x.col)
        return F.when(s.rlike(NUMBER), s.try_cast("double"))
    if isinstance(x.type, T.BooleanType):
        return x.col.cast("int").cast("double")
    if is_span(x.type):
        return span_us(x.col) / F.lit(1e6)
    return F.lit(None).cast("double")


def num_type(x: Typed) -> T.DataType:
    return x.type if is_number(x.type) and not isinstance(x.type, T.DecimalType) else T.DoubleType()


def _real(c: Column) -> Column:
    """Whole numbers without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def txt(x: Typed) -> Column:
    """Text, null for null."""
    if is_text(x.type):
        return x.col
    if isinstance(x.type, T.DoubleType | T.FloatType):
        return _real(x.col.cast("double"))
    if is_time(x.type):
        return F.date_format(x.col, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if is_span(x.type):
        us = span_us(x.col)
        a = F.abs(us)
        days = F.floor(a / 86_400_000_000)
        clock = F.date_format(F.timestamp_micros((a % 86_400_000_000).cast("bigint")), "HH:mm:ss")
        ms = F.floor((a % 1_000_000) / 1000)
        return F.concat(F.when(us < 0, "-").otherwise(""), F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(""), clock, F.when(ms > 0, F.concat(F.lit("."), F.lpad(ms.cast("string"), 3, "0"))).otherwise(""))
    if isinstance(x.type, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(x.col)
    if isinstance(x.type, T.NullType):
        return F.lit(None).cast("string")
    return x.col.cast("string")


def text(x: Typed) -> Column:
    """Text, empty for null."""
    return F.coalesce(txt(x), F.lit(""))


# The layouts of a time in text, after a guard on its shape.
LAYOUTS = (
    (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?$", None),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", "MM/dd/yyyy HH:mm:ss"),
    (r"^\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", "dd MMM yyyy HH:mm:ss Z"),
    (r"^\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [A-Z]{3}$", "dd MMM yyyy HH:mm:ss z"),
    (r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$", "dd/MMM/yyyy:HH:mm:ss Z"),
)


def ts(x: Typed) -> Column:
    """A time or null."""
    if isinstance(x.type, T.TimestampNTZType):
        return x.col
    if is_time(x.type):
        return x.col.cast("timestamp")
    if is_text(x.type):
        s = F.regexp_replace(F.trim(x.col), "^[A-Za-z]{3}, ", "")
        out = F.lit(None).cast("timestamp")
        for guard, layout in reversed(LAYOUTS):
            out = F.when(s.rlike(guard), F.try_to_timestamp(s, F.lit(layout)) if layout else s.try_cast("timestamp")).otherwise(out)
        return out
    return F.lit(None).cast("timestamp")


def time_type(x: Typed) -> T.DataType:
    return x.type if isinstance(x.type, T.TimestampNTZType) else T.TimestampType()


def span_of(us: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / F.lit(1_000_000)).cast("decimal(18,6)"))


def span(x: Typed) -> Column:
    """A duration or null; numbers are seconds."""
    if is_span(x.type):
        return x.col
    if is_number(x.type):
        return span_of(x.col * F.lit(1_000_000))
    if is_text(x.type):
        s = F.trim(x.col)
        unit = F.create_map(*[F.lit(v) for p in {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}.items() for v in p])
        value = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)(ms|[dhms])$", 1).try_cast("double")
        return span_of(value * unit[F.regexp_extract(s, r"^(\d+(?:\.\d+)?)(ms|[dhms])$", 2)] * 1e6)
    return F.lit(None).cast(DAY_TIME)


def truthy(x: Typed) -> Column:
    """Null, false, 0 and the empty text are false, all else is true. Never null."""
    if isinstance(x.type, T.BooleanType):
        return F.coalesce(x.col, F.lit(False))
    if is_number(x.type):
        return F.coalesce(x.col != 0, F.lit(False))
    if is_text(x.type):
        return F.coalesce(x.col != "", F.lit(False))
    return x.col.isNotNull()


_OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _sides(a: Typed, b: Typed) -> tuple[Column, Column, bool]:
    """Both as values of one kind, and whether that is text."""
    if is_time(a.type) or is_time(b.type):
        x, y = ts(a), ts(b)
        if isinstance(a.type, T.TimestampNTZType) != isinstance(b.type, T.TimestampNTZType):
            x, y = x.cast("timestamp_ntz"), y.cast("timestamp_ntz")
        return x, y, False
    if is_span(a.type) and is_span(b.type):
        return a.col, b.col, False
    if is_text(a.type) and is_text(b.type):
        return a.col, b.col, True
    if isinstance(a.type, T.BooleanType) and isinstance(b.type, T.BooleanType):
        return a.col, b.col, False
    if isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType):
        return (a.col, b.col, is_text(a.type) or is_text(b.type))
    if any(isinstance(t.type, T.ArrayType | T.MapType | T.StructType) for t in (a, b)):
        return txt(a), txt(b), True
    if (is_text(a.type) and a.constant and num_literal(a) is None) or (is_text(b.type) and b.constant and num_literal(b) is None):
        return txt(a), txt(b), True
    return num(a), num(b), False


def num_literal(x: Typed) -> float | None:
    try:
        return float(x.literal)
    except (TypeError, ValueError):
        return None


def compare(op: str, a: Typed, b: Typed, bare: bool = False) -> Column:
    """Two-valued comparison: null is the lowest value, and equal to the empty text.

    Two texts that are both numbers compare as numbers. bare: nulls may stay where they mean false, so that the
    comparison reaches the scan."""
    # Text against a number-like literal compares numbers where the text is one.
    if is_text(a.type) and is_text(b.type) and not (a.constant and num_literal(a) is None) and not (b.constant and num_literal(b) is None):
        x, y, as_text = a.col, b.col, True
        both = num(a).isNotNull() & num(b).isNotNull()
        value = F.when(both, _OPS[op](num(a), num(b))).otherwise(_OPS[op](F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))
        return value
    x, y, as_text = _sides(a, b)
    if isinstance(a.type, T.NullType) and isinstance(b.type, T.NullType):
        return F.lit(op in ("==", "<=", ">="))
    test = _OPS[op](x, y)
    if (a.constant and a.literal is None and not isinstance(a.type, T.DayTimeIntervalType)) or (b.constant and b.literal is None and not is_span(b.type)):
        other, flipped = (b, True) if a.constant and a.literal is None else (a, False)
        empty = other.col.isNull() | (other.col == "") if is_text(other.type) else other.col.isNull()
        table = {"==": empty, "!=": ~empty, "<": F.lit(False), ">=": F.lit(True), ">": ~empty, "<=": empty}
        if flipped:
            table = {"==": empty, "!=": ~empty, "<": ~empty, "<=": F.lit(True), ">": F.lit(False), ">=": empty}
        return table[op]
    if as_text and not (b.constant and b.literal != "") and not (a.constant and a.literal != ""):
        return _OPS[op](F.coalesce(x, F.lit("")), F.coalesce(y, F.lit("")))
    if b.constant:
        missing = op in ("!=", "<", "<=")
        if bare:
            return (test | x.isNull()) if missing else test
        return F.coalesce(test, F.lit(missing))
    if a.constant:
        missing = op in ("!=", ">", ">=")
        if bare:
            return (test | y.isNull()) if missing else test
        return F.coalesce(test, F.lit(missing))
    both = op in ("==", "<=", ">=")
    return F.when(x.isNull() & y.isNull(), both).when(x.isNull(), op in ("!=", "<", "<=")).when(y.isNull(), op in ("!=", ">", ">=")).otherwise(test)


def arith(op: str, a: Typed, b: Typed) -> Typed:
    """Arithmetic that gives null where it has no meaning, and never fails."""
    ta, tb = is_time(a.type), is_time(b.type)
    if ta and tb and op == "-":
        us = F.unix_micros(ts(a).cast("timestamp")) - F.unix_micros(ts(b).cast("timestamp"))
        return Typed(span_of(us), DAY_TIME)
    if (ta or (tb and op == "+")) and op in "+-":
        t, d = (a, b) if ta else (b, a)
        return Typed(ts(t) + span(d) if op == "+" else ts(t) - span(d), time_type(t))
    if is_span(a.type) or is_span(b.type):
        if is_span(a.type) and is_span(b.type):
            if op in "+-":
                return Typed(a.col + b.col if op == "+" else a.col - b.col, DAY_TIME)
            if op == "/":
                return Typed(F.try_divide(span_us(a.col).cast("double"), span_us(b.col).cast("double")), T.DoubleType())
        elif op == "*":
            s, n = (a, b) if is_span(a.type) else (b, a)
            return Typed(span_of(span_us(s.col) * num(n)), DAY_TIME)
        elif op == "/" and is_span(a.type):
            return Typed(span_of(F.try_divide(span_us(a.col).cast("double"), num(b))), DAY_TIME)
        elif op in "+-":
            return Typed(span(a) + span(b) if op == "+" else span(a) - span(b), DAY_TIME)
        return Typed(F.lit(None).cast("double"), T.DoubleType())
    x, y = num(a), num(b)
    whole = all(isinstance(num_type(t), T.IntegralType) for t in (a, b))
    if op == "/":
        return Typed(F.try_divide(x.cast("double"), y.cast("double")), T.DoubleType())
    kind = T.LongType() if whole else T.DoubleType()
    x, y = x.cast(kind), y.cast(kind)
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[op]
    return Typed(f(x, y), kind)
