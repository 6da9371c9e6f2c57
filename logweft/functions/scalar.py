"""Scalar functions: name -> typed arguments -> typed column. register() adds more."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import QueryError
from .coerce import DAY_TIME, Typed, is_number, is_span, is_text, is_time, num, num_type, span, span_us, text, time_type, truthy, ts, txt

STR, DBL, LNG, BOOL = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()
FUNCTIONS: dict[str, Callable[..., Typed]] = {}


def register(*names: str) -> Callable:
    """Make a function of typed columns known to queries."""

    def add(f: Callable[..., Typed]) -> Callable[..., Typed]:
        FUNCTIONS.update(dict.fromkeys(names, f))
        return f

    return add


def call(name: str, args: list[Typed]) -> Typed:
    f = FUNCTIONS.get(name)
    if f is None:
        raise QueryError(f"unknown function {name!r}")
    try:
        return f(*args)
    except TypeError as e:
        raise QueryError(f"{name}: wrong number of arguments") from e


def regex(pattern: str) -> str:
    """A pattern with named groups as Java spells plain ones; checked."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"bad pattern {pattern!r}: {e}") from e
    return re.sub(r"\(\?P<\w+>", "(", pattern)


def unify(items: list[Typed]) -> list[Typed]:
    """Values of one common type."""
    kinds = {type(i.type) for i in items if not isinstance(i.type, T.NullType)}
    if len(kinds) <= 1:
        kind = next((i.type for i in items if not isinstance(i.type, T.NullType)), STR)
        return [Typed(i.col.cast(kind), kind) for i in items]
    if all(is_number(i.type) or isinstance(i.type, T.NullType) for i in items):
        kind = DBL if any(isinstance(i.type, T.FractionalType) for i in items) else LNG
        return [Typed(i.col.cast(kind), kind) for i in items]
    if all(is_time(i.type) or isinstance(i.type, T.NullType) for i in items):
        return [Typed(i.col.cast("timestamp"), T.TimestampType()) for i in items]
    return [Typed(txt(i), STR) for i in items]


def _lit(x: Typed, what: str):
    if not x.constant:
        raise QueryError(f"{what} must be a literal")
    return x.literal


@register("strlen", "string_size")
def _strlen(s):
    return Typed(F.length(text(s)).cast("long"), LNG)


@register("strcat")
def _strcat(*xs):
    return Typed(F.concat(*[text(x) for x in xs]), STR)


@register("strcat_delim")
def _strcat_delim(d, *xs):
    parts: list[Column] = []
    for k, x in enumerate(xs):
        parts += ([text(d)] if k else []) + [text(x)]
    return Typed(F.concat(*parts) if parts else F.lit(""), STR)


@register("substring", "substr")
def _substring(s, start, length=None):
    t, n, at = text(s), F.length(text(s)), num(start).cast("int")
    a = F.least(F.when(at < 0, F.greatest(n + at, F.lit(0))).otherwise(at), n)
    size = F.greatest(num(length).cast("int"), F.lit(0)) if length is not None else n
    return Typed(F.substr(t, a + 1, size), STR)


@register("split")
def _split(s, d, i=None):
    sep = re.sub(r"([^\w\s])", r"\\\1", str(_lit(d, "the delimiter")))
    parts = F.split(text(s), sep) if sep else F.regexp_extract_all(text(s), F.lit("(?s)(.)"), F.lit(1))
    return Typed(parts, T.ArrayType(STR)) if i is None else Typed(F.get(parts, num(i).cast("int")), STR)


@register("replace", "replace_string")
def _replace(s, a, b):
    return Typed(F.replace(text(s), text(a), text(b)), STR)


@register("tolower", "lower")
def _lower(s):
    return Typed(F.lower(text(s)), STR)


@register("toupper", "upper")
def _upper(s):
    return Typed(F.upper(text(s)), STR)


def _trimmer(names: tuple[str, ...], how: str) -> None:
    def f(a, b=None):
        if b is None:
            edge = {"BOTH": r"^\s+|\s+$", "LEADING": r"^\s+", "TRAILING": r"\s+$"}[how]
            return Typed(F.regexp_replace(text(a), edge, ""), STR)
        g = {"BOTH": F.btrim, "LEADING": F.ltrim, "TRAILING": F.rtrim}[how]
        return Typed(g(text(b), text(a)), STR)

    register(*names)(f)


_trimmer(("trim",), "BOTH")
_trimmer(("trim_start",), "LEADING")
_trimmer(("trim_end",), "TRAILING")


@register("indexof")
def _indexof(s, t):
    return Typed((F.locate(_lit(t, "the text to find"), text(s)) - 1).cast("long") if t.constant else (F.expr("0").cast("long") + F.instr(text(s), text(t)) - 1).cast("long"), LNG)


@register("reverse")
def _reverse(s):
    return Typed(F.reverse(text(s)), STR)


@register("extract")
def _extract(pattern, group, s=None):
    if s is None:
        s, group = group, Typed(F.lit(1), LNG, 1, True)
    p, g = regex(_lit(pattern, "the pattern")), int(_lit(group, "the group"))
    if g > re.compile(_lit(pattern, "the pattern")).groups:
        return Typed(F.lit(None).cast("string"), STR)
    return Typed(F.when(text(s).rlike(p), F.regexp_extract(text(s), p, g)), STR)


@register("url_encode")
def _url_encode(s):
    return Typed(F.url_encode(text(s)), STR)


@register("url_decode")
def _url_decode(s):
    return Typed(F.try_url_decode(text(s)), STR)


@register("toint", "tolong")
def _tolong(x):
    return Typed(F.when(F.abs(num(x)) < 9.3e18, num(x)).try_cast("long"), LNG)


@register("todouble", "toreal")
def _todouble(x):
    return Typed(num(x).cast("double"), DBL)


@register("tostring")
def _tostring(x):
    return Typed(text(x), STR)


@register("tobool", "toboolean")
def _tobool(x):
    return Typed(truthy(x), BOOL)


@register("todatetime", "datetime")
def _todatetime(x):
    return Typed(ts(x), time_type(x))


@register("totimespan")
def _totimespan(x):
    return Typed(span(x), DAY_TIME)


def type_name(t: T.DataType) -> str:
    if is_number(t):
        return "real"
    if is_text(t):
        return "string"
    if isinstance(t, BOOL.__class__):
        return "bool"
    if is_time(t):
        return "datetime"
    if is_span(t):
        return "timespan"
    if isinstance(t, T.ArrayType):
        return "array"
    return "null" if isinstance(t, T.NullType) else "dictionary"


@register("gettype")
def _gettype(x):
    return Typed(F.when(x.col.isNull(), "null").otherwise(type_name(x.type)), STR)


@register("iff", "iif")
def _iff(p, a, b):
    x, y = unify([a, b])
    return Typed(F.when(truthy(p), x.col).otherwise(y.col), x.type)


@register("case")
def _case(*xs):
    tests, values = xs[0 : len(xs) - 1 : 2], list(xs[1::2]) + ([xs[-1]] if len(xs) % 2 else [])
    values = unify(values)
    out = F
    for p, v in zip(tests, values, strict=False):
        out = out.when(truthy(p), v.col)
    return Typed(out.otherwise(values[-1].col) if len(xs) % 2 else out, values[0].type)


@register("coalesce")
def _coalesce(*xs):
    xs = unify(list(xs))
    return Typed(F.coalesce(*[x.col for x in xs]), xs[0].type)


@register("isnull")
def _isnull(x):
    return Typed(x.col.isNull(), BOOL)


@register("isnotnull", "notnull")
def _isnotnull(x):
    return Typed(x.col.isNotNull(), BOOL)


@register("isempty")
def _isempty(x):
    return Typed(text(x) == "", BOOL)


@register("isnotempty", "notempty")
def _isnotempty(x):
    return Typed(text(x) != "", BOOL)


@register("isnan")
def _isnan(x):
    return Typed(F.coalesce(F.isnan(num(x)), F.lit(False)), BOOL)


@register("isfinite")
def _isfinite(x):
    v = num(x).cast("double")
    return Typed(F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)), BOOL)


@register("abs")
def _abs(x):
    return Typed(F.abs(num(x)), num_type(x))


def _math(name: str, f: Callable[[Column], Column]) -> None:
    register(name)(lambda x: Typed(f(num(x).cast("double")).cast("double"), DBL))


_math("sqrt", F.sqrt)
_math("exp", F.exp)
_math("sign", F.signum)
_math("ceiling", F.ceil)
_math("ceil", F.ceil)
_math("log2", lambda v: F.when(v == 0, float("-inf")).when(v < 0, float("nan")).otherwise(F.log2(v)))
_math("log10", lambda v: F.when(v == 0, float("-inf")).when(v < 0, float("nan")).otherwise(F.log10(v)))
_math("log", lambda v: F.when(v == 0, float("-inf")).when(v < 0, float("nan")).otherwise(F.ln(v)))
_math("ln", lambda v: F.when(v == 0, float("-inf")).when(v < 0, float("nan")).otherwise(F.ln(v)))


@register("pow", "power")
def _pow(a, b):
    return Typed(F.pow(num(a).cast("double"), num(b).cast("double")), DBL)


@register("round")
def _round(x, d=None):
    p = 10.0 ** int(_lit(d, "the digits") if d is not None else 0)
    v = num(x).cast("double") * p
    return Typed(F.signum(v) * F.floor(F.abs(v) + 0.5).cast("double") / p, DBL)


@register("floor")
def _floor(x, r=None):
    return _bin(x, r) if r is not None else Typed(F.floor(num(x)).cast("double"), DBL)


@register("bin", "floor_bin")
def _bin(v, r):
    """Times are cut from the Monday 0001-01-01 on."""
    if is_time(v.type):
        us = span_us(span(r)) if not r.constant or r.literal is None else F.lit(int(r.literal)).cast("long") if is_span(r.type) else F.lit(int(r.literal * 1_000_000)).cast("long")
        zero = 62_135_596_800_000_000
        at = F.unix_micros(v.col.cast("timestamp")) + F.lit(zero)
        cut = F.timestamp_micros(at - F.pmod(at, us) - F.lit(zero))
        return Typed(F.when(us > 0, cut.cast(time_type(v))), time_type(v))
    if is_span(v.type):
        us, step = span_us(v.col), span_us(span(r))
        from .coerce import span_of

        return Typed(span_of(us - F.pmod(us, step)), DAY_TIME)
    if is_text(v.type):
        return Typed(F.lit(None).cast("double"), DBL)
    x, step = num(v).cast("double"), num(r).cast("double")
    return Typed(F.floor(F.try_divide(x, step)) * step, DBL)


@register("min_of")
def _min_of(*xs):
    return Typed(F.least(*[num(x).cast("double") for x in xs], F.lit(None).cast("double")), DBL)


@register("max_of")
def _max_of(*xs):
    return Typed(F.greatest(*[num(x).cast("double") for x in xs], F.lit(None).cast("double")), DBL)


@register("now")
def _now(d=None):
    return Typed(F.current_timestamp() + span(d) if d is not None else F.current_timestamp(), T.TimestampType())


@register("ago")
def _ago(d):
    return Typed(F.current_timestamp() - span(d), T.TimestampType())


PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "dayofyear": F.dayofyear, "dayofweek": lambda c: F.dayofweek(c) - 1}
for _name, _part in {"getyear": "year", "getmonth": "month", "monthofyear": "month", "dayofmonth": "day", "dayofyear": "dayofyear", "hourofday": "hour", "dayofweek": "dayofweek"}.items():
    register(_name)(lambda x, p=_part: Typed(PARTS[p](ts(x)).cast("long"), LNG))


@register("datetime_part")
def _datetime_part(part, x):
    f = PARTS.get(str(_lit(part, "the part")).lower())
    return Typed(f(ts(x)).cast("long") if f else F.lit(None).cast("long"), LNG)


for _unit in ("day", "hour", "minute"):
    register(f"startof{_unit}")(lambda x, u=_unit: Typed(F.date_trunc(u, ts(x)).cast(time_type(x)), time_type(x)))


@register("endofday")
def _endofday(x):
    return Typed((F.date_trunc("day", ts(x)) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 0.000001 SECOND")).cast(time_type(x)), time_type(x))


@register("format_datetime")
def _format_datetime(x, f):
    layout = re.sub(r"[A-Za-z]+", lambda m: m[0] if re.fullmatch("yyyy|yy|MM|dd|HH|mm|ss|SSS|fff", m[0]) else "".join(k if re.fullmatch("yyyy|yy|MM|dd|HH|mm|ss|fff", k) else f"'{k}'" for k in re.findall("yyyy|yy|MM|dd|HH|mm|ss|fff|.", m[0])), str(_lit(f, "the format"))).replace("fff", "SSS")
    return Typed(F.date_format(ts(x), layout), STR)


SECONDS = {"millisecond": 0.001, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


@register("datetime_diff")
def _datetime_diff(part, a, b):
    p, x, y = str(_lit(part, "the part")).lower(), ts(a).cast("timestamp"), ts(b).cast("timestamp")
    if p in ("month", "year"):
        months = (F.year(x) - F.year(y)) * 12 + F.month(x) - F.month(y)
        return Typed((months if p == "month" else F.year(x) - F.year(y)).cast("long"), LNG)
    if p not in SECONDS:
        return Typed(F.lit(None).cast("long"), LNG)
    us, unit = F.unix_micros(x) - F.unix_micros(y), int(SECONDS[p] * 1_000_000)
    return Typed((F.signum(us.cast("double")) * F.floor(F.abs(us) / unit)).cast("long"), LNG)


@register("datetime_add")
def _datetime_add(part, n, x):
    """Months that are too short run over into the next."""
    p, k, t = str(_lit(part, "the part")).lower(), num(n), ts(x)
    if p in ("month", "year"):
        first = F.add_months(F.trunc(t, "MM"), (k * (12 if p == "year" else 1)).cast("int"))
        day = F.date_add(first, F.dayofmonth(t) - 1)
        clock = F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.date_trunc("day", t).cast("timestamp"))
        return Typed(F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + clock).cast(time_type(x)), time_type(x))
    if p not in SECONDS:
        return Typed(F.lit(None).cast(time_type(x)), time_type(x))
    return Typed(F.timestamp_micros((F.unix_micros(t.cast("timestamp")) + k * int(SECONDS[p] * 1_000_000)).cast("long")).cast(time_type(x)), time_type(x))


@register("array_length")
def _array_length(x):
    return Typed(F.when(x.col.isNotNull(), F.size(x.col)).cast("long") if isinstance(x.type, T.ArrayType) else F.lit(None).cast("long"), LNG)


@register("pack_array")
def _pack_array(*xs):
    xs = unify(list(xs))
    return Typed(F.array(*[x.col for x in xs]), T.ArrayType(xs[0].type if xs else STR))
