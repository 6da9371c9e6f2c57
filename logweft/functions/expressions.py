"""From expression trees to columns, against a schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import Between, Binary, Call, Field, In, Index, Lit, QueryError, Span, Unary
from .coerce import DAY_TIME, Typed, arith, compare, is_span, num, span_us, text, truthy
from .scalar import call, regex

BOOL = T.BooleanType()


def literal(v) -> Typed:
    if v is None:
        return Typed(F.lit(None), T.NullType(), None, True)
    kind = T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()
    return Typed(F.lit(v).cast(kind) if not isinstance(v, str | bool) else F.lit(v), kind, v, True)


class Scope:
    """The columns of a frame."""

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema}

    def field(self, name: str) -> Typed:
        """A column of that very name, or a path into one; null where there is none."""
        if name in self.types:
            return Typed(F.col(f"`{name}`"), self.types[name])
        parts = name.split(".")
        for k in range(len(parts) - 1, 0, -1):
            head = ".".join(parts[:k])
            if head in self.types:
                out, kind = F.col(f"`{head}`"), self.types[head]
                for p in parts[k:]:
                    if isinstance(kind, T.StructType) and p in kind.names:
                        out, kind = out.getField(p), kind[p].dataType
                    elif isinstance(kind, T.MapType):
                        out, kind = out.getItem(p), kind.valueType
                    else:
                        return literal(None)
                return Typed(out, kind)
        return literal(None)

    def typed(self, e) -> Typed:
        if isinstance(e, Lit):
            return literal(e.value)
        if isinstance(e, Span):
            whole, rest = divmod(abs(e.us), 1_000_000)
            sign = "-" if e.us < 0 else ""
            return Typed(F.expr(f"INTERVAL '{sign}{whole}.{rest:06d}' SECOND").cast(DAY_TIME), DAY_TIME, e.us, True)
        if isinstance(e, Field):
            return self.field(e.name)
        if isinstance(e, Call):
            return call(e.name, [self.typed(a) for a in e.args])
        if isinstance(e, Index):
            return self._index(e)
        if isinstance(e, Unary) and e.op == "-":
            x = self.typed(e.of)
            if is_span(x.type):
                return Typed(-x.col, DAY_TIME)
            return arith("-", literal(0), x)
        if isinstance(e, Binary) and e.op in "+-*/%":
            return arith(e.op, self.typed(e.left), self.typed(e.right))
        return Typed(self.test(e), BOOL)

    def _index(self, e: Index) -> Typed:
        x, i = self.typed(e.of), self.typed(e.at)
        if isinstance(x.type, T.ArrayType):
            return Typed(F.get(x.col, num(i).cast("int")), x.type.elementType)
        if isinstance(x.type, T.MapType):
            return Typed(x.col[text(i)], x.type.valueType)
        if isinstance(x.type, T.StructType) and i.constant and i.literal in x.type.names:
            return Typed(x.col.getField(i.literal), x.type[i.literal].dataType)
        return literal(None)

    def column(self, e) -> Column:
        return self.typed(e).col

    def test(self, e, bare: bool = False) -> Column:
        """A condition. bare: in a filter, where null may stand for false, so that the scan can take it."""
        if isinstance(e, Binary) and e.op in ("and", "or"):
            a, b = self.test(e.left, bare), self.test(e.right, bare)
            return a & b if e.op == "and" else a | b
        if isinstance(e, Unary) and e.op == "not":
            return ~self.test(e.of)
        if isinstance(e, In):
            tests = [compare("==", self.typed(e.of), self.typed(i), bare and not e.negated) for i in e.items]
            listed = self._isin(e, bare)
            found = listed if listed is not None else reduce(lambda a, b: a | b, tests, F.lit(False))
            return ~found if e.negated else found
        if isinstance(e, Between):
            x = self.typed(e.of)
            return compare(">=", x, self.typed(e.low), bare) & compare("<=", x, self.typed(e.high), bare)
        if isinstance(e, Binary):
            return self._binary(e, bare)
        return truthy(self.typed(e))

    def _isin(self, e: In, bare: bool) -> Column | None:
        x = self.typed(e.of)
        kinds = {type(i.value) for i in e.items if isinstance(i, Lit)}
        same = all(isinstance(i, Lit) for i in e.items) and ((kinds == {str} and isinstance(x.type, T.StringType) and "" not in [i.value for i in e.items] and not any(_number(i.value) for i in e.items)) or (kinds and kinds <= {int, float} and isinstance(x.type, T.NumericType)))
        if not same:
            return None
        found = x.col.isin(*[i.value for i in e.items])
        return found if bare and not e.negated else F.coalesce(found, F.lit(False))

    def _binary(self, e: Binary, bare: bool) -> Column:
        a, b = self.typed(e.left), self.typed(e.right)
        if e.op in ("==", "!=", "<", "<=", ">", ">="):
            return compare(e.op, a, b, bare)
        if e.op in ("=~", "!~"):
            same = F.lower(text(a)) == F.lower(text(b))
            return same if e.op == "=~" else ~same
        if e.op == "matches":
            if not b.constant:
                return F.coalesce(text(a).rlike(b.col), F.lit(False))
            return text(a).rlike(regex(str(b.literal)))
        x, y = F.lower(text(a)), F.lower(text(b))
        if e.op == "has":
            return F.array_contains(F.split(x, r"[^\p{L}\p{Nd}]+"), y) & (y != "")
        return {"contains": x.contains, "startswith": x.startswith, "endswith": x.endswith}[e.op](y)


def _number(s: str) -> bool:
    try:
        float(s)
    except ValueError:
        return False
    return True


def span_micros(x: Typed) -> Column:
    return span_us(x.col)


__all__ = ["Scope", "QueryError", "literal", "span_micros"]
