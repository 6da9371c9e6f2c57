"""Aggregates of summarize: default names and columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import Call, Field, QueryError
from .coerce import is_time, num, truthy, txt
from .expressions import Scope

#: The column that holds the order of the rows, where an aggregate asks for one.
ORD = "__ord"


def label(e, source: str = "") -> str:
    """How an expression is called in a default name."""
    return e.name if isinstance(e, Field) else re.sub(r"[^0-9A-Za-z]+", "_", source).strip("_")


ORDERED = {"make_list", "makelist", "make_set", "makeset", "any", "take_any", "arg_any", "arg_max", "arg_min"}


def _value(scope: Scope, e) -> Column:
    return num(scope.typed(e))


def _extreme(f: Callable) -> Callable:
    def make(scope: Scope, args: tuple) -> Column:
        x = scope.typed(args[0])
        return f(x.col) if is_time(x.type) or isinstance(x.type, T.StringType) else f(num(x))

    return make


def _need(name: str, args: tuple, n: int) -> None:
    if len(args) < n:
        raise QueryError(f"{name} needs {n} argument{'s' * (n > 1)}")


def _listed(scope: Scope, args: tuple) -> Column:
    x = scope.typed(args[0])
    pairs = F.array_sort(F.collect_list(F.when(x.col.isNotNull(), F.struct(F.col(ORD).alias("o"), x.col.alias("x")))))
    return F.transform(pairs, lambda p: p["x"])


def _set(scope: Scope, args: tuple) -> Column:
    return F.array_distinct(_listed(scope, args))


def _any(scope: Scope, args: tuple) -> Column:
    x = scope.typed(args[0])
    return F.min_by(x.col, F.when(x.col.isNotNull(), F.col(ORD)))


def _percentile(scope: Scope, args: tuple) -> Column:
    _need("percentile", args, 2)
    p = getattr(args[1], "value", None)
    if not isinstance(p, int | float) or not 0 <= p <= 100:
        raise QueryError("percentile needs a number from 0 to 100")
    return F.percentile(_value(scope, args[0]).cast("double"), p / 100)


AGGREGATES: dict[str, tuple[str, int, Callable[[Scope, tuple], Column]]] = {
    "countif": ("countif", 1, lambda s, a: F.count_if(truthy(s.typed(a[0])))),
    "sum": ("sum_", 1, lambda s, a: F.coalesce(F.sum(_value(s, a[0])), F.lit(0))),
    "sumif": ("sum_", 2, lambda s, a: F.coalesce(F.sum(F.when(truthy(s.typed(a[1])), _value(s, a[0]))), F.lit(0))),
    "avg": ("avg_", 1, lambda s, a: F.avg(_value(s, a[0]))),
    "avgif": ("avg_", 2, lambda s, a: F.avg(F.when(truthy(s.typed(a[1])), _value(s, a[0])))),
    "min": ("min_", 1, _extreme(F.min)),
    "max": ("max_", 1, _extreme(F.max)),
    "dcount": ("dcount_", 1, lambda s, a: F.count_distinct(txt(s.typed(a[0])) if not isinstance(s.typed(a[0]).type, T.AtomicType) else s.typed(a[0]).col)),
    "make_list": ("list_", 1, _listed),
    "make_set": ("set_", 1, _set),
    "any": ("any_", 1, _any),
    "percentile": ("percentile_", 2, _percentile),
    "stdev": ("stdev_", 1, lambda s, a: F.stddev_samp(_value(s, a[0]))),
    "stdevp": ("stdevp_", 1, lambda s, a: F.stddev_pop(_value(s, a[0]))),
    "variance": ("variance_", 1, lambda s, a: F.var_samp(_value(s, a[0]))),
    "varp": ("varp_", 1, lambda s, a: F.var_pop(_value(s, a[0]))),
    "count_col": ("count_", 1, lambda s, a: F.count(s.column(a[0]))),
}
SAME = {"mean": "avg", "count_distinct": "dcount", "makelist": "make_list", "makeset": "make_set", "take_any": "any", "arg_any": "any", "percentiles": "percentile"}


def is_aggregate(name: str) -> bool:
    return name in ("count", "arg_max", "arg_min") or SAME.get(name, name) in AGGREGATES


def is_set(call: Call) -> bool:
    return SAME.get(call.name, call.name) == "make_set"


def aggregate(scope: Scope, name: str, given: bool, call: Call, source: str = "") -> list[tuple[str, Column]]:
    """(name, column) of what an aggregate gives; source: its text."""
    f, args = SAME.get(call.name, call.name), call.args
    if f == "count":
        return [(name if given else "count", F.count(F.lit(1)))]
    if f in ("arg_max", "arg_min"):
        _need(f, args, 1)
        return _arg(scope, f, name if given else label(args[0], source), args)
    if f not in AGGREGATES:
        raise QueryError(f"unknown aggregate {call.name!r}")
    prefix, n, make = AGGREGATES[f]
    _need(f, args, n)
    inner = source[source.find("(") + 1 : source.rfind(")")] if "(" in source else ""
    default = prefix if not prefix.endswith("_") else prefix + label(args[0], inner.split(",")[0])
    if f == "percentile":
        default += f"_{getattr(args[1], 'value', '')}"
    return [(name if given else default, make(scope, args))]


def _arg(scope: Scope, f: str, name: str, args: tuple) -> list[tuple[str, Column]]:
    """The first row of the largest or smallest metric."""
    metric = scope.typed(args[0])
    key = num(metric) if not is_time(metric.type) and not isinstance(metric.type, T.StringType) else metric.col
    tie = -F.col(ORD) if f == "arg_max" else F.col(ORD)
    by = F.when(key.isNotNull(), F.struct(key.alias("k"), tie.alias("o")))
    pick = F.max_by if f == "arg_max" else F.min_by
    names = []
    for a in args[1:]:
        names += [n for n in scope.types if n != ORD] if isinstance(a, Field) and a.name == "*" else [a.name] if isinstance(a, Field) else []
    if len(args) == 1:
        names = []
    return [(name, (F.max if f == "arg_max" else F.min)(key))] + [(n, pick(scope.field(n).col, by)) for n in dict.fromkeys(names) if n != name]
