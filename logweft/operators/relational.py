"""The stages of a pipeline, one function each: (state, stage, engine) -> state."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import ORD, ORDERED, aggregate, is_set, label
from ..functions.coerce import is_number, num, text
from ..functions.expressions import Scope
from ..functions.scalar import type_name
from ..plans.stages import Stage
from ..plans.syntax import Field
from .numbering import running
from .state import State

STAGES: dict[str, Callable] = {}


def stage(*names: str) -> Callable:
    def add(f: Callable) -> Callable:
        STAGES.update(dict.fromkeys(names, f))
        return f

    return add


def q(name: str) -> Column:
    return F.col(f"`{name}`")


@stage("where")
def where(s: State, st: Stage, engine) -> State:
    return s.to(s.df.filter(Scope(s.df).test(st.items[0], bare=True)))


@stage("take")
def take(s: State, st: Stage, engine) -> State:
    return s.to(s.df.limit(st.n))


@stage("count")
def count(s: State, st: Stage, engine) -> State:
    return s.to(s.df.agg(F.count(F.lit(1)).alias("count")), ())


@stage("project")
def project(s: State, st: Stage, engine) -> State:
    scope = Scope(s.df)
    # Of equal names the last one counts.
    items = {i.name: scope.column(i.expr) for i in st.items}
    # The order of a sort before is the frame's own; its keys may be gone.
    return State(s.df.select(*[c.alias(n) for n, c in items.items()]))


def matching(patterns: tuple, names: list[str]) -> list[str]:
    out = []
    for p in patterns:
        out += [n for n in names if (n.startswith(p[:-1]) if p.endswith("*") else n == p) and n not in out]
    return out


@stage("project-away")
def project_away(s: State, st: Stage, engine) -> State:
    gone = matching(st.items, s.df.columns)
    return State(s.df.select(*[q(n) for n in s.df.columns if n not in gone]))


@stage("project-keep")
def project_keep(s: State, st: Stage, engine) -> State:
    kept = matching(st.items, s.df.columns)
    return State(s.df.select(*[q(n) for n in s.df.columns if n in kept]))


@stage("project-reorder")
def project_reorder(s: State, st: Stage, engine) -> State:
    first = matching(st.items, s.df.columns)
    return State(s.df.select(*[q(n) for n in first], *[q(n) for n in s.df.columns if n not in first]))


@stage("project-rename")
def project_rename(s: State, st: Stage, engine) -> State:
    new = {i.expr.name: i.name for i in st.items}
    last = {new.get(n, n): n for n in s.df.columns}
    return State(s.df.select(*[q(old).alias(name) for name, old in last.items()]))


@stage("extend")
def extend(s: State, st: Stage, engine) -> State:
    """All items see the row as it came in."""
    scope = Scope(s.df)
    items = {i.name: scope.column(i.expr) for i in st.items}
    kept = [items.pop(n).alias(n) if n in items else q(n) for n in s.df.columns]
    return State(s.df.select(*kept, *[c.alias(n) for n, c in items.items()]))


def sort_keys(df: DataFrame, by: tuple) -> tuple[Column, ...]:
    """Null is the lowest value; texts sort as texts."""
    scope, out = Scope(df), []
    for k in by:
        x = scope.typed(k.expr)
        out.append(x.col.desc_nulls_last() if k.desc else x.col.asc_nulls_first())
    return tuple(out)


@stage("sort")
def sort(s: State, st: Stage, engine) -> State:
    keys = sort_keys(s.df, st.by)
    return State(s.df.orderBy(*keys), keys)


@stage("top")
def top(s: State, st: Stage, engine) -> State:
    keys = sort_keys(s.df, st.by)
    return State(s.df.orderBy(*keys).limit(st.n), keys)


@stage("distinct")
def distinct(s: State, st: Stage, engine) -> State:
    if not st.items:
        return s.to(s.df.distinct(), ())
    scope = Scope(s.df)
    return State(s.df.select(*[scope.column(i.expr).alias(i.name) for i in st.items]).distinct())


def key_name(item) -> str:
    """By default a call's first field, else the expression's text without signs."""
    if item.given or isinstance(item.expr, Field):
        return item.name
    args = getattr(item.expr, "args", ())
    return args[0].name if args and isinstance(args[0], Field) else label(item.expr, item.name)


@stage("summarize")
def summarize(s: State, st: Stage, engine) -> State:
    df = s.numbered() if any(i.expr.name in ORDERED for i in st.items) else s.df
    scope = Scope(df)
    keys = {key_name(i): scope.column(i.expr) for i in st.by}
    out: dict[str, Column] = {}
    sets: dict[str, Column] = {}
    for i in st.items:
        found = dict(aggregate(scope, i.name, i.given, i.expr, i.name))
        out |= found
        if is_set(i.expr):
            sets |= dict.fromkeys(found, scope.typed(i.expr.args[0]).col)
    named = [c.alias(n) for n, c in keys.items()]
    aggs = [c.alias(n) for n, c in out.items() if n not in keys and n not in sets]
    rows = [F.count(F.lit(1)).alias("__rows")] if not keys or not aggs else []
    grouped = df.groupBy(*named).agg(*aggs, *rows)
    for k, (n, value) in enumerate((n, c) for n, c in sets.items() if n not in keys):
        grouped = _with_set(df, named, list(keys), grouped, n, value, k)
    if not keys and engine.compat:
        grouped = grouped.filter("__rows > 0")
    return State(grouped.select(*[q(n) for n in dict.fromkeys([*keys, *out])]))


def _with_set(df: DataFrame, named: list[Column], keys: list[str], grouped: DataFrame, name: str, value: Column, k: int) -> DataFrame:
    """grouped with the distinct values of each group, in the order in which they come first. Equal values meet before a
    group's values do, so no group is ever gathered with its repeats."""
    first = df.groupBy(*named, value.alias("__x")).agg(F.min(ORD).alias("__o")).filter("__x IS NOT NULL")
    listed = F.array_sort(F.collect_list(F.struct("__o", "__x")))
    lists = first.groupBy(*[q(n).alias(f"__k{k}_{i}") for i, n in enumerate(keys)]).agg(F.transform(listed, lambda p: p["__x"]).alias(f"__set{k}"))
    on = reduce(lambda a, b: a & b, [q(n).eqNullSafe(F.col(f"__k{k}_{i}")) for i, n in enumerate(keys)], F.lit(True))
    empty = F.array().cast(lists.schema[f"__set{k}"].dataType)
    return grouped.join(lists, on, "left").withColumn(name, F.coalesce(f"__set{k}", empty)).drop(f"__set{k}", *[f"__k{k}_{i}" for i in range(len(keys))])


@stage("getschema")
def getschema(s: State, st: Stage, engine) -> State:
    rows = [(f.name, i, type_name(f.dataType)) for i, f in enumerate(s.df.schema) if f.name != ORD]
    return State(engine.spark.createDataFrame(rows, "ColumnName string, ColumnOrdinal long, ColumnType string"))


@stage("print")
def print_(s: State, st: Stage, engine) -> State:
    one = engine.spark.range(1)
    scope = Scope(one.select())
    return State(one.select(*[scope.column(i.expr).alias(i.name) for i in st.items]))


@stage("parse")
def parse(s: State, st: Stage, engine) -> State:
    """Literals are searched one after the other; a field takes what lies before the next literal, or all that is left.

    Where a literal is missing, the search stops and later fields keep their old value."""
    scope = Scope(s.df)
    src, at, alive = text(scope.typed(st.by[0])), F.lit(1), F.lit(True)
    found: dict[str, Column] = {}
    pending: str | None = None
    for kind, value in (*st.items, ("end", None)):
        if kind in ("field", "skip"):
            if pending is not None and kind == "field":
                # Two fields in a row: the first takes all that is left.
                found[pending] = F.when(alive, F.substr(src, at))
                at = F.length(src) + 1
            if kind == "field":
                pending = value
            continue
        if kind == "text":
            hit = F.call_function("locate", F.lit(value), src, at)
            if pending is not None:
                found[pending] = F.when(alive & (hit > 0), F.substr(src, at, hit - at)).when(alive, F.substr(src, at))
                pending = None
            alive, at = alive & (hit > 0), hit + len(value)
        elif pending is not None:
            found[pending] = F.when(alive, F.substr(src, at))
    keep = {n: F.coalesce(c, text(scope.field(n))) if n in scope.types else c for n, c in found.items()}
    return State(s.df.withColumns(keep))


@stage("mv-expand")
def mv_expand(s: State, st: Stage, engine) -> State:
    """Arrays side by side, the shorter ones padded with null; an empty array gives one row with null."""
    scope = Scope(s.df)
    arrays = {i.name: scope.typed(i.expr) for i in st.items}
    lists = {n: x for n, x in arrays.items() if isinstance(x.type, T.ArrayType)}
    df = s.df
    extra = {n: x.col for n, x in arrays.items() if n not in lists and n not in df.columns}
    if extra:
        df = df.withColumns(extra)
    if not lists:
        return State(df)
    zipped = F.arrays_zip(*[F.coalesce(x.col, F.array().cast(x.type)).alias(f"__{k}") for k, x in enumerate(lists.values())])
    kept = [q(n) for n in df.columns if n not in lists]
    names = [n for n in df.columns if n in lists] + [n for n in lists if n not in df.columns]
    place = {n: k for k, n in enumerate(lists)}
    out = df.select(*kept, F.explode_outer(zipped).alias("__z"))
    columns = [n for n in df.columns] + [n for n in lists if n not in df.columns]
    fields = out.schema["__z"].dataType.names
    return State(out.select(*[q("__z").getField(fields[place[n]]).alias(n) if n in names else q(n) for n in columns]))


@stage("sample")
def sample(s: State, st: Stage, engine) -> State:
    return s.to(s.df.orderBy(F.rand()).limit(st.n), ())


@stage("sample-distinct")
def sample_distinct(s: State, st: Stage, engine) -> State:
    """The first n distinct values."""
    df, item = s.numbered(), st.items[0]
    value = Scope(df).column(item.expr).alias(item.name)
    first = df.groupBy(value).agg(F.min(ORD).alias(ORD)).orderBy(ORD).limit(max(1, st.n))
    return State(first.select(q(item.name)))


@stage("serialize")
def serialize(s: State, st: Stage, engine) -> State:
    """Numbers rows in their order."""
    if not st.items:
        return s
    name = st.items[0].name
    return State(running(s.df.drop(name), name, st.n, order=s.order), s.order)


@stage("union")
def union(s: State, st: Stage, engine) -> State:
    df = s.df
    for src in st.items:
        other = engine.resolve(src)
        df, other = _alike(df, other)
        df = df.unionByName(other, allowMissingColumns=True)
    return State(df.select(*[q(n) for n in sorted(df.columns)]))


def _alike(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns of one name but different kinds become real where both are numbers, else text."""
    ta, tb = {f.name: f.dataType for f in a.schema}, {f.name: f.dataType for f in b.schema}
    for n in ta.keys() & tb.keys():
        if ta[n] != tb[n]:
            both = is_number(ta[n]) and is_number(tb[n])
            cast = lambda df, n=n, both=both: df.withColumn(n, num(Scope(df).field(n)).cast("double") if both else text(Scope(df).field(n)))
            a, b = cast(a), cast(b)
    return a, b


@stage("render")
def render(s: State, st: Stage, engine) -> State:
    return s if st.kind == "table" else s.with_chart(st)


@stage("offset")
def offset(s: State, st: Stage, engine) -> State:
    return s.to(s.df.offset(st.n))
