"""Joins and lookup. Null keys match null keys; a right column whose name is taken gets a 1 behind it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import ORD
from ..functions.coerce import is_number, is_text, num, txt
from ..functions.expressions import Scope
from ..plans.stages import Stage
from .relational import q, stage
from .state import State

#: A lookup's table is a dimension; it, or what a hint names, is broadcast up to this many rows, else joined by key.
BROADCAST_ROWS = 200_000


def _equal(left: DataFrame, right: DataFrame, a: str, b: str) -> tuple[Column, Column]:
    """Both keys, of one kind."""
    x, y = Scope(left).field(a), Scope(right).field(b)
    if x.type == y.type or (is_number(x.type) and is_number(y.type)):
        return x.col, y.col
    if is_number(x.type) and is_text(y.type) or is_text(x.type) and is_number(y.type):
        return num(x), num(y)
    return txt(x), txt(y)


def _fresh(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "1"
    return name


@stage("join")
def join(s: State, st: Stage, engine) -> State:
    left, right, kind = s.df, engine.resolve(st.source), st.kind
    if kind.startswith("right_"):
        left, right, kind = right, left, f"left_{kind[6:]}"
        pairs = [(b, a) for a, b in st.by]
    else:
        pairs = list(st.by)
    keys = []
    for k, (a, b) in enumerate(pairs):
        x, y = _equal(left, right, a, b)
        left, right = left.withColumn(f"__l{k}", x), right.withColumn(f"__r{k}", y)
        # Keys that can't be null need no null-safe test.
        keys.append(q(f"__l{k}") == q(f"__r{k}") if not (left.schema[f"__l{k}"].nullable and right.schema[f"__r{k}"].nullable) else q(f"__l{k}").eqNullSafe(q(f"__r{k}")))
    semi = kind in ("left_semi", "left_anti")
    taken, names = set(left.columns), {}
    for n in right.columns:
        names[n] = n if n.startswith("__r") else _fresh(n, taken)
        taken.add(names[n])
    right = right.select(*[q(n).alias(m) for n, m in names.items()])
    if st.options.get("hint.strategy") == "broadcast" and right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    out = left.join(right, reduce(lambda a, b: a & b, keys), kind)
    drop = [f"__l{k}" for k in range(len(keys))] + ([] if semi else [f"__r{k}" for k in range(len(keys))])
    return State(out.drop(*drop))


@stage("lookup")
def lookup(s: State, st: Stage, engine) -> State:
    """The first row of each key on the right adds its columns; what the left has already stays."""
    right = State(engine.resolve(st.source)).numbered()
    left = s.df
    pairs = [_equal(left, right, a, b) for a, b in st.by]
    names = [n for n in right.columns if n not in left.columns and n not in {b for _, b in st.by} and n != ORD]
    for k, (x, y) in enumerate(pairs):
        left, right = left.withColumn(f"__l{k}", x), right.withColumn(f"__r{k}", y)
    keys = [f"__r{k}" for k in range(len(pairs))]
    first = right.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(ORD))).filter("__n = 1").select(*keys, *[q(n) for n in names])
    if first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    on = reduce(lambda a, b: a & b, [q(f"__l{k}").eqNullSafe(q(f"__r{k}")) for k in range(len(pairs))])
    out = left.join(first, on, st.kind)
    return State(out.select(*[q(n) for n in s.df.columns], *[q(n) for n in names]))
