"""Results as text: table, json, ndjson, tsv; and files of them by Spark's own writers."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.coerce import Typed, is_span, is_time, txt

LEVEL_COLUMNS = {"level", "lvl", "severity", "loglevel", "log_level"}
# The levels of each colour (terminal codes).
COLOURS = {
    level: code
    for code, levels in {"31": "error err severe sev", "1;31": "fatal crit critical panic emerg alert", "33": "warn warning", "32": "info notice", "90": "debug", "36": "trace verbose"}.items()
    for level in levels.split()
}
FORMATS = ("table", "json", "ndjson", "jsonl", "tsv")


def shown(df: DataFrame) -> DataFrame:
    """Times and durations as text; the rest as it is."""
    return df.select(*[txt(Typed(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) if is_time(f.dataType) or is_span(f.dataType) else F.col(f"`{f.name}`") for f in df.schema])


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(txt(Typed(F.col(f"`{f.name}`"), f.dataType)), F.lit("")).alias(f.name) for f in df.schema])


def lines(df: DataFrame, fmt: str = "table", colour: bool = False) -> Iterator[str]:
    """All rows as lines of text, which come from one partition after the other."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown output {fmt!r}; known: {', '.join(FORMATS)}")
    return _table(df, colour) if fmt == "table" else _tsv(df) if fmt == "tsv" else _json(df) if fmt == "json" else map(_plain_json, _rows(df))


def render(df: DataFrame, fmt: str = "table", colour: bool = False) -> str:
    return "\n".join(lines(df, fmt, colour))


def _rows(df: DataFrame) -> Iterator:
    return map(json.loads, shown(df).toJSON().toLocalIterator())


def _plain_json(row) -> str:
    return json.dumps(row, ensure_ascii=False)


def _json(df: DataFrame) -> Iterator[str]:
    last = None
    for row in _rows(df):
        yield "[" if last is None else f"{last},"
        last = "  " + json.dumps(row, indent=2, ensure_ascii=False).replace("\n", "\n  ")
    yield from ("[]",) if last is None else (last, "]")


def _tsv(df: DataFrame) -> Iterator[str]:
    yield "\t".join(df.columns)
    yield from map("\t".join, as_text(df).toLocalIterator())


def _table(df: DataFrame, colour: bool = False, group: str | None = None) -> Iterator[str]:
    """A table; with a group column, which isn't shown, `--` where its value changes."""
    names = [n for n in df.columns if n != group]
    if not names:
        yield "(no columns)"
        return
    # Widths need a pass of their own, over the same rows.
    rows = as_text(df).persist()
    try:
        wide = [max(len(n), w or 0) for n, w in zip(names, rows.agg(*[F.max(F.length(f"`{n}`")) for n in names]).first(), strict=True)]
        line = lambda cells: "  ".join(f"{c:<{w}}" for c, w in zip(cells, wide, strict=True)).rstrip()

        def painted(r: tuple) -> str:
            cells = [f"{c:<{w}}" for c, w in zip(r, wide, strict=True)]
            for k, n in enumerate(names):
                if colour and n.lower() in LEVEL_COLUMNS and (code := COLOURS.get(r[k].strip().lower())):
                    cells[k] = f"\x1b[{code}m{cells[k]}\x1b[0m"
            return "  ".join(cells).rstrip()

        yield line(names)
        yield "  ".join("-" * w for w in wide)
        before = None
        for r in rows.select(*[f"`{n}`" for n in names], *([group] if group else [])).toLocalIterator():
            if group and before not in (None, r[-1]):
                yield "--"
            before = r[-1]
            yield painted(tuple(r)[: len(names)])
    finally:
        rows.unpersist()


def table(df: DataFrame, colour: bool = False) -> str:
    return "\n".join(_table(df, colour))


def context_lines(df: DataFrame, colour: bool = False) -> Iterator[str]:
    """Groups of neighbouring rows, `--` between them."""
    from .operators.context import GROUP

    return _table(df, colour, GROUP)


def context_table(df: DataFrame) -> str:
    return "\n".join(context_lines(df))


def write(df: DataFrame, path: str, fmt: str = "ndjson") -> None:
    """Files by Spark's writers, in parallel."""
    if fmt in ("ndjson", "jsonl", "json"):
        shown(df).write.json(path)
    elif fmt == "tsv":
        as_text(df).write.csv(path, sep="\t", header=True, quote="")
    elif fmt == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"can't write {fmt!r}")


__all__ = ["lines", "render", "table", "context_lines", "context_table", "write"]
