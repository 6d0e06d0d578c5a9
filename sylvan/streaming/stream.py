"""Queries on unbounded rows: what of the language needs no order of the whole context.

Filters, expressions, records and scalar functions run row by row; ``group`` by keys and reducers of any order
run over event-time windows behind a watermark.  Everything that reads positions, neighbours or the whole
context is refused before a stream starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.ast import Query, Ref, Sub, walk
from ..lang.parser import parse
from ..plans.compiler import Compiler
from ..plans.state import CompileError
from ..sources.model import Table, Tables

_ROW = {"filter", "expr", "push", "pushtopic", "subst", "call"}
_REDUCERS = {"count", "sum", "min", "max", "mean"}


def check(q: Query) -> None:
    """Refuses what can't run on a stream."""
    if q.correlations or len(q.branches) != 1:
        raise CompileError("a stream has no joins or unions here")
    if any(isinstance(x, Sub) or isinstance(x, Ref) and x.kind in ("ord", "input", "witness") for x in walk(q)):
        raise CompileError("a stream has no whole context to read")
    grouped = False
    for s in q.pipeline:
        if s.pipe == "@|" and s.op == "call" and s.name == "group" and not grouped:
            grouped = True
        elif grouped and s.op == "call" and s.pipe == "|" and s.name in _REDUCERS:
            grouped = False
        elif grouped or s.pipe != "|" or s.op not in _ROW or s.op == "call" and s.name in ("sort", "top", "bottom", "reverse"):
            raise CompileError(f"'{s.name or s.op}' needs the whole context and can't run on a stream")


def query(df: DataFrame, text: str, time: str | None = None, late: str | None = None) -> DataFrame:
    """A streaming DataFrame for a query on ``/row``; ``late`` is the watermark on the column ``time``."""
    q = parse(text)
    check(q)
    if late:
        df = df.withWatermark(time, late)
    source = Tables({"row": Table("row", df, (), None)}, "row")
    compiler = Compiler(df.sparkSession, source)
    return compiler.result(compiler.query(q), ordered=False)


def windows(df: DataFrame, time: str, width: str, late: str, keys: tuple[str, ...] = (), value: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts, and sums of ``value``, by event-time window and keys."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    aggregates = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = df.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in out.columns if c not in ("w", *keys)])
