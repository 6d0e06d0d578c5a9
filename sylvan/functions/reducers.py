"""Reducers: over rows as aggregates, over windows, and over list topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quantity
from .readings import Val, display, instant, number, seconds
from .temporal import span

LONG, DOUBLE, STRING = T.LongType(), T.DoubleType(), T.StringType()
REDUCERS = ("count", "sum", "product", "min", "max", "mean", "median", "stddev", "variance", "join", "first", "last", "unique")


def _numbers(v: Val) -> Column:
    n = number(v)
    return n if n is not None else F.lit(None).cast("double")


def reduce_rows(name: str, v: Val, args: list, order: Column | None) -> Val:
    """The aggregate of v over rows; ``order`` ranks rows where the result depends on it."""
    if name == "count":
        return Val(F.count(F.lit(1)), LONG)
    if name in ("first", "last"):
        pick = F.min_by if name == "first" else F.max_by
        return Val(pick(v.col, order) if order is not None else F.first(v.col), v.type)
    if name == "join":
        sep = args[0].value if args else ""
        items = F.collect_list(F.struct(order.alias("o"), F.coalesce(display(v), F.lit("")).alias("x"))) if order is not None else F.collect_list(F.coalesce(display(v), F.lit("")))
        return Val(F.array_join(F.transform(F.array_sort(items), lambda s: s["x"]) if order is not None else items, sep), STRING)
    if name == "unique":
        return Val(F.collect_set(v.col), T.ArrayType(v.type))
    if v.duration:
        s = seconds(v)
        f = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median}.get(name)
        return Val(span(f(s)), v.type) if f else Val(F.lit(None).cast("double"), DOUBLE)
    if quantity.is_quantity(v):
        f = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}.get(name)
        value = f(v.col["value"])
        same = F.count_distinct(v.col["base"]) == 1
        return Val(F.when(same, F.struct(value.alias("value"), F.first(v.col["base"]).alias("base"), (value / F.first(v.col["value"] / v.col["written"])).alias("written"), F.first(v.col["unit"]).alias("unit"))), quantity.TYPE)
    if name in ("min", "max") and v.instant:
        return Val((F.min if name == "min" else F.max)(v.col), v.type)
    if name in ("min", "max") and v.text:  # the value of the least reading
        n = _numbers(v)
        f = F.min_by if name == "min" else F.max_by
        return Val(f(F.when(n.isNotNull(), v.col), n), v.type)
    n = _numbers(v)
    whole = v.integral
    if name == "sum":
        return Val(F.try_sum(n.cast("long")), LONG) if whole else Val(F.sum(n), DOUBLE)
    if name == "product":
        return Val(F.coalesce(F.product(n), F.lit(1.0)), DOUBLE)
    if name in ("min", "max"):
        return Val((F.min if name == "min" else F.max)(n), v.type if v.numeric and not isinstance(v.type, T.DecimalType) else DOUBLE)
    f = {"mean": F.avg, "median": F.median, "stddev": F.stddev_pop, "variance": F.var_pop}[name]
    return Val(f(n), DOUBLE)


def reduce_list(name: str, v: Val, args: list) -> Val:
    """The same over the items of a list topic."""
    kind, items = v.type.elementType, v.col
    if name == "count":
        return Val(F.coalesce(F.size(items), F.lit(0)).cast("long"), LONG)
    if name in ("first", "last"):
        return Val(F.try_element_at(items, F.lit(1 if name == "first" else -1)), kind)
    if name == "join":
        return Val(F.array_join(F.transform(items, lambda x: F.coalesce(display(Val(x, kind)), F.lit(""))), args[0].value if args else ""), STRING)
    if name == "unique":
        return Val(F.array_distinct(items), v.type)
    numbers = F.filter(F.transform(items, lambda x: _numbers(Val(x, kind)).cast("double")), lambda x: x.isNotNull())
    n = F.size(numbers)
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    if name == "sum":
        out = F.when(n > 0, total)
        return Val(out.cast("long"), LONG) if isinstance(kind, T.IntegralType) else Val(out, DOUBLE)
    if name == "product":
        return Val(F.aggregate(numbers, F.lit(1.0), lambda a, x: a * x), DOUBLE)
    if name in ("min", "max"):
        out = F.array_min(numbers) if name == "min" else F.array_max(numbers)
        return Val(out.cast(kind) if isinstance(kind, T.IntegralType) else out, kind if isinstance(kind, T.IntegralType) else DOUBLE)
    mean = F.when(n > 0, total / n)
    if name == "mean":
        return Val(mean, DOUBLE)
    if name == "median":
        ordered = F.array_sort(numbers)
        low, high = F.try_element_at(ordered, ((n + 1) / 2).cast("int")), F.try_element_at(ordered, (n / 2 + 1).cast("int"))
        return Val(F.when(n > 0, (low + high) / 2), DOUBLE)
    variance = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return Val(F.when(n > 0, F.sqrt(variance) if name == "stddev" else variance), DOUBLE)


__all__ = ["REDUCERS", "instant", "reduce_list", "reduce_rows"]
