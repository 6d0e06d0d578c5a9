"""Readings: how a value counts as a number, a point in time or a truth, as Columns.

Every function takes a typed Column (``Val``), so a column of numbers costs no text handling at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: The same with all of the text as its match.
_NUMBER_TEXT = _NUMBER + "(?s:.*)"
_INSTANT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?$"


@dataclass(frozen=True)
class Val:
    """A Column with its type; ``literal`` marks a constant, ``unit`` a quantity's base unit, ``costly`` a text to refer to once."""

    col: Column
    type: T.DataType
    literal: bool = False
    value: object = None
    costly: bool = False

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def integral(self) -> bool:
        return isinstance(self.type, T.IntegralType)

    @property
    def text(self) -> bool:
        return isinstance(self.type, T.StringType)

    @property
    def instant(self) -> bool:
        return isinstance(self.type, (T.TimestampType, T.TimestampNTZType, T.DateType))

    @property
    def duration(self) -> bool:
        return isinstance(self.type, T.DayTimeIntervalType)

    @property
    def boolean(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def null(self) -> bool:
        return isinstance(self.type, T.NullType)

    @property
    def array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def struct(self) -> bool:
        return isinstance(self.type, T.StructType)


def literal(value) -> Val:
    kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}[type(value)]
    return Val(F.lit(value).cast(kind) if value is not None else F.lit(None), kind, True, value)


def number(v: Val) -> Column | None:
    """The numeric reading, or None where the type has none."""
    if v.numeric:
        return v.col if not isinstance(v.type, T.DecimalType) else v.col.cast("double")
    if v.text:
        if v.literal:
            try:
                return F.lit(float(v.value.strip())) if v.value.strip().lower() not in ("nan", "inf", "-inf", "infinity") else None
            except ValueError:
                return None
        trimmed = F.trim(v.col)
        if v.costly:
            return F.get(F.regexp_extract_all(trimmed, F.lit(_NUMBER_TEXT), F.lit(0)), F.lit(0)).try_cast("double")
        return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))
    return None


def instant(v: Val) -> Column | None:
    """The temporal reading: a timestamp; numbers are epoch seconds, text is ISO 8601."""
    if isinstance(v.type, T.TimestampType):
        return v.col
    if v.instant:
        return v.col.cast("timestamp")
    if v.numeric:
        return F.timestamp_micros((v.col * 1_000_000).cast("long"))
    if v.text:
        return F.when(v.col.rlike(_INSTANT), F.try_to_timestamp(v.col))
    return None


def seconds(v: Val) -> Column:
    """A duration's seconds."""
    whole = F.extract(F.lit("DAY"), v.col) * 86400 + F.extract(F.lit("HOUR"), v.col) * 3600 + F.extract(F.lit("MINUTE"), v.col) * 60
    return whole + F.extract(F.lit("SECOND"), v.col).cast("double")


def text(v: Val) -> Column:
    """Display text; null is empty."""
    return F.coalesce(display(v), F.lit(""))


def display(v: Val) -> Column:
    if v.text:
        return v.col
    if isinstance(v.type, (T.DoubleType, T.FloatType)):
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.when(whole, v.col.cast("decimal(20,0)").cast("string")).otherwise(v.col.cast("string"))
    if isinstance(v.type, (T.TimestampType, T.TimestampNTZType)):
        return iso(v.col)
    if v.array:
        return F.array_join(F.transform(v.col, lambda x: F.coalesce(display(Val(x, v.type.elementType)), F.lit(""))), ", ")
    if v.struct:
        return F.to_json(v.col, {"ignoreNullFields": "false"})
    return v.col.cast("string")


def iso(c: Column) -> Column:
    """UTC ISO text: a midnight prints as a date, fractions without trailing zeros."""
    date = F.date_format(c, "yyyy-MM-dd")
    fraction = F.regexp_replace(F.date_format(c, "SSSSSS"), "0+$", "")
    clock = F.date_format(c, "HH:mm:ss")
    return F.when((clock == "00:00:00") & (fraction == ""), date).otherwise(F.concat(date, F.lit("T"), clock, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit(""))))


def truth(v: Val) -> Column:
    """Truthiness; null, false, zero and empty are false."""
    if v.boolean:
        return F.coalesce(v.col, F.lit(False))
    if v.numeric:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.text:
        return F.coalesce(v.col != "", F.lit(False))
    if v.array:
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    if v.duration:
        return F.coalesce(seconds(v) != 0, F.lit(False))
    if v.null:
        return F.lit(False)
    return v.col.isNotNull()


def equal(a: Val, b: Val) -> Column:
    """Two-valued equality: null equals null only; numbers, instants and spans compare by their reading."""
    if a.array or b.array:  # existential over lists
        if a.array and b.array:
            return F.coalesce(F.exists(a.col, lambda x: F.exists(b.col, lambda y: equal(Val(x, a.type.elementType), Val(y, b.type.elementType)))), F.lit(False))
        many, one = (a, b) if a.array else (b, a)
        return F.coalesce(F.exists(many.col, lambda x: equal(Val(x, many.type.elementType), one)), F.lit(False))
    if a.null or b.null:
        return (b.col if a.null else a.col).isNull() if not (a.null and b.null) else F.lit(True)
    if a.instant or b.instant:
        x, y = instant(a), instant(b)
    elif a.duration or b.duration:
        x, y = (seconds(v) if v.duration else number(v) for v in (a, b))
    elif a.numeric and b.numeric:
        return a.col.eqNullSafe(b.col)
    elif a.numeric or b.numeric:
        x, y = number(a), number(b)
        if x is None or y is None:
            return a.col.isNull() & b.col.isNull()
        return F.coalesce(x == y, a.col.isNull() & b.col.isNull())
    elif a.text and b.text:
        plain = a.col.eqNullSafe(b.col)
        if any(v.literal and number(v) is None for v in (a, b)):
            return plain
        x, y = number(a), number(b)
        return plain | F.coalesce(x == y, F.lit(False))
    elif type(a.type) is type(b.type):
        return a.col.eqNullSafe(b.col)
    else:
        return a.col.isNull() & b.col.isNull()
    if x is None or y is None:
        return a.col.isNull() & b.col.isNull()
    return F.coalesce(x == y, a.col.isNull() & b.col.isNull())


def less(op: str, a: Val, b: Val) -> Column:
    """Two-valued order: an undefined pair is false."""
    compare = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if a.array or b.array:
        many, one, side = (a, b, 0) if a.array else (b, a, 1)
        return F.coalesce(F.exists(many.col, lambda x: less(op, *((Val(x, many.type.elementType), one) if not side else (one, Val(x, many.type.elementType))))), F.lit(False))
    if a.boolean or b.boolean or a.null or b.null:
        return F.lit(False)
    if a.instant or b.instant:
        x, y = instant(a), instant(b)
    elif a.duration or b.duration:
        x, y = (seconds(v) if v.duration else number(v) for v in (a, b))
    elif a.text and b.text:
        x, y = number(a), number(b)
        if x is None or y is None:
            return F.coalesce(compare(a.col, b.col), F.lit(False))
        both = x.isNotNull() & y.isNotNull()
        return F.coalesce(F.when(both, compare(x, y)).otherwise(compare(a.col, b.col)), F.lit(False))
    else:
        x, y = number(a), number(b)
    return F.lit(False) if x is None or y is None else F.coalesce(compare(x, y), F.lit(False))


def pushable(op: str, a: Val, b: Val) -> Column | None:
    """The comparison as a filter that sources can evaluate (null is dropped, as false is), or None."""
    compare = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    decimal = isinstance(a.type, T.DecimalType) or isinstance(b.type, T.DecimalType)
    if a.numeric and b.numeric and not decimal:
        return compare(a.col, b.col)
    if a.instant and b.instant and (a.literal or b.literal):  # the constant takes the column's type
        kind = (b if a.literal else a).type
        return compare(*(v.col.cast(kind) if v.literal else v.col for v in (a, b)))
    return None


def rank_key(v: Val) -> list[Column]:
    """Columns that sort in the total order: null, then numbers and instants, then plain text."""
    if v.text:
        n = number(v)
        return [F.when(v.col.isNull(), 0).when(n.isNotNull(), 2).otherwise(3), n, v.col]
    return [v.col]


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """Integers stay exact (null where they overflow), all else is double; an operand without reading gives null."""
    if a.instant or b.instant or a.duration or b.duration:
        return _temporal(op, a, b)
    x, y = number(a), number(b)
    if x is None or y is None:
        return Val(F.lit(None).cast("double"), T.DoubleType())
    whole = a.integral and b.integral
    if op == "div":
        return Val(F.try_divide(x.cast("double"), y.cast("double")), T.DoubleType())
    if op == "idiv":
        if whole:
            x, y = x.cast("long"), y.cast("long")
            return Val(F.when(y != 0, F.call_function("div", x, y)), T.LongType())
        q = F.try_divide(x.cast("double"), y.cast("double"))
        return Val(F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long"), T.LongType())
    if op == "mod":
        kind = T.LongType() if whole else T.DoubleType()
        return Val(F.try_mod(x.cast(kind), y.cast(kind)), kind)
    kind = T.LongType() if whole else T.DoubleType()
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    return Val(f(x.cast(kind), y.cast(kind)), kind)


def _temporal(op: str, a: Val, b: Val) -> Val:
    none = Val(F.lit(None).cast("double"), T.DoubleType())
    if op == "-" and a.text and b.instant or op == "-" and a.instant and b.text:
        a, b = (v if v.instant else Val(instant(v), T.TimestampType()) for v in (a, b))
    if a.instant and b.instant:
        return Val(instant(a) - instant(b), T.DayTimeIntervalType()) if op == "-" else none
    if a.instant and b.duration and op in "+-":
        return Val(instant(a) + b.col if op == "+" else instant(a) - b.col, T.TimestampType())
    if a.duration and b.instant and op == "+":
        return Val(instant(b) + a.col, T.TimestampType())
    if a.duration and b.duration and op in "+-":
        return Val(a.col + b.col if op == "+" else a.col - b.col, T.DayTimeIntervalType())
    if a.duration and b.numeric and op in ("*", "div"):
        return Val(a.col * b.col if op == "*" else F.when(b.col != 0, a.col / b.col), T.DayTimeIntervalType())
    if b.duration and a.numeric and op == "*":
        return Val(b.col * a.col, T.DayTimeIntervalType())
    return none
