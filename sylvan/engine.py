"""The public interface: an engine runs query texts on a source and gives DataFrames."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from .functions.scalars import register_function
from .lang import reflect
from .lang.fragments import Definitions, split_definitions
from .lang.parser import parse
from .lang.printer import show
from .plans.compiler import Compiler
from .sources import files
from .sources.model import Mount


class Engine:
    """Queries on one source: tables, an arbor or a mount."""

    def __init__(self, spark: SparkSession, source, now: str | None = None):
        self.spark, self.source = spark, source
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.now = now or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
        self.definitions = Definitions(self._texts)

    def define(self, text: str) -> None:
        """Adds fragments and macros for all later queries."""
        for d in split_definitions(text)[0]:
            self.definitions.add(d)

    def parse(self, text: str):
        found, rest = split_definitions(text)
        scope = Definitions(self._texts)
        scope.by_name = dict(self.definitions.by_name)
        for d in found:
            scope.add(d)
        return parse(rest, scope.expand)

    def expand(self, text: str) -> str:
        """The query's canonical text, without fragments."""
        return show(self.parse(text))

    def query(self, text: str, ordered: bool = True) -> DataFrame:
        """The result: ``value``, the fields of records, or ``locator`` of nodes; unordered results skip the sort."""
        compiler = Compiler(self.spark, self.source, self.now)
        return compiler.result(compiler.query(self.parse(text)), ordered)

    def reflect(self, text: str) -> Engine:
        """An engine on the query's own syntax tree."""
        return Engine(self.spark, files.arbor_of(self.spark, "json", reflect.as_json(self.parse(text))))

    def _texts(self, text: str) -> list[str]:
        from pyspark.sql import functions as F

        df = self.query(text)
        return [r[0] for r in df.select(F.col(df.columns[0]).cast("string")).collect() if r[0] is not None]

    def values(self, text: str) -> list:
        """The result's rows on the driver: scalars, or dicts of records."""
        df = self.query(text)
        one = df.columns in (["value"], ["locator"])
        return [r[0] if one else r.asDict(True) for r in df.collect()]


def mount(spark: SparkSession, **sources) -> Engine:
    """Several sources under one root."""
    return Engine(spark, Mount(sources))


def save(df: DataFrame, path: str, kind: str = "json") -> None:
    """Writes a result; an existing target is an error."""
    df.write.mode("errorifexists").format(kind).save(path)


__all__ = ["Engine", "mount", "register_function", "save"]
