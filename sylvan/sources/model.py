"""What a query runs on: tables with keys, arbors of nodes and edges, and mounts of several sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of an arbor's nodes.  ``ancestors`` runs from the root to the parent; ids grow in document order.
NODE_SCHEMA = "id long, parent long, name string, sib int, n_sib int, depth int, n_children int, n_descendants long, ancestors array<long>, traits array<string>, value string, props map<string,string>, meta map<string,string>, locator string"
EDGE_SCHEMA = "src long, label string, dst long, props map<string,string>"


@dataclass(frozen=True)
class Table:
    """A table's rows in the order of ``order``; ``key`` names a row; foreign keys are column -> (table, column).

    ``rows`` is a DataFrame, or a function that gives it when a query first needs the table.
    """

    name: str
    rows: DataFrame | Callable[[], DataFrame]
    order: tuple[str, ...]
    key: str | None = None
    fks: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    @cached_property
    def df(self) -> DataFrame:
        return self.rows() if callable(self.rows) else self.rows


@dataclass(frozen=True)
class Tables:
    """A catalog: the root's children are tables, or with ``rows`` the rows of the one table."""

    tables: dict[str, Table]
    rows: str = ""


@dataclass(frozen=True)
class Arbor:
    """A tree with labelled edges.  ``root`` is the id of its root; ``bound`` limits open patterns."""

    nodes: DataFrame
    edges: DataFrame | None = None
    root: int = 0
    bound: int = 32
    refs: str = ""  # the property that <-- and --> resolve against, beside names


@dataclass(frozen=True)
class Mount:
    """Sources under one root as named children."""

    sources: dict[str, object]


def with_filter(table: Table, condition) -> Table:
    return replace(table, rows=table.df.where(condition))


def tables_of(spark, folder: str, specs: dict[str, tuple[tuple[str, ...], str | None, dict]]) -> Tables:
    """Parquet tables of a folder: name -> (order, key, foreign keys).  A table is opened when a query needs it."""

    def opened(name: str):
        path = f"{folder}/{name}.parquet"
        if path not in _schemas:  # finding a schema takes a job
            _schemas[path] = spark.read.parquet(path).schema
        return spark.read.schema(_schemas[path]).parquet(path)

    return Tables({name: Table(name, partial(opened, name), order, key, fks) for name, (order, key, fks) in specs.items()})


_schemas: dict = {}


def derive_columns(nodes: DataFrame) -> DataFrame:
    """Node columns that follow from the others: siblings and child counts, by joins on ids."""
    children = nodes.groupBy(F.col("parent").alias("__p")).agg(F.count(F.lit(1)).cast("int").alias("__n"))
    return nodes.drop("n_children", "n_sib").join(children, F.col("id") == F.col("__p"), "left").withColumn("n_children", F.coalesce("__n", F.lit(0))).drop("__p", "__n").join(children, F.col("parent") == F.col("__p"), "left").withColumn("n_sib", F.coalesce("__n", F.lit(1))).drop("__p", "__n")
