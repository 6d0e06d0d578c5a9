"""Models: containers, references and relations derived from a source, as more nodes' links.

Relations with an equality go by key; one that is a condition on pairs joins the two sides' nodes on it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import Arbor

_NONE = "map<string,string>"


def _with(arbor: Arbor, links) -> Arbor:
    links = links.select("src", "label", "dst", F.create_map().cast(_NONE).alias("props"))
    return replace(arbor, edges=links if arbor.edges is None else arbor.edges.unionByName(links))


def reference(arbor: Arbor, label: str, prop: str, target: str, source: Column | None = None, where: Column | None = None) -> Arbor:
    """Links each node whose ``prop`` equals another's ``target`` property to that node."""
    here = arbor.nodes if source is None else arbor.nodes.where(source)
    there = arbor.nodes if where is None else arbor.nodes.where(where)
    a = here.select(F.col("id").alias("src"), F.col("props")[prop].alias("k")).where("k IS NOT NULL")
    b = there.select(F.col("id").alias("dst"), F.col("props")[target].alias("k2")).where("k2 IS NOT NULL")
    return _with(arbor, a.join(b, F.col("k") == F.col("k2")).select("src", F.lit(label).alias("label"), "dst"))


def shared(arbor: Arbor, label: str, prop: str, where: Column | None = None) -> Arbor:
    """Undirected links between the nodes of equal ``prop``, as a path through each group in document order.

    A group of n has n - 1 links, not all pairs; walking ``--label`` repeatedly reaches the whole group.
    """
    from pyspark.sql import Window

    rows = arbor.nodes if where is None else arbor.nodes.where(where)
    w = Window.partitionBy("k").orderBy("src")
    chain = rows.select(F.col("id").alias("src"), F.col("props")[prop].alias("k")).where("k IS NOT NULL").withColumn("dst", F.lead("src").over(w)).where("dst IS NOT NULL")
    return _with(arbor, chain.select("src", F.lit(label).alias("label"), "dst"))


def pairs(arbor: Arbor, label: str, rows: Column, a: str, b: str, key: str) -> Arbor:
    """Undirected links a -- b between the nodes that the rows' properties a and b name by ``key``; parallel ones are one."""
    names = arbor.nodes.select(F.col("id"), F.col("props")[key].alias("k")).where("k IS NOT NULL")
    found = arbor.nodes.where(rows).select(F.col("props")[a].alias("x"), F.col("props")[b].alias("y"))
    joined = found.join(names.select(F.col("id").alias("p"), F.col("k").alias("kx")), F.col("x") == F.col("kx")).join(names.select(F.col("id").alias("q"), F.col("k").alias("ky")), F.col("y") == F.col("ky"))
    links = joined.select(F.least("p", "q").alias("src"), F.lit(label).alias("label"), F.greatest("p", "q").alias("dst")).where("src <> dst").distinct()
    return _with(arbor, links)


def relation(arbor: Arbor, label: str, left: Column, right: Column, condition) -> Arbor:
    """Links between nodes of two sides on ``condition(left, right)``, Columns of their properties."""
    a = arbor.nodes.where(left).select(F.col("id").alias("src"), F.col("props").alias("pa"))
    b = arbor.nodes.where(right).select(F.col("id").alias("dst"), F.col("props").alias("pb"))
    return _with(arbor, a.join(b, condition(F.col("pa"), F.col("pb")) & (F.col("src") != F.col("dst"))).select("src", F.lit(label).alias("label"), "dst"))
