"""The benchmark tables as sources: a catalog with its keys, and arbors made from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.files import forest
from .sources.model import Arbor, Tables, tables_of

# Document order (its columns), the naming key and the foreign keys of each table.
SPECS = {
    "region": (("r_regionkey",), "r_regionkey", {}),
    "nation": (("n_nationkey",), "n_nationkey", {"n_regionkey": ("region", "r_regionkey")}),
    "customer": (("c_custkey",), "c_custkey", {"c_nationkey": ("nation", "n_nationkey")}),
    "supplier": (("s_suppkey",), "s_suppkey", {"s_nationkey": ("nation", "n_nationkey")}),
    "part": (("p_partkey",), "p_partkey", {}),
    "orders": (("o_orderkey",), "o_orderkey", {"o_custkey": ("customer", "c_custkey")}),
    "lineitem": (("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"), None, {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
    "events": (("event_id",), "event_id", {}),
    "documents": (("doc_id",), "doc_id", {}),
    "embeddings": (("vec_id",), "vec_id", {}),
    "pages": (("page_id",), "page_id", {}),
    "benchmark": (("item_id",), "item_id", {}),
    "labels": (("doc_id",), "doc_id", {"doc_id": ("documents", "doc_id")}),
    "conversations": (("conv_id", "turn"), None, {}),
}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return tables_of(spark, sf_dir, SPECS)


_EMPTY = "map<string,string>"


def _node(id, parent, name, sib, depth, ancestors, trait, props, locator, value=None):
    none = F.create_map().cast(_EMPTY)
    return [id.cast("long").alias("id"), parent.cast("long").alias("parent"), name.alias("name"), sib.cast("int").alias("sib"), F.lit(depth).alias("depth"), ancestors.cast("array<long>").alias("ancestors"), F.array(F.lit(trait)).alias("traits"), (F.lit(None).cast("string") if value is None else value).alias("value"), (none if props is None else props).alias("props"), none.alias("meta"), locator.alias("locator")]


def _counted(nodes: DataFrame) -> DataFrame:
    """Adds the counts of children and descendants, by sums over ancestor lists."""
    below = nodes.select(F.explode("ancestors").alias("__a"), F.col("parent").alias("__p"))
    counts = below.groupBy("__a").agg(F.count(F.lit(1)).alias("n_descendants"), F.sum((F.col("__a") == F.col("__p")).cast("int")).cast("int").alias("n_children"))
    joined = nodes.join(counts, F.col("id") == F.col("__a"), "left").withColumns({"n_descendants": F.coalesce("n_descendants", F.lit(0)).cast("long"), "n_children": F.coalesce("n_children", F.lit(0)).cast("int")}).drop("__a")
    sibs = counts.select(F.col("__a").alias("__b"), F.col("n_children").alias("n_sib"))
    return joined.join(sibs, F.col("parent") == F.col("__b"), "left").withColumn("n_sib", F.coalesce("n_sib", F.lit(1)).cast("int")).drop("__b")


def geography(spark: SparkSession, sf_dir: str) -> Arbor:
    """world / region / nation / customer as one tree; ids grow in document order; orders of customers aren't nodes.

    Links: a nation ``supplies`` from its suppliers' nation to the next nation of its region.
    """
    from pyspark.sql import Window

    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    r, n, c = read("region"), read("nation"), read("customer")
    top = spark.range(1).select(*_node(F.lit(0), F.lit(None), F.lit(None).cast("string"), F.lit(1), 0, F.array(), "world", None, F.lit("/")))
    rid = (F.col("r_regionkey") + 1).cast("long") * F.lit(2**48)
    region = r.withColumn("sib", F.row_number().over(Window.orderBy("r_regionkey"))).select(*_node(rid, F.lit(0), F.col("r_name"), F.col("sib"), 1, F.array(F.lit(0)), "region", F.create_map(F.lit("key"), F.col("r_regionkey").cast("string")), F.concat(F.lit("/"), F.col("r_name"))))
    nid = rid + (F.col("n_nationkey") + 1).cast("long") * F.lit(2**32)
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    nation_path = F.concat(F.lit("/"), F.col("r_name"), F.lit("/"), F.col("n_name"))
    nation = nr.withColumn("sib", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))).select(*_node(nid, rid, F.col("n_name"), F.col("sib"), 2, F.array(F.lit(0).cast("long"), rid), "nation", F.create_map(F.lit("key"), F.col("n_nationkey").cast("string")), nation_path))
    cn = c.join(nr, c.c_nationkey == n.n_nationkey)
    cid = nid + F.col("c_custkey") + 1
    customer = cn.withColumn("sib", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).select(*_node(cid, nid, F.col("c_name"), F.col("sib"), 3, F.array(F.lit(0).cast("long"), rid, nid), "customer", F.create_map(F.lit("key"), F.col("c_custkey").cast("string"), F.lit("balance"), F.col("c_acctbal").cast("string"), F.lit("segment"), F.col("c_mktsegment")), F.concat(nation_path, F.lit("/"), F.col("c_name")), F.col("c_acctbal").cast("string")))
    nodes = top.unionByName(region).unionByName(nation).unionByName(customer)
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    edges = nr.withColumn("src", nid).withColumn("dst", F.lead(nid).over(w)).where("dst IS NOT NULL").select("src", F.lit("next").alias("label"), "dst", F.create_map(F.lit("region"), F.col("r_name")).alias("props"))
    return Arbor(_counted(nodes), edges)


def replies(spark: SparkSession, sf_dir: str) -> Arbor:
    """Conversations as children of a root, their turns as children, and ``reply`` links from a turn to the next."""
    from pyspark.sql import Window

    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    top = spark.range(1).select(*_node(F.lit(0), F.lit(None), F.lit(None).cast("string"), F.lit(1), 0, F.array(), "forum", None, F.lit("/")))
    cid = (F.col("conv_id") + 1) * F.lit(2**20)
    tid = cid + F.col("turn") + 1
    conv = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(*_node(cid, F.lit(0), F.col("conv_id").cast("string"), F.col("conv_id") + 1, 1, F.array(F.lit(0)), "conversation", None, F.concat(F.lit("/"), F.col("conv_id").cast("string"))))
    w = Window.partitionBy("conv_id").orderBy("turn")
    turn = t.withColumn("sib", F.row_number().over(w)).select(*_node(tid, cid, F.col("turn").cast("string"), F.col("sib"), 2, F.array(F.lit(0).cast("long"), cid), "turn", F.create_map(F.lit("role"), F.col("role"), F.lit("conv"), F.col("conv_id").cast("string")), F.concat(F.lit("/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")), F.col("text")))
    edges = t.withColumn("src", tid).withColumn("dst", F.lead(tid).over(w)).where("dst IS NOT NULL").select("src", F.lit("reply").alias("label"), "dst", F.create_map(F.lit("by"), F.col("role")).alias("props"))
    return Arbor(_counted(top.unionByName(conv).unionByName(turn)), edges)


def html_pages(spark: SparkSession, sf_dir: str) -> Arbor:
    """The pages' HTML, shredded where it lies."""
    return forest(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", "html")


def event_props(spark: SparkSession, sf_dir: str) -> Arbor:
    """The events' JSON properties as an arbor."""
    return forest(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "props", "json")
