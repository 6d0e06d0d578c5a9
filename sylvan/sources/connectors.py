"""Sources behind connections, and arbors from tables of nodes and edges.

Databases come as catalogs whose tables are read where they lie, so filters and columns reach them.
"""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import binary_files, delimited, forest, rows_of
from .model import Arbor, Table, Tables


def parquet_folder(spark: SparkSession, path: str, keys: dict[str, str], fks: dict[str, dict] | None = None) -> Tables:
    """Tables name -> key column; a table's order is its key."""
    fks = fks or {}
    return Tables({n: Table(n, spark.read.parquet(f"{path}/{n}.parquet"), (k,), k, fks.get(n, {})) for n, k in keys.items()})


def jdbc(spark: SparkSession, url: str, keys: dict[str, str], fks: dict[str, dict] | None = None, **options) -> Tables:
    """Tables of a database; pass partitionColumn, lowerBound, upperBound and numPartitions for parallel reads."""
    fks = fks or {}
    read = lambda t: spark.read.format("jdbc").option("url", url).option("dbtable", t).options(**options).load()
    return Tables({n: Table(n, read(n), (k,), k, fks.get(n, {})) for n, k in keys.items()})


def sqlite(spark: SparkSession, path: str) -> Tables:
    """All tables of a SQLite file with their keys and foreign keys, loaded through the driver: for small files."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    kinds = {"INTEGER": "long", "REAL": "double", "NUMERIC": "double", "BOOLEAN": "long"}
    out = {}
    for (name,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'").fetchall():
        info = con.execute(f"PRAGMA table_info({quote(name)})").fetchall()
        pks = [c[1] for c in info if c[5]]
        key = pks[0] if len(pks) == 1 else None
        fks = {f[3]: (f[2], f[4] or "id") for f in con.execute(f"PRAGMA foreign_key_list({quote(name)})").fetchall()}
        rows = con.execute(f"SELECT * FROM {quote(name)}" + (f" ORDER BY {quote(key)}" if key else "")).fetchall()
        kind = [kinds.get((c[2] or "TEXT").upper().split("(")[0], "string") for c in info]
        cast = {"long": int, "double": float, "string": str}
        data = [(*[None if v is None else cast[k](v) for v, k in zip(r, kind, strict=True)], i) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, ", ".join(f"`{c[1]}` {k}" for c, k in zip(info, kind, strict=True)) + ", _row long")
        out[name] = Table(name, df, (key,) if key else ("_row",), key, fks)
    con.close()
    return Tables(out)


def kafka_snapshot(spark: SparkSession, servers: str, topic: str, since: str | None = None, until: str | None = None) -> Tables:
    """A bounded snapshot of a topic, never a tail: rows in the order of partition and offset."""
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if since:
        reader = reader.option("startingTimestamp", since)
    if until:
        reader = reader.option("endingTimestamp", until)
    df = reader.load().selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value", "timestamp", "partition", "offset")
    return Tables({topic: Table(topic, df, ("partition", "offset"), None)})


def latest(table: Table, key: str, by: str) -> Table:
    """The table's latest row of each key: what a stream refers to."""
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in table.df.columns]), by).alias("r")
    return Table(table.name, table.df.groupBy(F.col(key).alias("__k")).agg(row).select("r.*"), (key,), key, table.fks)


def graph(nodes: dict[str, tuple[DataFrame, str]], edges: dict[str, tuple[DataFrame, str, str, str, str]]) -> Arbor:
    """A property graph: label -> (rows, key) become the root's grandchildren below their label; label -> (rows, source
    column, source label, target column, target label) become links.  Keys are whole numbers below 2^40."""
    none = F.create_map().cast("map<string,string>")
    labels = sorted(nodes)
    spark = nodes[labels[0]][0].sparkSession
    base = {label: (i + 1) << 41 for i, label in enumerate(labels)}
    counts = {label: df.count() for label, (df, _) in nodes.items()}
    top = [(0, None, None, 1, 1, 0, len(labels), sum(counts.values()) + len(labels), [], ["graph"], None, "/")]
    top += [(base[n], 0, n, i + 1, len(labels), 1, counts[n], counts[n], [0], ["label"], None, f"/{n}") for i, n in enumerate(labels)]
    head = spark.createDataFrame(top, "id long, parent long, name string, sib int, n_sib int, depth int, n_children int, n_descendants long, ancestors array<long>, traits array<string>, value string, locator string").withColumns({"props": none, "meta": none})
    columns = ["id", "parent", "name", "sib", "n_sib", "depth", "n_children", "n_descendants", "ancestors", "traits", "value", "props", "meta", "locator"]
    out = head.select(*columns)
    for label, (df, key) in nodes.items():
        props = F.map_filter(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda _, v: v.isNotNull())
        rows = df.withColumn("id_", F.lit(base[label]) + F.col(key) + 1).withColumn("sib", (F.col(key) + 1).cast("int"))
        out = out.unionByName(rows.select(F.col("id_").alias("id"), F.lit(base[label]).alias("parent"), F.col(key).cast("string").alias("name"), "sib", F.lit(counts[label]).cast("int").alias("n_sib"), F.lit(2).alias("depth"), F.lit(0).alias("n_children"), F.lit(0).cast("long").alias("n_descendants"), F.array(F.lit(0).cast("long"), F.lit(base[label]).cast("long")).alias("ancestors"), F.array(F.lit(label)).alias("traits"), F.lit(None).cast("string").alias("value"), props.alias("props"), none.alias("meta"), F.concat(F.lit(f"/{label}/"), F.col(key).cast("string")).alias("locator")))
    links = None
    for label, (df, source, source_label, target, target_label) in edges.items():
        rest = [c for c in df.columns if c not in (source, target)]
        props = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]) if rest else none
        part = df.select((F.lit(base[source_label]) + F.col(source) + 1).alias("src"), F.lit(label).alias("label"), (F.lit(base[target_label]) + F.col(target) + 1).alias("dst"), props.alias("props"))
        links = part if links is None else links.unionByName(part)
    return Arbor(out, links)


def triples(df: DataFrame) -> Arbor:
    """Subject, predicate, object rows: literal objects are properties, objects that are subjects are links.

    Several literals of one predicate are one property, in the order of their texts with line ends between, so
    that ``lines`` parts them again.  Subjects are numbered in the order of their names.
    """
    from ..operators.ordinals import with_ordinals

    ids = with_ordinals(df.select(F.col("subject").alias("name")).distinct(), [F.col("name")], "key").select("name", (F.col("key") - 1).alias("key"))
    literal = df.join(ids.select(F.col("name").alias("object")), "object", "left_anti").groupBy("subject", "predicate").agg(F.array_join(F.array_sort(F.collect_set("object")), "\n").alias("object"))
    literal = literal.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("predicate", "object"))).alias("all"))
    rows = ids.join(literal, F.col("name") == F.col("subject"), "left").select("key", F.col("name").alias("iri"), "all")
    arbor = graph({"subject": (rows.select("key", "iri"), "key")}, {})
    with_props = arbor.nodes.join(rows.select(F.col("iri").alias("__iri"), "all"), F.col("props")["iri"] == F.col("__iri"), "left")
    nodes = with_props.withColumn("props", F.map_concat("props", F.coalesce("all", F.create_map().cast("map<string,string>")))).withColumn("name", F.coalesce("__iri", "name")).drop("__iri", "all")
    at = nodes.select(F.col("name").alias("n"), F.col("id").alias("i"))
    links = df.join(at, F.col("subject") == F.col("n")).withColumnRenamed("i", "src").drop("n").join(at, F.col("object") == F.col("n")).select("src", F.col("predicate").alias("label"), F.col("i").alias("dst"), F.create_map().cast("map<string,string>").alias("props"))
    return Arbor(nodes, links)


def listing(spark: SparkSession, path: str) -> Tables:
    """Files below a path as rows: path, name, extension, size and time."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    df = df.withColumn("ext", F.when(F.col("name").contains("."), F.element_at(F.split("name", r"\."), -1)))
    return rows_of(df.withColumn("_row", F.col("path")), [c for c in df.columns])


def open_source(spark: SparkSession, target: str, kind: str | None = None):
    """A source by its name's ending: csv, tsv, parquet, sqlite, or a tree of documents."""
    ending = kind or os.path.splitext(target.rstrip("/"))[1].lstrip(".").lower()
    if ending in ("csv", "tsv"):
        return delimited(spark, target, "\t" if ending == "tsv" else ",")
    if ending == "parquet":
        df = spark.read.parquet(target)
        return rows_of(df.withColumn("_row", F.monotonically_increasing_id()), df.columns)
    if ending in ("db", "sqlite", "sqlite3"):
        return sqlite(spark, target)
    if ending == "files":
        return listing(spark, target)
    names = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "text", "log": "lines", "zip": "archive", "tar": "archive", "gz": "archive"}
    if ending not in names:
        raise ValueError(f"unknown kind of source: {target}")
    return binary_files(spark, target, names[ending])


__all__ = ["forest", "graph", "jdbc", "kafka_snapshot", "latest", "listing", "open_source", "parquet_folder", "sqlite", "triples"]
