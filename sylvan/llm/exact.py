"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries family sketch (Spark's ``approx_top_k``) proposes at most ``HEAVY`` frequent digests.  Their
counts and winners are then computed exactly and broadcast (at most ``HEAVY`` rows, whatever the input), so
the rows of the largest groups never meet in a shuffle.  All other digests are grouped by an ordinary shuffle
of digests; the sketch bounds how large those groups can be (a few times rows / ``TRACKED``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, free_names, prepare, text_of

#: Most digests that are broadcast, and counters that the sketch keeps.
HEAVY, TRACKED = 1000, 10_000


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null is empty."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _rank(doc_id: str, row: str | None = None) -> Column:
    """Order within a group: smaller id first, null ids last."""
    return F.struct(*[c for c in (F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(row).alias("row") if row else None) if c is not None])


def heavy_winners(digests: DataFrame, rank: Column) -> DataFrame:
    """``digest, first, size`` of at most HEAVY frequent digests, exact: the sketch only chooses which."""
    proposed = digests.agg(F.expr(f"approx_top_k(digest, {HEAVY}, {TRACKED})").alias("top"))
    proposed = proposed.select(F.explode("top").alias("top")).where("top.count > 1").select(F.col("top.item").alias("digest"))
    found = digests.join(F.broadcast(proposed), "digest", "left_semi")
    return found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts are empty texts.  Of rows with equal text the smallest id stays; of repeated rows one does;
    a null id comes after all others.  Texts of any length are read whole.  An empty table gives an empty
    table; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), digest(F.col(text)).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows)
    winners = cut(heavy_winners(rows, _rank("id", "row")))
    split = rows.join(F.broadcast(winners), "digest", "left")
    group = Window.partitionBy("digest")
    rest = split.where("size IS NULL").withColumns({"first": F.min(_rank("id", "row")).over(group), "size": F.count(F.lit(1)).over(group)})
    return (
        split.where("size IS NOT NULL")
        .unionByName(rest)
        .select(F.col("id").alias(doc_id), F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("first.row") == F.col("row")).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, whole, with all columns, whatever their names.

    The rule is that of ``duplicate_groups``; of rows that share the least id one stays.  Heavy groups lose
    their copies before anything is shuffled.
    """
    prepare(docs.sparkSession)
    key, place, winner = free_names(docs.columns, "digest", "place", "winner")
    rows = docs.withColumn(key, digest(F.col(text)))
    winners = cut(heavy_winners(rows.select(F.col(doc_id).alias("id"), F.col(key).alias("digest")), _rank("id")))
    winners = winners.select(F.col("digest").alias(key), F.struct("first.*").alias(winner))
    left = rows.join(F.broadcast(winners), key, "left").where(F.col(winner).isNull() | F.col(winner)["id"].eqNullSafe(F.col(doc_id)))
    order = Window.partitionBy(key).orderBy(F.col(doc_id).asc_nulls_last())
    return left.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
