"""Mix sources to target weights by nested hash thresholds; DataFrame functions only.

A document's place is a hash of its id and text.  Words are summed by source
and hash bucket, the running sums tell in which bucket a source's budget ends,
and only that bucket is split further.  The final filter compares each hash
with its source's threshold, so documents are never sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordering import global_position
from tidemark.llm.common import column, free_name, stored, text_column

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
# The hash has 52 bits, read 13 at a time.
LEVELS, BITS = 4, 13


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets for rows (source, source_size): weights cycle by the sources' order, null last.

    ``share`` times all words are dealt by weight; what exceeds ``most`` times a
    source's size is dealt again among the others until none exceeds it.
    """
    ordered = global_position(
        sizes.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"]).drop("_null")
    ranked = stored(
        ordered.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_pos") % len(weights) + 1).cast("int")))
        .drop("_pos"))
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        # Sources whose share at the present level is beyond their limit are held at the limit.
        full = F.lit(False) if level is None else F.col("_w") * F.lit(level) > most * F.col("source_size")
        got = ranked.agg(
            F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("size"),
            F.sum(F.when(full, 0).otherwise(F.col("_w"))).alias("weight"),
            F.sum(full.cast("int")).alias("n")).first()
        if not got["weight"] or got["n"] == capped:
            break
        capped = got["n"]
        level = (share * whole - most * got["size"]) / got["weight"]
    cap = most * F.col("source_size")
    due = cap if level is None else F.least(F.col("_w") * F.lit(float(level)), cap)
    return ranked.withColumn("target", due.cast("double")).drop("_w")


def thresholds(rows: DataFrame, due: DataFrame) -> DataFrame:
    """For rows (source, size, place): the smallest place that is left out, by source.

    ``due`` has (source, rest), the words wanted.  The document in which the
    budget ends is taken if that comes nearer to it.
    """
    bounds = due.select("source", "rest", F.lit(0).cast("long").alias("low"))
    for level in range(LEVELS):
        width = 2 ** (BITS * (LEVELS - 1 - level))
        open_rows = rows if level == 0 else rows.join(
            bounds.withColumnRenamed("source", "_s"),
            F.col("source").eqNullSafe(F.col("_s"))
            & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + width * 2**BITS)).drop("_s", "rest", "low")
        bucket = F.floor(F.col("place") / width).cast("long") * width
        sums = open_rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        # At most 2^13 buckets a source meet here, however many documents it has.
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        ends = (
            sums.withColumn("_after", running)
            .join(bounds.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .filter(F.col("_after") > F.col("rest"))
            .groupBy("source")
            .agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("_after") + F.col("size")).alias("rest"), "size"), "bucket").alias("_at"))
            .select("source", F.col("_at.rest").alias("rest"), F.col("_at.bucket").alias("low"), F.col("_at.size").alias("_size"))
        )
        bounds = stored(ends.drop("_size") if level < LEVELS - 1 else ends)
    # A bucket of one hash value is left: take it if that misses the budget by less.
    return bounds.select("source", (F.col("low") + (2 * F.col("rest") >= F.col("_size")).cast("long")).alias("until"))


def budgets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source from rows (source, size, place): whole copies, and the place up to which one more is taken."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = stored(
        targets(sizes, weights, share, most)
        .withColumn("whole", F.when(
            F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    until = thresholds(rows, wanted.select("source", "rest")).withColumnRenamed("source", "_s")
    return stored(
        wanted.join(until, F.col("source").eqNullSafe(F.col("_s")), "left")
        .select("source", "source_size", "target", "whole", F.coalesce("until", F.lit(-1)).alias("until")))


def measured(docs: DataFrame, text: str, source: str, key: str) -> DataFrame:
    """Rows (key, source, size, place), stored; every later pass reads only these."""
    return stored(docs.select(
        column(docs, key).alias("key"), column(docs, source).cast("string").alias("source"),
        F.regexp_count(text_column(docs, text), F.lit(WORD)).cast("long").alias("size"),
        place(docs, text, key).alias("place")))


def plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """One row per document: key, size, source_size, target, copies and taken words.

    A null text has size 0, a null source is a source of its own.  Repeated rows
    (same id and text) get the same hash and so are taken or left together.  A
    source of size 0 has target 0.  Reruns agree, as hashes depend on rows alone.
    """
    rows = measured(docs, text, source, key)
    by_source = budgets(rows, **options).withColumnRenamed("source", "_s")
    copies = F.col("whole") + (F.col("place") < F.col("until")).cast("long")
    return rows.join(by_source, F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("key").alias(key), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def place(docs: DataFrame, text: str = "text", key: str = "doc_id"):
    """A number below 2^52 from a document's id and text."""
    name = F.concat(F.coalesce(column(docs, key).cast("string"), F.lit("")), F.lit(":"), text_column(docs, text))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Only the table of sources meets the documents, so texts need no shuffle
    while that table is below Spark's broadcast threshold.
    """
    by_source = budgets(measured(docs, text, source, key), **options)
    s, w, u = (free_name(docs, x) for x in ("_source", "_whole", "_until"))
    by_source = by_source.select(F.col("source").alias(s), F.col("whole").alias(w), F.col("until").alias(u))
    copies = F.col(w) + (place(docs, text, key) < F.col(u)).cast("long")
    return (
        docs.join(by_source, column(docs, source).cast("string").eqNullSafe(F.col(s)))
        .withColumn(w, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
        .select(*[column(docs, x) for x in docs.columns]))
