"""Operator 4 [native]: exact dedup by content sort.

Rows are range-partitioned by sampled splitters over the start of the normalised text and a hash of all of it, and
sorted on disk by these and by the whole text; equal texts are then neighbours, and each row is compared in full with
the one before it. The start keeps the splitters small however long texts are; texts behind a common start, such as a
licence or a page's head, are spread over ranges by the hash. A text that makes up a share of
1 / (4 x shuffle partitions) of all rows, found by a count of hashes beforehand, is salted into parts of about that
size, so it lies in many ranges. Each part has one winner after the comparison; the winners of salted parts, whose number the
share bounds, are sorted and compared in full once more.

Cases: a null text counts as empty, and empty texts are copies of each other; of rows with equal text and id the group
still has one keep_id, and each such row counts in group_size; a null doc_id loses to any other of the same length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, checkpoint, group_facts, salted, shuffle_parts

#: Characters of normalised text in the range key.
HEAD = 256


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def _hot(texts: DataFrame) -> DataFrame:
    """(hash, parts) of texts with too many rows for one range: at most 4 x shuffle partitions of them."""
    counts = texts.groupBy(F.xxhash64("norm").alias("hash")).agg(F.count("*").alias("rows"))
    counts = checkpoint(counts.where("rows > 1"))
    share = texts.agg(F.greatest(F.lit(2), F.ceil(F.count("*") / (4 * shuffle_parts(texts.sparkSession)))).alias("share"))
    return counts.crossJoin(F.broadcast(share)).where("rows > share").select("hash", F.ceil(F.col("rows") / F.col("share")).cast("int").alias("parts"))


def _neighbours(rows: DataFrame, keys: list[str], run: Column) -> DataFrame:
    """Adds first, whether a row's text differs from the one before it, and the name of the first row of its run of equals."""
    order = Window.partitionBy(*keys).orderBy("norm", F.desc("n"), F.asc_nulls_last("doc_id"))
    first = F.coalesce(F.col("norm") != F.lag("norm").over(order), F.lit(True))
    told = rows.withColumn("_name", run).withColumn("first", first)
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return told.withColumn("run", F.last(F.when(F.col("first"), F.col("_name")), ignorenulls=True).over(before))


def ranges(rows: DataFrame) -> DataFrame:
    """Rows (head, hash, part) in ranges of these."""
    return rows.repartitionByRange("head", "hash", "part")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row; the longest original text stays, then the smallest id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), F.char_length(text).alias("n"), normalized(F.col("text")).alias("norm"))
    hot = checkpoint(_hot(texts))
    parts = texts.withColumn("hash", F.xxhash64("norm")).join(F.broadcast(hot), "hash", "left")
    keyed = parts.select("doc_id", "n", "norm", "hash", F.substring("norm", 1, HEAD).alias("head"), F.coalesce(F.pmod(F.xxhash64("doc_id", "n"), "parts"), F.lit(-1)).alias("part"))
    sorted_ = _neighbours(ranges(keyed), ["head", "hash", "part"], F.monotonically_increasing_id())
    again = F.when(F.col("first") & (F.col("part") >= 0), F.col("norm"))
    slim = checkpoint(sorted_.select("doc_id", "n", F.sha2("norm", 256).alias("text_sha256"), "run", again.alias("norm")))
    winners = slim.where("norm is not null").select("run", "norm", "n", "doc_id").withColumns({"head": F.substring("norm", 1, HEAD), "hash": F.xxhash64("norm"), "part": F.lit(0)})
    merged = _neighbours(ranges(winners), ["head", "hash", "part"], F.col("run")).select(F.col("_name").alias("run"), F.col("run").alias("group"))
    rows = slim.drop("norm").join(F.broadcast(merged), "run", "left").withColumn("group", F.coalesce("group", "run"))
    rows = salted(rows, "doc_id")
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("less"), "doc_id"))
    facts = group_facts(rows, ["group"], [best.alias("best"), F.count("*").alias("size")], [F.max("best").alias("best"), F.sum("size").alias("group_size")])
    out = rows.join(facts, ["group", "_salt"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"), "text_sha256")


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
