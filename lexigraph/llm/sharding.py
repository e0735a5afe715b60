"""Shards of near equal bytes by sampled splitters, by DataFrame functions alone.

Records are ordered by a hash of their text, then doc_id, so copies lie side by side. Size-weighted samples give
splitters, overfull ranges are subdivided, and each range is sorted by itself. A record's place in the whole order is
its range's offset plus its place in the range; its shard is where the middle of its bytes falls among equal parts.
So a shard's bytes differ from the mean by one record at most.

Null texts count as empty: 16 bytes and the checksum of nothing. Repeated rows are records of their own, side by side.
An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_or_empty
from .splitters import range_of, splitters_of

SHARDS, OVERHEAD, ROWS_A_RANGE = 40, 16, 2_000_000


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    raw = F.encode(text_or_empty(), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key"))
    rows = durable(rows.withColumn("tie", F.coalesce("doc_id", F.lit(-(1 << 63)))), "sized")
    there = rows.count()
    found = splitters_of(rows, F.col("size"), max(4 * count, there // ROWS_A_RANGE))
    ranged = rows.withColumn("range", range_of(F.col("key"), F.col("tie"), found))
    order = Window.partitionBy("range").orderBy("key", "tie", "size", "text_crc32")
    placed = ranged.withColumns({"place": F.row_number().over(order) - 1, "before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    placed = durable(placed, "placed")
    # One row a range, MOST_RANGES of them and their subdivisions at most
    offsets, at, rank = [], 0, 0
    for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range").collect():
        offsets.append((r["range"], at, rank))
        at, rank = at + r["bytes"], rank + r["n"]
    bases = docs.sparkSession.createDataFrame(offsets, "range int, byte_base bigint, rank_base bigint")
    middle = F.col("byte_base") + F.col("before") + F.col("size") / 2
    whole = placed.join(F.broadcast(bases), "range").withColumns({"shard": F.least(F.floor(middle * count / max(at, 1)), F.lit(count - 1)).cast("int"), "rank": F.col("rank_base") + F.col("place")})
    # One row a shard
    firsts = whole.groupBy("shard").agg(F.min("rank").alias("first"))
    return whole.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
