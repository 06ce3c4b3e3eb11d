"""Sharding by a two-pass external shuffle.

Pass one scatters whole records by a seeded hash into buckets that fit a task's memory; pass two shuffles each bucket
by Fisher-Yates (Spark's seeded shuffle()) and numbers its records from the bucket's place in the global order. The
shards are equal cuts of that order, so their row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import cut, text_or_empty, whole_row, write

SHARDS = 24
BUCKET_BYTES = 16 << 20
#: A bucket is scattered anew if it has so many times bucket_bytes more than the mean.
LARGE = 2


def record_size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")


def two_pass_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: row (struct of all its columns), size, law ('rows'), shard, slot, grown_shard (null).

    Buckets: as many as give each about bucket_bytes, and one per shard at least. A record's bucket hangs on its id
    and text, so null ids and copies spread like others. Records that repeat both share a bucket; if they make one too
    large, its records are scattered anew by their places in the input. A null text counts 0 bytes. An empty table gives an empty
    result. The order depends on the seed, the rows and the number of partitions, not on where they are stored (but for
    records scattered anew).
    """
    total = docs.select(record_size().alias("size")).agg(F.count("*"), F.sum("size")).first()
    rows, buckets = total[0], max(shards, -(-(total[1] or 0) // bucket_bytes))
    mixed = F.xxhash64(F.lit(seed), "doc_id", text_or_empty())
    base = docs.select(whole_row(docs).alias("row"), record_size().alias("size"), mixed.alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    # One row per bucket: as many as the input has bucket_bytes.
    held = cut(base.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "buckets")
    over = held.filter(F.col("bytes") > F.lit(LARGE * max(bucket_bytes, 1) + (total[1] or 0) // buckets)).select("bucket", F.lit(True).alias("over"))
    if not over.isEmpty():
        # Written once, so that a record keeps its bucket whatever is computed again.
        anew = F.pmod(F.xxhash64(F.lit(seed), "h", F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
        base = cut(base.join(over, "bucket", "left").withColumn("bucket", F.when(F.col("over"), anew).otherwise(F.col("bucket"))).drop("over"), "scattered")
        held = base.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = held.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    by_hash = lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)
    full = (
        base.repartition(buckets, "bucket")
        .groupBy("bucket").agg(F.collect_list(F.struct("h", "size", "row")).alias("records"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle(F.array_sort("records", by_hash), seed).alias("records"))
    )
    at = full.join(starts, "bucket").select("start", F.posexplode("records").alias("place", "r"))
    at = at.select("r.row", "r.size", (F.col("start") + F.col("place")).alias("at"))
    shard = F.expr(f"(at * {shards}L) div {max(rows, 1)}L")
    first = F.expr(f"(((at * {shards}L) div {max(rows, 1)}L) * {rows}L + {shards - 1}L) div {shards}L")
    return at.select(
        "row", "size", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("at") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write each shard's records as path/shard=N, in slot order within a file.

    Each bucket is written by the task that shuffled it, since it is a range of the order: no record is moved again.
    """
    out = two_pass_shuffle(docs, shards, seed, bucket_bytes).sortWithinPartitions("shard", "slot")
    write(out, path, "shard")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """What write_shards wrote: row, size, law, shard, slot, grown_shard. Without records there is no shard to read: an empty frame without the row's fields."""
    try:
        return spark.read.parquet(path).withColumn("shard", F.col("shard").cast("int"))
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], "row struct<doc_id:bigint,text:string>, size bigint, law string, slot bigint, grown_shard int, shard int")
