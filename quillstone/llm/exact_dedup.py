"""Exact deduplication with combining that no large group of copies can slow down.

Texts are told apart by their whole content at each of the three stages: copies within a task (the partial aggregate),
copies under the same digest and salt, and the winners of the salts. Digests that hold much of the table, of which there can
only be a few, get salts; all other digests have one salt, so their texts move once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, drop, text_or_empty, whole_row

SALTS = 256
#: A digest with more than one in HOT of all rows gets salts; there are fewer than HOT of them.
HOT = 64


def exact_dedup(docs: DataFrame, salts: int = SALTS, hot: int = HOT) -> DataFrame:
    """One row per input row: row (struct of all its columns), keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as empty. The row with the largest doc_id stays (a null id
    is below all others). Of rows that repeat the same id and text exactly one is kept. An empty table gives an
    empty result; columns of any name travel in the struct.
    """
    # Rows are numbered in what is written, so that numbers stand; copies of one id spread over the salts by them.
    rows = cut(docs.select(whole_row(docs).alias("row"), F.sha2(text_or_empty(), 256).alias("digest"), F.monotonically_increasing_id().alias("at")), "rows")
    total = rows.count()
    # Fewer than `hot` digests can each have more than one in `hot` of the rows, so what is broadcast is bounded.
    large = cut(rows.groupBy("digest").agg(F.count("*").alias("times")).filter(F.col("times") * hot > total).select("digest"), "large")
    known = rows.join(F.broadcast(large.withColumn("large", F.lit(True))), "digest", "left")
    salt = F.when(F.col("large"), F.pmod(F.xxhash64("at"), F.lit(salts))).otherwise(0).cast("int")
    t, best = F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.struct(F.col("row.doc_id").alias("id"), (-F.col("at")).alias("up"))
    base = known.select("digest", salt.alias("salt"), t.alias("t"), best.alias("best"))
    # Within tasks and salts: the partial aggregate merges a task's own copies before anything is moved.
    salted = base.groupBy("digest", "salt", "t").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    salted = salted.join(F.broadcast(large.withColumn("large", F.lit(True))), "digest", "left").filter("large or n > 1")
    salted = cut(salted.withColumn("h", F.xxhash64("t")).withColumn("t", F.when(F.col("large"), F.col("t"))), "salted")
    # Across salts: of each text under a large digest, at most `salts` rows meet here. The others have met already.
    merged = salted.filter("large").groupBy("digest", "t").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    merged = merged.filter("n > 1").select("digest", F.xxhash64("t").alias("h"), "best", "n")
    few = cut(merged, "merged")
    groups = cut(salted.filter("large is null").select("digest", "h", "best", "n"), "groups")
    drop(salted, large)

    h = F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    found = rows.withColumn("h", h).join(F.broadcast(few.select("digest", "h", F.col("best").alias("lbest"), F.col("n").alias("ln"))), ["digest", "h"], "left")
    # Rows of large groups are done and get keys of their own, so that they spread over the tasks of the next join.
    found = found.withColumn("key", F.when(F.col("ln").isNull(), F.col("digest")).otherwise(F.col("at").cast("string")))
    found = found.join(groups.select(F.col("digest").alias("key"), "h", "best", "n").hint("merge"), ["key", "h"], "left")
    best, n = F.coalesce("lbest", "best"), F.coalesce("ln", "n")
    return found.select(
        "row", F.when(n.isNull(), F.col("row.doc_id")).otherwise(best["id"]).alias("keep_id"), F.coalesce(n, F.lit(1)).alias("group_size"),
        (n.isNull() | (best["up"] == -F.col("at"))).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their own columns."""
    return exact_dedup(docs).filter("kept").select("row.*")
