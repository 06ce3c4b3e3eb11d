"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words.
SPACE = "\x20\x09-\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file, as installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or else the context's checkpoint folder. Only where both are unset and all runs in one machine (a local test session) is one of this machine set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillstone-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


#: Removes a write's shuffle files when it ends: what it wrote stands for them.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, *by: str) -> None:
    """Write df as Parquet, in folders by the columns `by`; of its shuffles nothing stays on disk."""
    spark = df.sparkSession
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, was)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This ends the lineage in files that every executor can read, so that a lost executor costs no recomputation of
    what stands before it, and lets several consumers use one computation. Hand the result to drop() once nothing reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames that cut() made. Nothing that is still to be computed may read them."""
    for df in frames:
        if where := getattr(df, "written", None):
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts: what Python makes of texts and sets is many times their size."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def few_bytes(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """As few_rows, and halved until a part has at most `size` bytes or a single row: what Python holds at once then hangs on the longest text, not on the rows' average."""
    for part in few_rows(batches, rows):
        parts = [part]
        while parts:
            part = parts.pop()
            if part.nbytes > size and part.num_rows > 1:
                half = part.num_rows // 2
                parts += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs without ASCII white space, in the bytes of a text."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    return edge[::2], edge[1::2]
