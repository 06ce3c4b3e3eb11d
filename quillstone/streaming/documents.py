"""The same analysis over documents as they arrive. It is stateless by document, so a micro-batch is analysed like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillstone import config as C
from quillstone.operators.extract import extract_from_text


def read_texts(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", form: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(form).load(folder)


def analyse_stream(texts: DataFrame, out: str, checkpoint: str, stats: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """Fields of each arriving document as Parquet under out/batch=N. A batch that runs again after a failure replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        found = extract_from_text(batch, stats=stats)
        flat = found.select("doc_id", *[c for f in C.FIELDS for c in (found[f]["value"].alias(f), found[f]["confidence"].alias(f"{f}_confidence"))])
        flat.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
