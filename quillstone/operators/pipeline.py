"""From a folder of documents to a file of predictions, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import config as C
from quillstone.operators import anomaly, extract, features, image, layout, models
from quillstone.sources import manifests
from quillstone.sources.shared import settled


def prepared(raw: dict):
    """What an OCR engine takes of an image struct; None if it can't be decoded."""
    rgb = image.rgb_of(raw)
    return None if rgb is None else image.prepare_for_ocr(rgb)


def words_of_pages(pages: DataFrame, recognise) -> DataFrame:
    """Words of pages (doc_id, page_index, image) by the engine: decoded, prepared and read in one pass."""
    return layout.raw_words(manifests.ocr_words(pages, recognise, prepared))


def fields_of_words(ids: DataFrame, words: DataFrame, stats=None) -> tuple[DataFrame, DataFrame]:
    """(docs, fields) of ids (doc_id) from words: fields are extracted by page, and each is taken from the page of the highest confidence; texts are the pages' in order. Documents without words have neither."""
    page = F.struct("doc_id", "page_index").alias("doc_id")
    lines = layout.lines_of_words(words.withColumn("doc_id", page))
    found = extract.best_of_pages(extract.extract_fields(lines, None, stats).select("doc_id.*", *C.FIELDS))
    texts = lines.select("doc_id.*", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))
    docs = ids.join(layout.merge_pages(texts), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bare = F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in (("value", None, "string"), ("confidence", 0.0, "double"), ("box", None, image.BOX), ("raw_value", None, "string"))])
    fields = ids.join(found, "doc_id", "left").select("doc_id", *[F.when(F.col(f).isNull(), bare).otherwise(F.col(f)).alias(f) for f in C.FIELDS])
    return docs, fields


def analyze(records: DataFrame, pages: DataFrame, recognise, bundle: models.Bundle) -> DataFrame:
    """The analysis of records (ordinal, id) from their pages (doc_id, page_index, image): fields, features, score, reasons, is_forged, regions and page_count.

    Words and page features are written between: pixels are read once for the words and once, with the fields' boxes, for the features.
    """
    ids = records.select(F.col("id").cast("string").alias("doc_id"))
    words = settled(words_of_pages(pages, recognise), "words")
    docs, fields = fields_of_words(ids, words, bundle.stats)
    fields = settled(fields, "fields")
    seen = settled(image.page_features(pages, fields), "pages")
    rows = features.feature_rows(docs, fields, bundle.stats, words, image.document_features(seen))
    scored = models.scored(bundle, rows)
    regions = anomaly.suspicious_regions(words, fields, image.document_blocks(seen), image.document_patches(seen))
    counted = seen.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    out = scored.join(regions, "doc_id", "left").join(counted, "doc_id", "left").join(records.select(F.col("id").cast("string").alias("doc_id"), "ordinal"), "doc_id")
    return out.withColumns({"page_count": F.coalesce("page_count", F.lit(0)), "regions": F.coalesce("regions", F.array().cast(f"array<{image.BOX}>"))})


def read_documents(spark: SparkSession, folder: str, manifest: str, rasterise=None) -> tuple[DataFrame, DataFrame]:
    """(records, pages) of a folder's manifest."""
    records = manifests.read_ordered_records(spark, f"{folder}/{manifest}")
    return records, manifests.pages_of_records(records, manifests.load_pages(spark, folder, rasterise), folder)


def predict_folder(spark: SparkSession, bundle: models.Bundle, folder: str, path: str, recognise, rasterise=None) -> None:
    """Read test.jsonl and its images in `folder`, and write one prediction a record to `path`, in the manifest's order. A record whose file is missing or can't be read has null fields."""
    records, pages = read_documents(spark, folder, "test.jsonl", rasterise)
    out = analyze(records, pages, recognise, bundle).select(F.col("doc_id").alias("id"), *[F.col(f"{f}.value").alias(f) for f in C.FIELDS], "is_forged", "ordinal")
    manifests.write_predictions(settled(out, "predictions"), path)


def train_folder(spark: SparkSession, folder: str, recognise, rasterise=None, settings: C.Settings = C.DEFAULT) -> models.Bundle:
    """Train on train.jsonl and its images in `folder`. True fields are those of the records."""
    records, pages = read_documents(spark, folder, "train.jsonl", rasterise)
    ids = records.select(F.col("id").cast("string").alias("doc_id"))
    words = settled(words_of_pages(pages, recognise), "words")
    docs, fields = fields_of_words(ids, words)
    fields = settled(fields, "fields")
    truth = records.select(F.col("id").cast("string").alias("doc_id"), *[F.col(f"fields.{f}").alias(f"true_{f}") for f in C.FIELDS], F.coalesce("label.is_forged", F.lit(0)).alias("is_forged"))
    images = settled(image.document_features(image.page_features(pages, fields)), "images")
    return models.train(docs.join(truth, "doc_id"), words, images, settings, fields=fields)
