"""Manifests, labels, statistics and files as DataFrames, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import strip

RECORD = "id string, image_path string, fields struct<vendor:string,date:string,total:string>, label struct<is_forged:int,fraud_type:string>"
LABEL = "id string, label struct<is_forged:int,fraud_type:string>"
PREDICTION = "id string, vendor string, date string, total string, is_forged int"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. A bad line fails the read, or with strict False gives a row of nulls with _corrupt_record."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def validate_records(df: DataFrame) -> DataFrame:
    """Manifest rows with blank fields as null and `problems`: an empty id or path, is_forged other than 0 and 1."""
    fields = F.struct(*[F.when(blank_to_null(F.col(f"fields.{f}")).isNotNull(), F.col(f"fields.{f}")).alias(f) for f in ("vendor", "date", "total")])
    problems = F.array_compact(F.array(
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "id is empty"), F.when(F.coalesce(F.col("image_path"), F.lit("")) == "", "image_path is empty"),
        F.when(~F.col("label.is_forged").isin(0, 1), "is_forged is not 0 or 1"),
    ))
    return df.withColumns({"fields": fields, "problems": problems})


def read_records(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """train.jsonl for split 'train', test.jsonl for any other."""
    return validate_records(read_jsonl(spark, f"{folder}/{'train' if split == 'train' else 'test'}.jsonl", RECORD))


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    return read_jsonl(spark, f"{folder}/labels.jsonl", LABEL)


def last_labels(lines: DataFrame) -> DataFrame:
    """lines (line_no, id, is_forged) to one row an id: the last line's label."""
    return lines.groupBy("id").agg(F.max(F.struct("line_no", "is_forged")).alias("m")).select("id", "m.is_forged")


def read_vendor_names(spark: SparkSession, *paths: str) -> DataFrame:
    """vendor of each line of several files, at top level or under fields; unreadable lines are left out."""
    rows = spark.read.schema("vendor string, fields struct<vendor:string>").json(list(paths), mode="DROPMALFORMED")
    return rows.select(F.coalesce("vendor", "fields.vendor").alias("vendor"))


def manifest_of_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg"), recursive: bool = False) -> DataFrame:
    """id (stem) and image_path (relative), sorted by path, of the files of a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path")
    root = folder.rstrip("/").removeprefix("file:")
    relative = F.regexp_extract("path", f"{root.replace('.', chr(92) + '.')}/(.*)$", 1)
    found = files.select(relative.alias("image_path")).filter(F.lower("image_path").rlike(rf"\.({'|'.join(suffixes)})$"))
    return found.select(F.regexp_extract("image_path", r"([^/]*)\.[^./]*$", 1).alias("id"), "image_path").orderBy("image_path")


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, page_index 0 and image (Spark's struct, BGR) of the images of a folder; files that aren't images have height -1."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.col("image.origin").alias("path"), F.lit(0).alias("page_index"), "image").filter(~F.lower("path").endswith(".pdf"))


def read_pdf_pages(spark: SparkSession, folder: str, rasterise=None, dpi: int = 200) -> DataFrame:
    """path, page_index, image of PDF files. rasterise(bytes, dpi) gives (height, width, BGR bytes) of each page; none comes with this library."""
    if rasterise is None:
        raise RuntimeError("PDF pages need a rasteriser: pass a function of bytes and dpi")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    schema = "path string, page_index int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"

    def pages(batches):
        import pandas as pd

        for batch in batches:
            rows = [
                {"path": p, "page_index": i, "image": {"origin": p, "height": h, "width": w, "nChannels": 3, "mode": 16, "data": d}}
                for p, content in zip(batch.path, batch.content, strict=True) for i, (h, w, d) in enumerate(rasterise(content, dpi))
            ]
            yield pd.DataFrame(rows, columns=["path", "page_index", "image"])

    return files.mapInPandas(pages, schema)


def ocr_words(pages: DataFrame, recognise=None, prepare=None) -> DataFrame:
    """Raw OCR column arrays of pages (doc_id, page_index, image) by a plug-in: recognise(image as a dict) gives a dict of lists.

    With prepare(image as a dict), which gives a gray array or None, recognise takes that array; a page without one, or on which the engine fails, has empty
    arrays and the reason in `problem`. Decoding, preparing and reading are one pass over the pixels.
    """
    if recognise is None:
        raise RuntimeError("OCR needs an engine: pass a function of an image, or read a table of words")
    arrays = ("text", "left", "top", "width", "height", "conf", "line_num", "block_num", "par_num")
    schema = "doc_id string, page_index int, " + ", ".join(f"{c} array<string>" for c in arrays) + ", problem string"

    def one(image: dict) -> dict:
        if prepare is None:
            return recognise(image)
        nothing = {c: [] for c in arrays}
        if (ready := prepare(image)) is None:
            return nothing | {"problem": "the image can't be decoded"}
        try:
            return recognise(ready)
        except Exception as e:  # an engine's failure on a page is a row, not the end of the job
            return nothing | {"problem": f"{type(e).__name__}: {e}"}

    def run(batches):
        import pandas as pd

        for batch in batches:
            found = [one(dict(x)) for x in batch.image]
            columns = {c: [[None if v is None else str(v) for v in f[c]] for f in found] for c in arrays}
            yield pd.DataFrame({"doc_id": batch.doc_id.astype(str), "page_index": batch.page_index} | columns | {"problem": [f.get("problem") for f in found]})

    return pages.select("doc_id", "page_index", "image").mapInPandas(run, schema)


def read_tesseract_tsv(spark: SparkSession, path: str) -> DataFrame:
    """An OCR TSV's words: text not empty and confidence at least 0; short rows are filled with nulls."""
    rows = spark.read.option("sep", "\t").option("header", "true").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return rows.withColumn("conf", F.col("conf").try_cast("double")).filter((strip(F.col("text")) != "") & (F.col("conf") >= 0))


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and value of a text file's lines that aren't blank.

    Lines are counted within the blocks that tasks read, and blocks put in order by their place in the file, so a large file stays many tasks' work.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    blocks = blocks.withColumn("before", F.sum("n").over(Window.partitionBy("f").orderBy("b")) - F.col("n"))
    return rows.join(blocks, ["f", "b"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value").filter(strip(F.col("value")) != "")


def load_pages(spark: SparkSession, folder: str, rasterise=None, dpi: int = 200) -> DataFrame:
    """path, page_index, image of all documents in a folder: by suffix, PDF files through the rasteriser, others as one image. PDF files without a rasteriser are an error."""
    images = read_images(spark, folder)
    if rasterise is not None:
        return images.unionByName(read_pdf_pages(spark, folder, rasterise, dpi))
    if spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(folder).select("path").limit(1).count():
        raise RuntimeError("PDF pages need a rasteriser: pass a function of bytes and dpi")
    return images


def pages_of_records(records: DataFrame, pages: DataFrame, folder: str) -> DataFrame:
    """Records (id, image_path) with the pages of their files: doc_id, page_index, image. A record without a file has no pages."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), "/+", "/")
    key = plain(F.concat(F.lit(folder.rstrip("/") + "/"), F.col("image_path")))
    return records.select(F.col("id").alias("doc_id"), key.alias("key")).join(pages.withColumn("key", plain(F.col("path"))), "key").select("doc_id", "page_index", "image")


def read_entities(spark: SparkSession, folder: str) -> DataFrame:
    """path, company, date, address, total (without commas, a number or null) of JSON files, one record each."""
    rows = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "company string, date string, address string, total string").alias("e"))
    return rows.select("path", "e.company", "e.date", "e.address", F.regexp_replace("e.total", ",", "").try_cast("double").alias("total"))


def write_synthetic(records: DataFrame, path: str) -> DataFrame:
    """Write made-up records as JSON lines and give the counts by label (is_forged, n)."""
    records.write.option("ignoreNullFields", "false").json(path)
    return records.groupBy(F.col("label.is_forged").alias("is_forged")).agg(F.count("*").alias("n"))


#: Predictions in one file.
FILE_ROWS = 1_000_000


def write_predictions(df: DataFrame, path: str, rows: int = FILE_ROWS) -> None:
    """JSON lines in the order of column ordinal, nulls written, about `rows` a file: files are ranges of ordinals, so that concatenated by name they are in order, and each is a task's work."""
    files = max(1, -(-df.count() // rows))
    ordered = df.repartitionByRange(files, "ordinal").sortWithinPartitions("ordinal")
    ordered.select("id", "vendor", "date", "total", "is_forged").write.option("ignoreNullFields", "false").json(path)


def read_ordered_records(spark: SparkSession, path: str) -> DataFrame:
    """Manifest records with ordinal, their line's number."""
    rows = read_numbered_lines(spark, path).withColumn("r", F.from_json("value", RECORD, {"mode": "FAILFAST"}))
    return validate_records(rows.select(F.col("line_no").alias("ordinal"), "r.*"))


def stats_json(stats) -> DataFrame:
    """Training statistics (see training_stats) as one JSON document with sorted keys: by its form it holds all vendors, so it is an export of a training set, nothing reads it back."""
    listed = lambda df, c: df.agg(F.array_sort(F.collect_list(c)).alias("x"))
    mapped = lambda df, c: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias("x"))
    row = stats.numbers.drop("n_amounts")
    lower = stats.known.select(F.lower("vendor").alias("vendor")).distinct()
    for name, part in (("vendors", listed(stats.vendors, "vendor")), ("known_vendors", listed(lower, "vendor")), ("vendor_frequencies", mapped(stats.known, "vendor")), ("date_format_frequencies", mapped(stats.formats, "format"))):
        row = row.crossJoin(part.withColumnRenamed("x", name))
    return row.select(F.to_json(F.struct(*sorted(row.columns)), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
