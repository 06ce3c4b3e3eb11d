"""A classifier from training to prediction: fit, keep, load and apply it with the statistics it belongs to."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import config as C
from quillstone.functions import amounts
from quillstone.operators import anomaly, extract, features, training
from quillstone.operators.training import Stats
from quillstone.sources.shared import settled

#: Rows and classes without which no model is fitted.
LEAST_ROWS, FOLDS = 6, 5


@dataclass
class Bundle:
    """What training leaves: statistics, the threshold, and a model where there were rows enough."""

    stats: Stats
    threshold: float = C.DEFAULT.threshold
    model: GBTClassificationModel | None = None
    forged_ratio: float = 0.0
    train_accuracy: float | None = None
    validation_accuracy: float | None = None

    @property
    def model_type(self) -> str:
        return "heuristic" if self.model is None else type(self.model).__name__


def train(docs: DataFrame, words: DataFrame | None = None, images: DataFrame | None = None, settings: C.Settings = C.DEFAULT, fields: DataFrame | None = None) -> Bundle:
    """Two passes over docs (doc_id, text, true_vendor, true_date, true_total, is_forged): statistics of what is extracted, then features under them and the fit.

    Amounts are the true totals where there are any, else the extracted ones (see training_stats). docs may lack true_total; fields may be given. Fields of the second pass are those of the first: the statistics
    aren't known when documents are read for training. All labelled documents are fitted and cross-validated. The
    threshold is calibrated on scores from outside the folds. Too few rows or one class: the rule score stands in for a model.
    """
    fields = settled(extract.extract_from_text(docs), "train-fields") if fields is None else fields
    total = F.col("true_total") if "true_total" in docs.columns else F.lit(None).cast("string")
    known = fields.join(docs.select("doc_id", "true_vendor", "true_date", amounts.parse_amount(total.cast("string")).alias("true_amount")), "doc_id")
    stats = training.training_stats(known.select(F.col("vendor.value").alias("vendor"), "true_vendor", "true_date", amounts.parse_amount(F.col("total.value")).alias("amount"), "true_amount"))
    # Tables that are stored with the model anyway: written once, they aren't computed again for each of their uses.
    stats = Stats(stats.numbers, *(settled(t, f"train-{n}") for n, t in (("vendors", stats.vendors), ("known", stats.known), ("formats", stats.formats))))
    every = features.feature_rows(docs, fields, stats, words, images).select("doc_id", "vector").join(docs.select("doc_id", "is_forged"), "doc_id")
    fitted = training.with_vector(every.filter("is_forged is not null")).select("doc_id", "features", "label").cache()
    try:
        n, forged = fitted.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        out = Bundle(stats, settings.threshold, forged_ratio=forged / n if n else 0.0)
        if n < LEAST_ROWS or forged in (0, n):
            return out
        folds = min(FOLDS, n // 2)
        if folds >= 2:
            outside = training.out_of_fold(fitted, folds, settings).cache()
            out.validation_accuracy = outside.groupBy("fold").agg(_accuracy().alias("a")).agg(F.avg("a")).first()[0]
            if best := anomaly.calibrate_threshold(outside, settings.threshold).first():
                out.threshold = best.threshold
            outside.unpersist()
        out.model = training.classifier(settings).fit(fitted)
        out.train_accuracy = training.forged_probability(out.model, fitted).agg(_accuracy()).first()[0]
        return out
    finally:
        fitted.unpersist()


def _accuracy():
    return F.avg(((F.col("score") > 0.5).cast("double") == F.col("label")).cast("double"))


TABLES = ("numbers", "vendors", "known", "formats")


def save(bundle: Bundle, path: str) -> None:
    """Statistics as Parquet tables, the numbers as JSON, the model in Spark ML's own format, in folders under path."""
    spark = bundle.stats.numbers.sparkSession
    for t in TABLES:
        getattr(bundle.stats, t).write.mode("overwrite").parquet(f"{path}/stats/{t}")
    if bundle.model is not None:
        bundle.model.write().overwrite().save(f"{path}/model")
    known = {"model_type": bundle.model_type, "feature_count": None if bundle.model is None else bundle.model.numFeatures} | {k: getattr(bundle, k) for k in ("threshold", "forged_ratio", "train_accuracy", "validation_accuracy")}
    spark.createDataFrame([(json.dumps(known, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> Bundle | None:
    """What save() wrote; None where statistics or numbers are absent."""
    try:
        stats, about = Stats(*(spark.read.parquet(f"{path}/stats/{t}") for t in TABLES)), json.loads(spark.read.text(f"{path}/about").first().value)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    model = None if about["model_type"] == "heuristic" else GBTClassificationModel.load(f"{path}/model")
    return Bundle(stats, about["threshold"], model, about["forged_ratio"], about["train_accuracy"], about["validation_accuracy"])


def scored(bundle: Bundle, rows: DataFrame) -> DataFrame:
    """Feature rows with score, reasons and is_forged: by the model, or without one by the rules and the settings' threshold."""
    if bundle.model is None:
        return anomaly.heuristic_score(rows)
    ready = training.with_vector(rows.withColumn("is_forged", F.lit(0)))
    out = training.forged_probability(bundle.model, ready).drop("features", "label", "rawPrediction", "probability", "prediction")
    return out.withColumns({"reasons": F.array(F.lit(C.MODEL_REASON)), "is_forged": (F.col("score") >= bundle.threshold).cast("int")})


def scored_without_words(bundle: Bundle, rows: DataFrame) -> DataFrame:
    """The second surface, from text and amount alone: of the model if there is one, on the features with those of words, fields and images set as predict_without_words has them; else of the rules."""
    if bundle.model is None:
        return anomaly.predict_without_words(rows)
    has = (F.col("amount") > 0).cast("double")
    plain = {c: F.lit(0.0) for c in (*C.IMAGE_FEATURES, *C.ELA_FEATURES, "ocr_mean_confidence", "ocr_low_conf_ratio", "word_count", "vendor_confidence", "date_confidence", *C.LOCAL_FEATURES)}
    rows = rows.withColumns({**plain, "total_confidence": has, "field_presence": has})
    return scored(bundle, rows.withColumn("vector", F.array(*[F.col(c) for c in features.VECTOR])))


def predict(bundle: Bundle, docs: DataFrame, lines: DataFrame | None = None, words: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) to prediction rows: id, vendor, date, total, is_forged. lines (doc_id, lines) take the place of the text's lines."""
    fields = extract.extract_from_text(docs, None, bundle.stats) if lines is None else extract.extract_fields(lines, None, bundle.stats)
    out = scored(bundle, features.feature_rows(docs, fields, bundle.stats, words, images))
    return out.select(F.col("doc_id").alias("id"), *[F.col(f"{f}.value").alias(f) for f in C.FIELDS], "is_forged")


def predict_manifest(bundle: Bundle, records: DataFrame, words: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """records (ordinal, id, image_path) and words by id to one prediction each, with ordinal: what write_predictions takes.

    A record without words (no file, nothing read) has null fields and the score of an empty text.
    """
    from quillstone.operators.layout import lines_of_words

    found = lines_of_words(words)
    lines = records.select(F.col("id").alias("doc_id")).join(found, "doc_id", "left").select("doc_id", F.coalesce("lines", F.expr("slice(array(null), 1, 0)").cast(found.schema["lines"].dataType)).alias("lines"))
    docs = lines.select("doc_id", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))
    return predict(bundle, docs, lines, words, images).join(records.select("id", "ordinal"), "id")


def null_baseline(records: DataFrame) -> DataFrame:
    """The prediction that knows nothing: null fields and is_forged 0 for every id."""
    return records.select("id", *[F.lit(None).cast("string").alias(f) for f in C.FIELDS], F.lit(0).alias("is_forged"))
