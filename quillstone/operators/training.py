"""What a training set teaches: statistics of amounts, vendors and date formats, and a boosted classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone import config as C
from quillstone.functions.dates import detect_format
from quillstone.functions.quantiles import percentiles
from quillstone.functions.text import collapse, strip


@dataclass
class Stats:
    """What a training set teaches, as tables: numbers (one row), vendors (vendor: predicted ones, distinct), known (vendor, n: true ones), formats (format, n: of true dates, of which there are few)."""

    numbers: DataFrame
    vendors: DataFrame
    known: DataFrame
    formats: DataFrame


NUMBERS = ("n_amounts", "amount_mean", "amount_std", "amount_q1", "amount_q3", "amount_min", "amount_max")


def training_stats(records: DataFrame) -> Stats:
    """records (vendor: predicted, true_vendor, true_date, amount: predicted, true_amount if known) to statistics.

    Mean, deviation (population) and quartiles (interpolated) are of the true amounts where there is any, else of the predicted ones; least and largest are of true
    amounts only. Without any they are 0. Quartiles come from histograms; no set or list of values is held anywhere.
    """
    true = F.col("true_amount") if "true_amount" in records.columns else F.lit(None)
    each = F.explode(F.array(F.struct(F.lit(True).alias("true"), true.cast("double").alias("v")), F.struct(F.lit(False).alias("true"), F.col("amount").cast("double").alias("v"))))
    counts = records.select(each.alias("x")).select("x.*").filter("v is not null and not isnan(v)").groupBy("true", "v").agg(F.count("*").alias("n")).persist()
    try:
        mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
        sums = {r["true"]: r for r in counts.groupBy("true").agg(F.sum("n").alias("n"), mean.alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
        of = True in sums
        n, average, low, high = sums[of][1:] if sums else (0, 0.0, 0.0, 0.0)
        own = counts.filter(F.col("true") == of)
        spread = own.agg(F.sum(F.col("n") * (F.col("v") - average) * (F.col("v") - average)) / max(n, 1)).first()[0] if n else 0.0
        q1, q3 = percentiles(own, n, low, high, (0.25, 0.75)) if n else (0.0, 0.0)
    finally:
        counts.unpersist()
    row = (n, average, spread**0.5, q1, q3, low if of else 0.0, high if of else 0.0)
    numbers = records.sparkSession.createDataFrame([row], "n_amounts long, " + ", ".join(f"{c} double" for c in NUMBERS[1:]))
    tally = lambda key, name: records.select(key.alias(name)).filter(f"{name} is not null and {name} != ''").groupBy(name).agg(F.count("*").alias("n"))
    return Stats(numbers, tally(strip(F.col("vendor")), "vendor").select("vendor"), tally(strip(F.col("true_vendor")), "vendor"), tally(detect_format(F.col("true_date")), "format"))


def vendor_priors(records: DataFrame) -> DataFrame:
    """vendor (lower case, white space collapsed) and count, of records with vendor or fields.vendor."""
    return records.select(F.lower(collapse(strip(F.col("vendor")))).alias("vendor")).filter("vendor is not null and vendor != ''").groupBy("vendor").agg(F.count("*").alias("count"))


def classifier(settings: C.Settings = C.DEFAULT) -> GBTClassifier:
    return GBTClassifier(labelCol="label", featuresCol="features", maxIter=settings.trees, stepSize=settings.learning_rate, maxDepth=settings.depth, minInstancesPerNode=settings.leaf, seed=settings.seed)


def with_vector(rows: DataFrame, label: str = "is_forged") -> DataFrame:
    """feature rows (vector: array) with features for the classifier and a double label."""
    return rows.withColumn("features", array_to_vector("vector")).withColumn("label", F.col(label).cast("double"))


def folds(rows: DataFrame, k: int = 5, seed: int = C.DEFAULT.seed) -> DataFrame:
    """rows (doc_id, label) with fold: within each label, documents in the order of a seeded hash go round the folds."""
    by = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    return rows.withColumn("fold", F.pmod(F.row_number().over(by), F.lit(k)))


def forged_probability(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def out_of_fold(rows: DataFrame, k: int = 5, settings: C.Settings = C.DEFAULT) -> DataFrame:
    """doc_id, label, fold, score: each document scored by a model that hasn't seen its fold. rows: doc_id, features, label; read k times over."""
    dealt = folds(rows, k, settings.seed)
    out = None
    for i in range(k):
        part = forged_probability(classifier(settings).fit(dealt.filter(F.col("fold") != i)), dealt.filter(F.col("fold") == i)).select("doc_id", "label", "fold", "score")
        out = part if out is None else out.unionByName(part)
    return out

