"""Evaluation, validation of predictions, and latency figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone import config as C
from quillstone.functions.text import normalized_for_match, strip


def with_overrides(records: DataFrame, labels: DataFrame) -> DataFrame:
    """records (id, is_forged?) left-joined with labels (id, is_forged): an override beats the own label; rows with neither are left out."""
    over = labels.select("id", F.col("is_forged").alias("override"))
    return records.join(over, "id", "left").withColumn("is_forged", F.coalesce("override", "is_forged")).drop("override").filter("is_forged is not null")


def field_matches(df: DataFrame) -> DataFrame:
    """df with pred_<field> and <field> to one row a field: exact, normalized and total counts. Two nulls match."""
    one = lambda f: F.struct(
        F.lit(f).alias("field"), F.count_if(F.col(f"pred_{f}").eqNullSafe(F.col(f))).alias("exact"),
        F.count_if(normalized_for_match(F.col(f"pred_{f}")).eqNullSafe(normalized_for_match(F.col(f)))).alias("normalized"), F.count("*").alias("total"),
    )
    return df.agg(F.array(*map(one, C.FIELDS)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def format_ratio(correct, total):
    return F.when(total == 0, "n/a").otherwise(F.format_string("%.4f (%d/%d)", correct / total, correct, total))


def anomaly_metrics(df: DataFrame) -> DataFrame:
    """label and pred (0/1) to one row: accuracy, precision, recall, f1 (0 where they are undefined) and labeled_records."""
    n = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0)).cast("double")
    s = df.agg(n("label = 1 and pred = 1").alias("tp"), n("label = 0 and pred = 1").alias("fp"), n("label = 1 and pred = 0").alias("fn"), n("label = pred").alias("ok"), F.count("*").alias("labeled_records"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = F.col("tp")
    return s.select(
        div(F.col("ok"), F.col("labeled_records")).alias("accuracy"), div(tp, tp + F.col("fp")).alias("precision"), div(tp, tp + F.col("fn")).alias("recall"),
        div(tp * 2, tp * 2 + F.col("fp") + F.col("fn")).alias("f1"), "labeled_records",
    )


def latency_percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and 95th percentile, interpolated, by group."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.percentile(value, 0.95).alias("p95"))


def prediction_problems(lines: DataFrame) -> DataFrame:
    """lines (line_no, value: a JSON object as text) to line_no, id, problems, as a validator words them.

    Types are those of the JSON: is_forged must be the number 0 or 1, not a Boolean or text. Ids that an earlier line has are duplicates.
    """
    v = F.try_parse_json("value")
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    rows = lines.select("line_no", v.isNull().alias("bad"), (~F.schema_of_variant(v).startswith("OBJECT")).alias("plain"), *[kind(f).alias(f"k_{f}") for f in ("id", "is_forged", *C.FIELDS)], F.try_variant_get(v, "$.id", "string").alias("id"), F.try_variant_get(v, "$.is_forged", "string").alias("forged"))
    known = (F.col("k_id") == "STRING") & (strip(F.col("id")) != "")
    rows = rows.withColumn("nth", F.when(known, F.row_number().over(Window.partitionBy("id", known).orderBy("line_no"))))
    at = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "))
    say = lambda cond, text: F.when(F.coalesce(cond, F.lit(True)), F.concat(at, F.lit(text) if isinstance(text, str) else text))
    missing_id = F.col("k_id").isNull()
    number = F.col("k_is_forged").isin("BIGINT", "TINYINT", "SMALLINT", "INT") & F.col("forged").isin("0", "1")
    there = [
        say(F.col("k_is_forged").isNull(), "missing required field 'is_forged'"), say(~known, "'id' must be a non-empty string"),
        F.when(F.col("nth") > 1, F.concat(at, F.lit("duplicate prediction id '"), F.col("id"), F.lit("'"))), say(~number, "'is_forged' must be integer 0 or 1"),
        *[F.when(~F.col(f"k_{f}").isin("STRING", "VOID"), F.concat(at, F.lit(f"'{f}' must be string or null"))) for f in C.FIELDS],
    ]
    problems = F.when(F.col("bad"), F.array(F.concat(at, F.lit("not valid JSON")))).when(F.col("plain"), F.array(F.concat(at, F.lit("row must be an object")))).when(missing_id, F.array(F.concat(at, F.lit("missing required field 'id'")))).otherwise(F.array_compact(F.array(*there)))
    return rows.select("line_no", "id", problems.alias("problems"))


def missing_and_extra(expected: DataFrame, given: DataFrame) -> DataFrame:
    """id and kind: 'missing' for expected ids that aren't given, 'extra' for the reverse."""
    side = lambda df, bit: df.select("id", F.lit(bit).alias("side"))
    found = side(expected, 1).unionByName(side(given, 2)).groupBy("id").agg(F.bit_or("side").alias("side"))
    # A null id is no id: it is missing and extra wherever it stands.
    kinds = F.array_compact(F.array(*[F.when((F.col("side") == bit) | F.col("id").isNull() & (F.col("side") == 3), kind) for bit, kind in ((1, "missing"), (2, "extra"))]))
    return found.select("id", F.explode(kinds).alias("kind"))


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Rows (line_no, id) whose id an earlier line has."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("line_no"))).filter("nth > 1").select("line_no", "id")
