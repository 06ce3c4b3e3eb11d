"""Summaries of scored documents by fixed sentences, and the prompt for a language model. No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone import config as C
from quillstone.functions.text import join_phrases
from quillstone.operators.anomaly import status


def document_summary(df: DataFrame, threshold: float = C.DEFAULT.threshold) -> DataFrame:
    """doc_id, vendor, date, total ('' if null), ocr_text_present, status, score, threshold (4 places), reason_count, strongest_signal."""
    reasons = F.filter("reasons", lambda r: F.trim(r) != "")
    four = lambda c: F.rint(c * 10000) / 10000
    return df.select(
        "doc_id", *[F.coalesce(F.col(f"{f}.value"), F.lit("")).alias(f) for f in C.FIELDS], F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S").alias("ocr_text_present"),
        status(F.col("score"), threshold).alias("status"), four(F.col("score")).alias("score"), F.lit(round(threshold, 4)).alias("threshold"), F.size(reasons).alias("reason_count"),
        F.coalesce(F.get(reasons, F.lit(0)), F.lit("")).alias("strongest_signal"),
    )


def _choose(options, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(index, F.lit(len(options))) + 1).cast("int"))


def narrative(df: DataFrame, with_features: bool = True, threshold: float = C.DEFAULT.threshold) -> DataFrame:
    """doc_id, summary. df: doc_id, field structs, score, is_forged, reasons; optional page_count, n_regions and features (absent or null: as if unknown).

    with_features False leaves features out: only missing fields are evidence then.
    """
    have = set(df.columns) if with_features else set()
    num = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"{f}.value"), F.lit("")) == "", F.lit(f)) for f in C.FIELDS]))
    flagged = F.array_compact(F.array(*[F.when((num(f"field_present_{f}", 1.0) > 0) & ((num(f"field_ela_{f}", 0.0) >= 18) | (num(f"field_conf_{f}", 1.0) <= 0.4)), F.lit(f)) for f in C.FIELDS]))
    tests = (
        (num("ela_high_ratio", 0.0) >= 0.12) | (num("ela_max", 0.0) >= 40), (num("ocr_low_conf_ratio", 0.0) >= 0.35) | (num("ocr_mean_confidence", 1.0) <= 0.55), F.size("missing") > 0,
        (num("field_conflict_count", 0.0) >= 1) | (num("consistency_risk", 0.0) >= 0.58), (num("amount_zscore", 0.0) >= 2.5) | (num("amount_iqr_gap", 0.0) >= 1),
    )
    texts = [F.replace(F.lit(C.EVIDENCE[i]), F.lit("%s"), F.array_join("missing", "/")) if i == 2 else F.lit(C.EVIDENCE[i]) for i in range(5)]
    near = F.transform("flagged", lambda f: F.replace(F.lit(C.EVIDENCE[5]), F.lit("%s"), f))
    df = df.withColumns({"missing": missing, "flagged": flagged})
    df = df.withColumn("evidence", F.concat(F.array_compact(F.array(*[F.when(t, x) for t, x in zip(tests, texts, strict=True)])), near))
    n, s, forged = F.size("evidence"), F.col("score"), F.col("is_forged") == 1
    sure = F.when((s >= threshold + 0.2) | (n >= 4), "strongly suggests").when((s >= threshold) | (n >= 2), "likely").otherwise("possibly")
    pages = F.col("page_count") if "page_count" in df.columns else F.lit(1)
    regions = F.col("n_regions") if "n_regions" in df.columns else F.lit(0)
    variant = F.pmod(F.rint(s * 100).cast("long") + pages + F.size("reasons") + regions, F.lit(7))
    opener = F.when(forged, _choose(C.SUSPICIOUS_OPENERS, variant)).otherwise(_choose(C.GENUINE_OPENERS, variant))
    first = (
        F.when(forged, F.concat(opener, F.lit(" and "), sure, F.lit(" alteration.")))
        .when(n > 0, F.concat(opener, F.lit(", although the available signals "), sure, F.lit(" localized review.")))
        .when(F.greatest(F.lit(threshold) - s, F.lit(0.0)) >= 0.15, F.concat(opener, F.lit(" with no meaningful anomaly pressure.")))
        .otherwise(F.concat(opener, F.lit(", with only limited weak indicators noted.")))
    )
    lead = _choose(C.LEADS, n + F.rint(s * 10).cast("long") + round(threshold * 10))
    closing = F.when(forged & (F.size("flagged") > 0), C.CLOSINGS[0]).when(F.size("missing") > 0, C.CLOSINGS[1]).when(forged, C.CLOSINGS[2]).otherwise(C.CLOSINGS[3])
    bare = F.concat(first, F.lit(" "), F.when(forged, C.NO_EVIDENCE_FORGED).otherwise(C.NO_EVIDENCE_GENUINE))
    full = F.concat(first, F.lit(" "), lead, F.lit(" "), join_phrases(F.col("evidence")), F.lit(". "), closing)
    return df.select("doc_id", F.when(n == 0, bare).otherwise(full).alias("summary"))


def prompt(df: DataFrame, threshold: float = C.DEFAULT.threshold) -> DataFrame:
    """doc_id, prompt: what a language model would be asked about a scored document, with its features in a fixed order."""
    present = [f for f in C.PROMPT_FEATURES if f in df.columns] or sorted(c for c, t in df.dtypes if t == "double")[:12]
    value = lambda c, d: F.format_string(f"%.{d}f", F.coalesce(F.col(c), F.lit(0.0)).cast("double"))
    fields = [F.concat(F.lit(f"- {f.capitalize()}: value="), F.coalesce(F.nullif(F.col(f"{f}.value"), F.lit("")), F.lit("missing")), F.lit(", confidence="), value(f"{f}.confidence", 3)) for f in C.FIELDS]
    # The wording of the request.
    head = (
        "Prepare a forensic document analysis summary for this receipt.", "Requirements:", "- Write exactly 2 or 3 sentences.", "- Mention whether the receipt appears genuine or suspicious.",
        "- Reference the anomaly score and the strongest evidence.", "- If fields are missing or low-confidence, mention that briefly.", "",
    )
    lines = [
        *map(F.lit, head), F.concat(F.lit("Anomaly score: "), value("score", 4)), F.lit(f"Decision threshold: {threshold:.4f}"), F.concat(F.lit("Is forged: "), F.when(F.col("is_forged") == 1, "True").otherwise("False")),
        F.concat(F.lit("Reasons: "), F.when(F.size("reasons") > 0, F.array_join("reasons", ", ")).otherwise("None")), F.lit("Extraction results:"), *fields,
        F.concat(F.lit("OCR text present: "), F.when(F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S"), "True").otherwise("False")),
        F.concat(F.lit("Page count: "), (F.col("page_count") if "page_count" in df.columns else F.lit(1)).cast("string")), F.lit("Key feature values:"),
        *[F.concat(F.lit(f"- {c}: "), value(c, 4)) for c in present],
    ]
    return df.select("doc_id", F.concat_ws("\n", *lines).alias("prompt"))
