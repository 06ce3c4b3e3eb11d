"""Features of documents: consistency of the total with the text, confidences, boxes, and the vector of 53 slots."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone import config as C
from quillstone.functions import amounts
from quillstone.functions.text import let, split_lines, strip, text_features
from quillstone.operators import extract
from quillstone.operators.extract import AMOUNTS
from quillstone.operators.layout import by_document, expand_box, lines_of_words
from quillstone.operators.search import with_any

if TYPE_CHECKING:
    from quillstone.operators.training import Stats


def consistency_features(text: Column, amount: Column, hit: Column, stats: dict[str, Column]) -> Column:
    """Struct of the seven consistency features. stats: amount_mean, amount_std, amount_q1, amount_q3 (null: 0); hit: whether the text or the vendor has a known vendor (see vendor_hits)."""
    num = lambda c: F.coalesce(stats[c].try_cast("double"), F.lit(0.0))
    q1, q3 = num("amount_q1"), num("amount_q3")
    one = F.lit(1.0)

    def from_text(t: Column) -> Column:
        lines = F.filter(split_lines(t), lambda x: x.rlike(r"(?U)\S"))
        numeric = let(lines, lambda x: F.when(F.size(x) > 0, F.size(F.filter(x, lambda y: y.rlike(r"\p{Nd}"))).cast("double") / F.size(x)).otherwise(0.0))
        return F.struct(amounts.plain_tokens(t).alias("tokens"), numeric.alias("numeric"))

    def compared(k: Column) -> Column:
        readable = F.filter(k["tokens"], lambda x: x.rlike(r"^(?:\d+\.?\d*|\.\d+)$"))
        gap = F.coalesce(F.array_min(F.transform(readable, lambda x: F.abs(x.cast("double") - amount))), amount)
        off = F.when(amount < q1, (q1 - amount) / (q3 - q1)).when(amount > q3, (amount - q3) / (q3 - q1)).otherwise(0.0)
        return F.struct(
            F.when(F.arrays_overlap(k["tokens"], amounts.amount_variants(amount)), 1.0).otherwise(0.0).alias("inside"),
            F.when((amount > 0) & (num("amount_std") > 1e-6), F.abs(amount - num("amount_mean")) / num("amount_std")).otherwise(0.0).alias("z"),
            F.when((amount > 0) & (q3 - q1 > 1e-6), off).otherwise(0.0).alias("iqr"), F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0).alias("hit"), k["numeric"].alias("numeric"),
            F.when(amount > 0, gap).otherwise(0.0).alias("gap"),
        )

    def with_risk(k: Column) -> Column:
        risk = (
            F.lit(0.35) * (one - k["inside"]) + F.lit(0.25) * F.least(k["z"] / 3.0, one) + F.lit(0.2) * F.least(k["iqr"], one)
            + F.lit(0.1) * (one - k["hit"]) + F.lit(0.1) * F.least(k["gap"] / F.greatest(amount, one), one)
        )
        values = (*(k[c] for c in ("inside", "z", "iqr", "hit", "numeric", "gap")), F.greatest(F.lit(0.0), F.least(one, risk)))
        return F.struct(*[v.alias(n) for n, v in zip(C.CONSISTENCY_FEATURES, values, strict=True)])

    return let(let(let(strip(F.coalesce(text, F.lit(""))), from_text), compared), with_risk)


def vendor_hits(docs: DataFrame, vendors: DataFrame) -> DataFrame:
    """doc_id of the docs (doc_id, text, vendor) whose text contains a vendor (vendors: vendor), or whose vendor is one, whatever the case."""
    plain = F.lower(strip(F.col("vendor")))
    rows = docs.select(F.col("doc_id").alias("at"), F.lower(strip(F.coalesce(F.col("text"), F.lit("")))).alias("text"), plain.alias("exact"))
    known = vendors.select(plain.alias("pattern")).filter("pattern != ''").distinct()
    # Most vendors are known ones: a join finds them, and only the other documents' texts are searched.
    same = F.col("exact") == F.col("pattern")
    found = rows.join(known, same, "left_semi").select("at").unionByName(with_any(rows.join(known, same, "left_anti"), known))
    return found.distinct().withColumnRenamed("at", "doc_id")


def word_features(words: DataFrame) -> DataFrame:
    """doc_id, ocr_mean_confidence, ocr_low_conf_ratio, word_count. Null and negative confidences are left out of the first two."""
    return by_document(words).select("doc_id", _word_features().alias("wf")).select("doc_id", "wf.*")


def _word_features() -> Column:
    """word_features of a row's words."""
    sure = F.filter(F.transform("words", lambda w: w["confidence"] / 100.0), lambda c: c >= 0)
    mean = lambda cs: F.when(F.size(cs) > 0, F.aggregate(cs, F.lit(0.0), lambda s, c: s + c) / F.size(cs)).otherwise(0.0)
    low = lambda cs: F.when(F.size(cs) > 0, F.size(F.filter(cs, lambda c: c < 0.5)).cast("double") / F.size(cs)).otherwise(0.0)
    return let(sure, lambda cs: F.struct(mean(cs).alias("ocr_mean_confidence"), low(cs).alias("ocr_low_conf_ratio"), F.size("words").cast("double").alias("word_count")))


def field_presence() -> Column:
    return sum((F.col(f"{f}.value").isNotNull().cast("int") for f in C.FIELDS), F.lit(0)) / F.lit(3.0)


#: From this score on an amount competes with the total.
COMPETES = 0.9


def amount_offers(words: DataFrame) -> DataFrame:
    """Each amount in the lines of words as they appear, scored without statistics: doc_id, idx, value, amount, score, ord, box."""
    return extract.amount_offers(lines_of_words(words, reading_order=False))


def document_offers(words: DataFrame, least: float = COMPETES) -> DataFrame:
    """doc_id, offers: the amounts of amount_offers that score `least` or more, in no order; documents without one have no row."""
    strong = amount_offers(words).filter(F.col("score") >= least)
    return strong.groupBy("doc_id").agg(F.collect_list(F.struct("idx", "value", "amount", "score", "ord", "box")).alias("offers"))


def conflicting_amounts(words: DataFrame, totals: DataFrame) -> DataFrame:
    """totals (doc_id, total: double) with field_conflict_count: distinct amounts that score 0.9 and are not the total, 0 without a total."""
    return totals.join(document_offers(words).hint("merge"), "doc_id", "left").select("doc_id", _conflicts(F.col("total")).alias("field_conflict_count"))


def _conflicts(total: Column) -> Column:
    """How many distinct amounts of a row's offers compete with the total."""
    other = F.filter("offers", lambda c: (c["score"] >= COMPETES) & (total > 0) & (F.abs(c["amount"] - total) > 0.06))
    n = F.size(F.array_distinct(F.transform(other, lambda c: c["value"]))).cast("double")
    return F.when(F.col("offers").isNotNull(), n).otherwise(0.0)


def field_word_overlap(fields: DataFrame, words: DataFrame | Column, width: int = 1 << 20, height: int = 1 << 20) -> DataFrame:
    """Mean confidence of the words in the room around each field's box: doc_id, field, field_conf, words. A document's fields meet its words, one row each, and boxes are compared there.

    words may be a column that makes them from those of fields, which then go nowhere.
    """
    if isinstance(words, Column):
        docs = fields.select("doc_id", *C.FIELDS, words.alias("words"))
    else:
        docs = fields.select("doc_id", *C.FIELDS).join(by_document(words).hint("merge"), "doc_id")
    hit = docs.select("doc_id", F.explode_outer(_near_words(width, height)).alias("x")).filter("size(x.c) > 0")
    return hit.select("doc_id", "x.field", _mean("x.c").alias("field_conf"), F.size("x.c").cast("long").alias("words"))


def _mean(c: str | Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)


def _near_words(width: int = 1 << 20, height: int = 1 << 20) -> Column:
    """Of a row with fields and words: each field that has a box with the confidences (c) of the words in the room around it."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.box").alias("box")) for f in C.FIELDS])
    rooms = F.transform(F.filter(each, lambda x: x["box"].isNotNull()), lambda x: F.struct(x["field"].alias("field"), expand_box(x["box"], F.lit(width), F.lit(height)).alias("room"), x["box"]["page"].alias("page")))

    def near(x: Column, ws: Column) -> Column:
        room = x["room"]
        # What overlap_ratio asks for, when only whether there is any counts.
        meets = lambda w: (F.least(w["left"] + w["width"], room["right"]) > F.greatest(w["left"], room["left"])) & (F.least(w["top"] + w["height"], room["bottom"]) > F.greatest(w["top"], room["top"]))
        inside = F.filter(ws, lambda w: (w["confidence"] >= 0) & (w["page_index"] == x["page"]) & meets(w))
        return F.struct(x["field"].alias("field"), F.transform(inside, lambda w: w["confidence"] / 100.0).alias("c"))

    # Words that are made in the row are made once, not for each room.
    return let(F.col("words"), lambda ws: F.transform(rooms, lambda x: near(x, ws)))


#: The columns of feature_rows in the order of the vector.
VECTOR = (*C.IMAGE_FEATURES, *C.ELA_FEATURES, *("text_line_count" if c == "line_count" else c for c in C.TEXT_FEATURES), *C.CONSISTENCY_FEATURES, *C.EXTRA_FEATURES, *C.LOCAL_FEATURES, "amount")


def feature_rows(docs: DataFrame, fields: DataFrame | None, stats: Stats, words: DataFrame | Column | None = None, images: DataFrame | None = None, offers: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document with all features as columns, `amount` and the 53-slot vector.

    docs: doc_id, text; fields: as extracted, None if docs have them. stats: see training_stats. words: a table, or a column that makes them from those of docs; with a
    column, offers are document_offers. images: doc_id and image features, else zeros. The text's line
    count and the layout's are text_line_count and line_count. keep: further columns to keep, of docs, words, offers or images.
    """
    # Tables of one row a document are joined by merging: their files are small for what they hold, and broadcast they would fill the driver.
    joined = docs if fields is None else docs.select("doc_id", "text").join(fields.hint("merge"), "doc_id")
    hits = vendor_hits(joined.select("doc_id", "text", F.col("vendor.value").alias("vendor")), stats.vendors).withColumn("vendor_hit", F.lit(True))
    known = {c: F.col(c) for c in AMOUNTS}
    amount = F.coalesce(amounts.parse_amount(F.col("total.value")), F.lit(0.0))
    in_row = isinstance(words, Column)
    if words is not None and not in_row:
        near = field_word_overlap(joined if fields is None else fields, words).groupBy("doc_id").pivot("field", list(C.FIELDS)).agg(F.first("field_conf"))
        near = near.select("doc_id", *[F.col(f).alias(f"field_conf_{f}") for f in C.FIELDS])
        conflicts = conflicting_amounts(words, joined.select("doc_id", amount.alias("total")))
        joined = joined.join(word_features(words).hint("merge"), "doc_id", "left").join(near.hint("merge"), "doc_id", "left").join(conflicts.hint("merge"), "doc_id", "left")
    if in_row:
        joined = joined.join(offers.hint("merge"), "doc_id", "left")
    if images is not None:
        joined = joined.join(images.hint("merge"), "doc_id", "left")
    joined = joined.join(hits.hint("merge"), "doc_id", "left").crossJoin(F.broadcast(stats.numbers.limit(1)))
    joined = joined.withColumn("amount", amount)
    if in_row:
        # Words are made after the joins, so that texts are moved, not words.
        joined = joined.withColumn("words", words).withColumns({"wf": _word_features(), "near": _near_words(), "field_conflict_count": _conflicts(F.col("amount"))})
        of = lambda f: F.get(F.filter("near", lambda x: (x["field"] == f) & (F.size(x["c"]) > 0)), F.lit(0))["c"]
        joined = joined.select("*", "wf.*", *[let(of(f), lambda c: F.when(c.isNotNull(), _mean(c))).alias(f"field_conf_{f}") for f in C.FIELDS])
    text = text_features(F.coalesce(F.col("text"), F.lit("")))
    joined = joined.withColumn("tf", text).withColumn("cf", consistency_features(F.col("text"), F.col("amount"), F.col("vendor_hit"), known))
    n_lines = F.size(F.filter(split_lines(F.coalesce(F.col("text"), F.lit(""))), lambda x: x.rlike(r"(?U)\S"))).cast("double")
    joined = joined.withColumn("line_count", n_lines).withColumn("field_presence", field_presence())
    for f in C.FIELDS:
        joined = joined.withColumn(f"{f}_confidence", F.col(f"{f}.confidence")).withColumn(f"field_present_{f}", F.col(f"{f}.box").isNotNull().cast("double"))
    have = set(joined.columns)
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)
    cols = {c: value(c) for c in (*C.IMAGE_FEATURES, *C.ELA_FEATURES)}
    cols |= {("text_line_count" if c == "line_count" else c): F.col(f"tf.{c}") for c in C.TEXT_FEATURES}
    cols |= {c: F.col(f"cf.{c}") for c in C.CONSISTENCY_FEATURES} | {c: value(c) for c in (*C.EXTRA_FEATURES, *C.LOCAL_FEATURES)} | {"amount": F.col("amount")}
    out = joined.select("doc_id", *C.FIELDS, *keep, *[v.alias(k) for k, v in cols.items()])
    return out.withColumn("vector", F.array(*[F.col(c) for c in cols]))
