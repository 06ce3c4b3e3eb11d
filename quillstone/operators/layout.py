"""From words or text to lines. A document's lines are an array of structs, in reading order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import let, split_lines, strip

LINE = "array<struct<text:string,left:int,top:int,right:int,bottom:int,conf:double,page:int>>"


def text_lines(text: Column) -> Column:
    """Lines of plain text with made-up boxes: line i (blank ones counted) is 8 high at 10 i, 8 wide a character; blank lines are dropped."""
    made = F.transform(
        F.transform(split_lines(F.coalesce(text, F.lit(""))), strip),
        lambda x, i: F.struct(
            x.alias("text"), F.lit(0).alias("left"), (i * 10).alias("top"), F.greatest(F.char_length(x) * 8, F.lit(1)).alias("right"),
            (i * 10 + 8).alias("bottom"), F.lit(0.0).alias("conf"), F.lit(0).alias("page"),
        ),
    )
    return F.filter(made, lambda x: x["text"] != "").cast(LINE)


def raw_words(df: DataFrame, page: Column | None = None) -> DataFrame:
    """An OCR engine's column arrays (text, left, top, width, height, conf, line_num, block_num, par_num) as one row a word.

    Blank words and words without whole-number boxes are dropped; a negative or unreadable confidence is null.
    """
    at = page if page is not None else F.col("page_index") if "page_index" in df.columns else F.lit(0)
    cols = ("text", "left", "top", "width", "height", "conf", "line_num", "block_num", "par_num")
    words = df.select("doc_id", at.alias("page_index"), F.posexplode(F.arrays_zip(*cols)).alias("ord", "w"))
    num = lambda c: F.col(f"w.{c}").cast("string").try_cast("int")
    conf = F.col("w.conf").cast("string").try_cast("double")
    out = words.select(
        "doc_id", "page_index", "ord", strip(F.col("w.text").cast("string")).alias("text"), *[num(c).alias(c) for c in ("left", "top", "width", "height")],
        F.when(conf >= 0, conf).alias("confidence"), num("line_num").alias("line_num"), num("block_num").alias("block_num"), num("par_num").alias("paragraph_num"),
    )
    return out.filter("text != '' and left is not null and top is not null and width is not null and height is not null")


WORD = ("page_index", "block_num", "paragraph_num", "line_num", "left", "top", "ord", "text", "width", "height", "confidence")


def by_document(words: DataFrame) -> DataFrame:
    """Words as one row a document: doc_id, words (structs of WORD). Words that stand so already are left as they are."""
    return words if "words" in words.columns else words.groupBy("doc_id").agg(F.collect_list(F.struct(*WORD)).alias("words"))


def line_groups(words: Column, *key: str) -> Column:
    """An array of words as an array of their lines: words sorted, and cut where the key changes."""

    def cut(ws: Column) -> Column:
        same = lambda i: reduce(lambda a, b: a & b, [F.get(ws, i)[c].eqNullSafe(F.get(ws, i - 1)[c]) for c in key])
        starts = F.filter(F.transform(ws, lambda w, i: i), lambda i: (i == 0) | ~same(i))
        return let(F.concat(starts, F.array(F.size(ws))), lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda a, k: F.slice(ws, a + 1, F.get(at, k + 1) - a)))

    return let(F.sort_array(words), cut)


def lines_of_words(words: DataFrame, reading_order: bool = True) -> DataFrame:
    """words (doc_id, page_index, ord, text, left, top, width, height, confidence, block_num, paragraph_num, line_num; or by_document) to doc_id, lines.

    Words are grouped by page, block, paragraph and line (nulls are a group), ordered by left and top. Lines stand by page, top and
    left, or with reading_order False as their first words appear, without blank ones. Confidence: mean of those not negative.
    A document's words meet once, in one row; its lines are cut within that row.
    """
    order = ("page_index", "top", "left", "ord") if reading_order else ("page_index", "ord")

    def line(ws: Column) -> Column:
        low, high = (lambda f: F.array_min(F.transform(ws, f))), (lambda f: F.array_max(F.transform(ws, f)))
        sure = F.filter(F.transform(ws, lambda w: w["confidence"].cast("double")), lambda c: c >= 0)
        mean = let(sure, lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)).otherwise(0.0))
        return F.struct(
            F.get(ws, F.lit(0))["page_index"].alias("page_index"), low(lambda w: w["top"]).alias("top"), low(lambda w: w["left"]).alias("left"), low(lambda w: w["ord"]).alias("ord"),
            strip(F.array_join(F.transform(ws, lambda w: w["text"]), " ")).alias("text"), high(lambda w: w["left"] + w["width"]).alias("right"), high(lambda w: w["top"] + w["height"]).alias("bottom"), mean.alias("conf"),
        )

    found = F.transform(line_groups(F.col("words"), "page_index", "block_num", "paragraph_num", "line_num"), line)
    if not reading_order:
        found = F.filter(found, lambda x: x["text"] != "")
    entry = lambda x: F.struct(*[x[c].alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[x[c].alias(c) for c in ("text", "left", "top", "right", "bottom", "conf")], x["page_index"].alias("page")).alias("line"))
    lines = F.transform(F.sort_array(F.transform(found, entry)), lambda e: e["line"]).cast(LINE)
    docs = by_document(words)
    if not reading_order and "words" not in words.columns:
        docs = docs.filter(F.exists("words", lambda w: strip(w["text"]) != ""))
    return docs.select("doc_id", lines.alias("lines"))


def text_words(text: Column) -> Column:
    """The words of a text, as WORD has them, with boxes as text_lines has them; confidence by arithmetic on doc_id and place, 0 to 100."""

    def of_line(line: Column, at: Column) -> Column:
        def word(x: Column, j: Column, every: Column) -> Column:
            before = F.aggregate(F.slice(every, 1, j), F.lit(0), lambda acc, y: acc + F.char_length(y) + 1)
            confidence = F.pmod(F.col("doc_id") * 7 + at * 13 + j * 29, F.lit(101)).cast("double")
            values = (F.lit(0), F.lit(1), F.lit(1), at, before * 8, line["top"], at * 1000 + j, x, F.char_length(x) * 8, F.lit(8), confidence)
            return F.struct(*[v.alias(n) for n, v in zip(WORD, values, strict=True)])

        return let(F.split(line["text"], " "), lambda every: F.transform(every, lambda x, j: word(x, j, every)))

    return F.filter(F.flatten(F.transform(text_lines(text), of_line)), lambda w: w["text"] != "")


def document_words(df: DataFrame) -> DataFrame:
    """doc_id, text to doc_id, words by document (see text_words). Texts without words have no row."""
    # What a text with words has: a filter on the words themselves would make them twice.
    return df.filter(F.col("text").rlike(r"(?U)[^\s\x1C-\x1E]")).select("doc_id", text_words(F.col("text")).alias("words"))


def words_of_text(df: DataFrame) -> DataFrame:
    """document_words with a row for each word."""
    return document_words(df).select("doc_id", F.explode("words").alias("w")).select("doc_id", "w.*")


def merge_pages(df: DataFrame, by: str = "doc_id", page: str = "page_index") -> DataFrame:
    """Page texts of a document in page order, stripped, blank ones dropped, a line break between them: `by`, page_count, text."""
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    parts = F.sort_array(F.collect_list(F.when(text != "", F.struct(F.col(page).alias("p"), text.alias("t")))))
    return df.groupBy(by).agg(F.count("*").alias("page_count"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common area over the smaller area of two boxes (structs with left, top, right, bottom); 0 without common area."""
    w = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    area = lambda x: F.greatest(F.greatest(x["right"] - x["left"], F.lit(0)) * F.greatest(x["bottom"] - x["top"], F.lit(0)), F.lit(1))
    return F.when((w > 0) & (h > 0), (w * h).cast("double") / F.least(area(a), area(b))).otherwise(0.0)


def expand_box(box: Column, width: Column, height: Column) -> Column:
    """A box with room around it: 15 % of its width and 20 % of its height, 6 at least, within the page."""
    pad_x = F.greatest(F.lit(6), F.rint((box["right"] - box["left"]) * 0.15).cast("int"))
    pad_y = F.greatest(F.lit(6), F.rint((box["bottom"] - box["top"]) * 0.2).cast("int"))
    return F.struct(
        F.greatest(F.lit(0), box["left"] - pad_x).alias("left"), F.greatest(F.lit(0), box["top"] - pad_y).alias("top"),
        F.least(width, box["right"] + pad_x).alias("right"), F.least(height, box["bottom"] + pad_y).alias("bottom"), box["page"].alias("page"),
    )
