"""What plans must not do on tables whose files are small for what they hold."""

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import anomaly, evaluate, extract, features, image, layout


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_skew_sends_no_pixels_to_the_driver(spark):
    pixels = spark.range(4).selectExpr("id AS vec_id", "explode(sequence(0, 63)) AS i").selectExpr("vec_id", "0 AS label", "CAST(i DIV 8 AS INT) AS y", "CAST(i % 8 AS INT) AS x", "CAST(i * 4 AS DOUBLE) AS v")
    assert "SortMergeJoin" in plan(image.raster_skew(pixels)) and image.raster_skew(pixels).count() == 4


def _texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "Bright Market\nDate: 2024-01-24\nSubtotal 40.00\nTax 5.60\nTOTAL 45.60"), (2, ""), (3, None), (4, "\x1c \n")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "texts"))
    return spark.read.parquet(str(tmp_path / "texts"))


def test_words_meet_fields_by_document(spark, tmp_path):
    df = _texts(spark, tmp_path)
    for words in (layout.document_words(df), layout.words_of_text(df)):
        near = features.field_word_overlap(extract.extract_from_text(df), words)
        assert "Broadcast" not in plan(near)
        assert {r.field: r.words for r in near.collect()} == {"vendor": 4, "date": 6, "total": 4}


def test_fields_of_texts_need_no_shuffle(spark, tmp_path):
    df = _texts(spark, tmp_path)
    fields = extract.extract_from_text(df)
    assert "Exchange" not in plan(fields)
    got = {r.doc_id: (r.vendor.value, r.date.value, r.total.value) for r in fields.collect()}
    assert got == {1: ("Bright Market", "2024-01-24", "45.60"), 2: (None,) * 3, 3: (None,) * 3, 4: (None,) * 3}


def test_lines_are_cut_within_a_document(spark, tmp_path):
    df = _texts(spark, tmp_path)
    lines = layout.lines_of_words(layout.document_words(df))
    assert "Exchange" not in plan(lines)
    by_rows = layout.lines_of_words(layout.words_of_text(df))
    assert lines.orderBy("doc_id").collect() == by_rows.orderBy("doc_id").collect() and [r.doc_id for r in lines.collect()] == [1]
    totals = df.select("doc_id", F.lit(45.6).alias("total"))
    assert {r.doc_id: r.field_conflict_count for r in features.conflicting_amounts(layout.document_words(df), totals).collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_missing_and_extra_in_one_pass(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = evaluate.missing_and_extra(ids(1, 1, 2, 3, None), ids(2, 4, 4, None))
    assert "Join" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "missing"), (3, "missing"), (None, "missing"), (4, "extra"), (None, "extra")], key=repr)
    assert [tuple(r) for r in evaluate.missing_and_extra(ids(1), ids(1, None)).collect()] == [(None, "extra")]


def test_texts_of_known_vendors_are_not_searched(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "no name", " ACME "), (2, "at acme corp", None), (3, "other", "Other"), (4, None, "")], "doc_id long, text string, vendor string")
    vendors, searched, search = spark.createDataFrame([("Acme",), ("",), (None,)], "vendor string"), [], features.with_any
    monkeypatch.setattr(features, "with_any", lambda rows, patterns: searched.extend(r["at"] for r in rows.collect()) or search(rows, patterns))
    assert sorted(r.doc_id for r in features.vendor_hits(docs, vendors).collect()) == [1, 2] and sorted(searched) == [2, 3, 4]


def test_fields_of_pages_stay_in_their_task(spark, tmp_path):
    df = _texts(spark, tmp_path).union(spark.createDataFrame([(5, "\n".join(f"item {i} {i}.50" for i in range(40)) + "\nSubtotal 7.00\nTax 0.50\nTOTAL 7.50")], "doc_id long, text string"))
    pages = df.select(F.struct("doc_id", F.lit(0).alias("page_index")).alias("doc_id"), "text", F.length("text").alias("size"))
    fields = extract.extract_from_text(pages, keep=("size",))
    assert "Exchange" not in plan(fields) and fields.columns == ["doc_id", "size", "vendor", "date", "total"]
    whole = {r.doc_id.doc_id: r for r in fields.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {r.doc_id.doc_id: r for r in extract.extract_from_text(pages, keep=("size",)).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (whole[5].total.value, whole[5]["size"], whole[2].vendor.value, whole[2]["size"], whole[3]["size"]) == ("7.50", len(df.filter("doc_id = 5").first().text), None, 0, None)


def test_rasters_meet_pages_that_have_their_boxes(spark):
    from quillstone import config as C

    pixels = spark.range(2).selectExpr("id AS vec_id", "explode(sequence(0, 109)) AS i").selectExpr("vec_id", "0 AS label", "CAST(i DIV 11 AS INT) AS y", "CAST(i % 11 AS INT) AS x", "CAST((i * i * (vec_id + 3)) % 256 AS DOUBLE) AS v")
    field = "struct<value:string,confidence:double,box:struct<left:int,top:int,right:int,bottom:int,page:int>,raw_value:string>"
    rows = [(1, ("V", 0.9, (3, 7, 100, 31, 0), "V"), ("D", 0.9, (0, 500, 9, 508, 1), "D"), ("T", 0.4, (250, 200, 900, 300, 7), "T")), (2, (None, 0.0, None, None), (None, 0.0, None, None), ("T", 0.9, (-5, -9, 24, 24, 0), "T"))]
    fields = spark.createDataFrame(rows, f"doc_id long, vendor {field}, date {field}, total {field}")
    pages = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 1), (3, 0, 0)], "doc_id long, page_index int, vec_id long")
    found = image.raster_pages(pages, pixels, fields, 24, 50)
    patches = image.document_patches(found)
    # Pages and fields are dealt by document, one small row each; nothing with pixels is, and patches aren't made twice to ask for their number.
    assert plan(patches).count("hashpartitioning(doc_id") == 2 and "size(cast(transform" not in plan(patches)
    levels = {v: np.zeros((10, 11)) for v in (0, 1)}
    for r in image.raster_levels(pixels, 50).collect():
        levels[r.vec_id][r.y, r.x] = r.e
    got = {(r.doc_id, r.field): (r.local_ela, r.room) for r in patches.collect()}
    want = {}
    for d, f, v, box in ((1, "vendor", 0, (3, 7, 100, 31)), (1, "date", 1, (0, 500, 9, 508)), (1, "total", 1, (250, 200, 900, 300)), (2, "total", 1, (-5, -9, 24, 24))):
        table = image.summed(levels[v].repeat(24, 0).repeat(24, 1))
        [one] = image.local_levels(table, [{"field": f, "box": dict(zip(("left", "top", "right", "bottom", "page"), (*box, 0), strict=True))}])
        want[d, f] = one
    assert set(got) == set(want) and got[1, "date"][0] is None
    assert all(got[k][0] == want[k]["local_ela"] or abs(got[k][0] - want[k]["local_ela"]) < 1e-9 for k in want)
    assert all({c: got[k][1][c] for c in ("left", "top", "right", "bottom")} == {c: want[k]["room"][c] for c in ("left", "top", "right", "bottom")} for k in want)
    assert sorted((r.doc_id, r.page_index) for r in found.collect()) == [(1, 0), (1, 1), (2, 0), (3, 0)] and set(C.IMAGE_FEATURES) < set(found.columns)


def test_skew_moves_each_pixel_once(spark):
    pixels = spark.range(3).selectExpr("id AS vec_id", "explode(sequence(0, 89)) AS i").selectExpr("vec_id", "0 AS label", "CAST(i DIV 10 AS INT) AS y", "CAST(i % 10 AS INT) AS x", "CAST((i * (vec_id + 7)) % 256 AS DOUBLE) AS v")
    found = image.raster_skew(pixels)
    # Pixels are dealt by raster, not by the places that they are turned to.
    assert "hashpartitioning(vec_id" in plan(found) and "sy#" not in plan(found)
    grays = {v: [[0.0] * 10 for _ in range(9)] for v in range(3)}
    for r in pixels.collect():
        grays[r.vec_id][r.y][r.x] = r.v
    for r in found.collect():
        black = np.where(np.array(grays[r.vec_id]) > 180, 255.0, 0.0)
        spread = [image.rotate(black, a).sum(1).var() for a in image.ANGLES]
        assert r.angle == image.ANGLES[int(np.argmax(spread))] == image.skew_angle(np.array(grays[r.vec_id])) and abs(r.score - max(spread)) < 1e-6
    assert [tuple(r) for r in image.raster_skew(pixels.filter("vec_id = 0 and y = 4 and x < 3").withColumn("v", F.lit(9.0))).select("vec_id").collect()] == [(0,)]


def test_words_made_in_a_row_are_not_moved(spark, tmp_path):
    df = _texts(spark, tmp_path)
    docs = extract.extract_from_text(df, keep=("text",))
    near = features.field_word_overlap(docs, layout.text_words(F.col("text")))
    assert "Exchange" not in plan(near)
    assert sorted(near.collect()) == sorted(features.field_word_overlap(docs, layout.document_words(df)).collect())


def test_regions_are_ranked_in_a_row(spark, tmp_path):
    docs = extract.extract_from_text(_texts(spark, tmp_path), keep=("text",))
    words = layout.document_words(docs)
    found = anomaly.suspicious_regions(words, docs)
    # Words and amounts aren't dealt to be ranked: none of the tables has more than a row a document.
    assert "Window" not in plan(found)
    in_row = docs.join(features.document_offers(words, anomaly.STRONG), "doc_id", "left").withColumn("words", layout.text_words(F.col("text"))).select("doc_id", anomaly.regions_of(False, False).alias("regions"))
    want = {r.doc_id: [tuple(b) for b in r.regions] for r in in_row.collect() if r.regions}
    assert {r.doc_id: [tuple(b) for b in r.regions] for r in found.collect()} == want and set(want) == {1} and len(want[1]) == 4
