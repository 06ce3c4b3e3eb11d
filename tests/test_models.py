import random

import pytest
from pyspark.sql import functions as F

from quillstone import config as C
from quillstone.operators import models, review
from quillstone.operators.training import training_stats
from quillstone.sources import manifests

WORD = "doc_id string, page_index int, ord int, text string, left int, top int, width int, height int, confidence double, block_num int, paragraph_num int, line_num int"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    rows = []
    for i in range(8):
        total, forged = 10 + 7 * i, i % 2
        shown = total + (900 if forged else 0)
        rows.append((f"d{i:02}", f"Bright Market\nDate: 2024-01-{1 + i:02}\nSubtotal {total}.00\nTOTAL {shown}.00\n{r.random()}", "Bright Market", f"2024-01-{1 + i:02}", forged))
    return spark.createDataFrame(rows, "doc_id string, text string, true_vendor string, true_date string, is_forged int")


SMALL = C.Settings(trees=1)


def test_train_save_load_predict(spark, docs, tmp_path):
    bundle = models.train(docs, settings=SMALL)
    assert bundle.model_type == "GBTClassificationModel" and bundle.forged_ratio == 0.5
    assert bundle.train_accuracy >= 0.9 and 0 <= bundle.validation_accuracy <= 1
    models.save(bundle, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    assert (again.threshold, again.train_accuracy, again.model_type) == (bundle.threshold, bundle.train_accuracy, bundle.model_type)
    first, second = (sorted(models.predict(b, docs).collect()) for b in (bundle, again))
    assert first == second and len(first) == 8 and first[3].vendor == "Bright Market" and first[3].date == "2024-01-04"
    assert models.load(spark, str(tmp_path / "nothing")) is None


def test_too_few_rows_leave_the_rules(spark, docs, tmp_path):
    bundle = models.train(docs.filter("is_forged = 0"), settings=SMALL)
    assert bundle.model is None and bundle.model_type == "heuristic" and bundle.threshold == SMALL.threshold
    models.save(bundle, str(tmp_path / "m"))
    assert models.load(spark, str(tmp_path / "m")).model is None and {x.is_forged for x in models.predict(bundle, docs).collect()} <= {0, 1}


def test_predict_manifest(spark, docs, tmp_path):
    given = spark.createDataFrame([("Bright Market", "Bright Market", "2024-01-02", 20.0), ("Shop", "Shop", "2024-01-03", 30.0)], "vendor string, true_vendor string, true_date string, amount double")
    bundle = models.Bundle(training_stats(given))
    words = [("a", 0, i, t, x, y, 40, 10, 90.0, 1, 1, n) for i, (t, x, y, n) in enumerate([("Bright", 10, 5, 1), ("Market", 55, 5, 1), ("Date:", 10, 20, 2), ("2024-01-24", 50, 20, 2), ("TOTAL", 10, 35, 3), ("45.60", 60, 35, 3)])]
    records = spark.createDataFrame([(1, "b", "b.png"), (0, "a", "a.png")], "ordinal int, id string, image_path string")
    out = models.predict_manifest(bundle, records, spark.createDataFrame(words, WORD))
    manifests.write_predictions(out, str(tmp_path / "p"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "p")).collect()]
    assert lines[0].startswith('{"id":"a","vendor":"Bright Market","date":"2024-01-24","total":"45.60"') and lines[1].startswith('{"id":"b","vendor":null,"date":null,"total":null')
    assert models.null_baseline(records).filter("vendor is null and is_forged = 0").count() == 2


def test_numbered_lines(spark, tmp_path):
    from quillstone.operators.evaluate import prediction_problems

    (tmp_path / "p.jsonl").write_text('{"id": "a", "is_forged": 0, "vendor": null, "date": null, "total": null}\n\n[1]\nnot json\n7\n' + '{"id": "x"}\n' * 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = manifests.read_numbered_lines(spark, str(tmp_path / "p.jsonl"))
        got = {x.line_no: x for x in prediction_problems(lines).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == [1, *range(3, 3006)] and got[1].problems == []
    assert got[3].problems == ["line 3: row must be an object"] and got[4].problems == ["line 4: not valid JSON"] and got[5].problems == ["line 5: row must be an object"]


def test_pages_of_records(spark, tmp_path):
    records = spark.createDataFrame([("a", "img/a.png"), ("b", "img/none.png")], "id string, image_path string")
    pages = spark.createDataFrame([(f"file://{tmp_path}/img/a.png", 0, "i"), ("file:///x/a.png", 0, "j")], "path string, page_index int, image string")
    assert [tuple(x) for x in manifests.pages_of_records(records, pages, str(tmp_path)).collect()] == [("a", 0, "i")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.txt").write_text('{"company": "ACME", "date": "01/02/2018",\n "address": "x", "total": "1,234.50"}')
    assert [(x.company, x.total) for x in manifests.read_entities(spark, str(tmp_path / "e")).collect()] == [("ACME", 1234.5)]


def test_synthetic_counts(spark, tmp_path):
    from quillstone.sources.views import synthetic_receipts

    got = manifests.write_synthetic(synthetic_receipts(spark, 40), str(tmp_path / "s"))
    assert {x.is_forged: x.n for x in got.collect()} == {0: 30, 1: 10} and spark.read.json(str(tmp_path / "s")).count() == 40


def test_review(spark):
    pages = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "doc_id string, page_index int")
    assert sorted((x.doc_id, x.page_index) for x in review.page_or_first(pages, F.lit(1)).collect()) == [("a", 1), ("b", 0)]
    one = spark.range(1)
    assert [one.select(review.clamped_page(F.lit(p), F.lit(2)).alias("p")).first().p for p in (-1, 0, 5)] == [0, 0, 1]
    texts = {"2018-03-01": 2018, "25/12/2017": 2017, "3 4 19": 2019, "May": None, "2018": 2018, "1 345": None, "": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", review.year_of_date(F.col("t")).alias("y")).collect()
    assert {x.t: x.y for x in got} == texts
    assert one.select(review.clean_generated(F.lit(" a \n\t b ")).alias("c")).first().c == "a b"


def test_vendor_of_words(spark):
    rows = [("a", 0, 0, "12.50", 0, 0, 9, 9, 9.0, 1, 1, 1), ("a", 0, 1, "Store", 50, 20, 9, 9, 9.0, 1, 1, 2), ("a", 0, 2, "Corner", 0, 20, 9, 9, 9.0, 1, 1, 2), ("a", 1, 3, "Late", 90, 5, 9, 9, 9.0, 1, 1, 2), ("b", 0, 0, "12", 0, 0, 9, 9, 9.0, None, None, None)]
    words = spark.createDataFrame(rows, WORD)
    # Lines are told apart without their page, as the rule has it.
    assert [tuple(x) for x in review.vendor_of_words(words).collect()] == [("a", "Corner Store Late")]
    docs = spark.createDataFrame([("a", "x"), ("b", "Grand Shop\n1"), ("c", None)], "doc_id string, text string")
    assert {x.doc_id: x.vendor for x in review.simple_vendor_of(docs, words).collect()} == {"a": "Corner Store Late", "b": "Grand Shop", "c": None}


def test_overlays_by_page(spark):
    field = "struct<value:string,confidence:double,box:struct<left:int,top:int,right:int,bottom:int,page:int>,raw_value:string>"
    fields = spark.createDataFrame([("a", ("V", 0.9, (0, 0, 1, 1, 0), "V"), (None, 0.0, None, None), ("1.00", 0.5, (2, 2, 3, 3, 1), "1"))], f"doc_id string, vendor {field}, date {field}, total {field}")
    regions = spark.createDataFrame([("a", [(5, 5, 6, 6, 1)])], "doc_id string, regions array<struct<left:int,top:int,right:int,bottom:int,page:int>>")
    assert sorted(x.label for x in review.overlays(fields, regions, 1).collect()) == ["suspicious", "total: 1.00"]
    assert review.overlays(fields, regions).count() == 3
