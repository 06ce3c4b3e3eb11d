"""From folders of images to predictions, plug-ins, ordered files, vendors in texts, percentiles."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone import config as C
from quillstone.functions.quantiles import percentiles
from quillstone.operators import models, pipeline, plugins, search, training
from quillstone.sources import manifests
from tests.test_image_sources import png

LINES = [["Bright", "Market"], ["Date:", "2024-01-{d:02}"], ["TOTAL", "{t}.60"]]


def engine(gray):
    """Reads the number of a receipt from the height of its image, which is five times as large when it comes here; low images fail."""
    n = gray.shape[0] // 5 - 40
    if n < 0:
        raise ValueError("too low")
    out = {k: [] for k in ("text", "left", "top", "width", "height", "conf", "line_num", "block_num", "par_num")}
    for i, line in enumerate(LINES):
        for j, word in enumerate(line):
            for k, v in zip(out, (word.format(d=1 + n, t=40 + n), 10 + 60 * j, 5 + 15 * i, 45, 10, 90, i + 1, 1, 1), strict=True):
                out[k].append(v)
    return out


@pytest.fixture
def folder(tmp_path):
    rows = []
    for i in range(8):
        png(tmp_path / f"r{i}.png", np.full((40 + i, 60, 3), 40 + 20 * i))
        rows.append({"id": f"r{i}", "image_path": f"r{i}.png", "fields": {"vendor": "Bright Market", "date": "2024-01-02", "total": f"{100 + i}.00"}, "label": {"is_forged": i % 2}})
    png(tmp_path / "low.png", np.zeros((20, 60, 3)))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    order = [6, 2, 7, 0, 1, 3, 5, 4]
    (tmp_path / "train.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    tests = [{"id": rows[i]["id"], "image_path": rows[i]["image_path"]} for i in order] + [{"id": x, "image_path": f"{x}.png"} for x in ("low", "broken", "absent")]
    (tmp_path / "test.jsonl").write_text("\n".join(json.dumps(r) for r in tests) + "\n")
    return tmp_path, [r["id"] for r in tests]


def test_folder_to_predictions(spark, folder):
    path, ids = folder
    bundle = pipeline.train_folder(spark, str(path), engine, settings=C.Settings(trees=1))
    assert bundle.stats.numbers.first().amount_min == 100.0 and bundle.model_type == "GBTClassificationModel"
    outs = []
    for k in (0, 1):
        pipeline.predict_folder(spark, bundle, str(path), str(path / f"out{k}"), engine)
        outs.append([x for f in sorted((path / f"out{k}").glob("part-*")) for x in f.read_text().splitlines()])
    assert outs[0] == outs[1]
    rows = [json.loads(x) for x in outs[0]]
    assert [r["id"] for r in rows] == ids
    by = {r["id"]: r for r in rows}
    assert by["r3"]["vendor"] == "Bright Market" and by["r3"]["date"].startswith("2024-01-0") and by["r3"]["total"].endswith(".60")
    assert all(by[x][f] is None for x in ("low", "broken", "absent") for f in C.FIELDS) and all(r["is_forged"] in (0, 1) for r in rows)
    records, pages = pipeline.read_documents(spark, str(path), "test.jsonl")
    problems = {r.doc_id: r.problem for r in manifests.ocr_words(pages, engine, pipeline.prepared).collect()}
    assert problems["low"] == "ValueError: too low" and problems["broken"] and problems["r3"] is None and "absent" not in problems
    found = {r.doc_id: r for r in pipeline.analyze(records, pages, engine, models.Bundle(bundle.stats)).collect()}
    assert found["r3"].page_count == 1 and found["absent"].page_count == 0 and found["absent"].regions == [] and found["r3"].total_pixels == 43 * 60


def test_pdf_without_rasteriser_is_an_error(spark, tmp_path):
    png(tmp_path / "a.png", np.full((8, 8, 3), 9))
    assert manifests.load_pages(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.PDF").write_bytes(b"%PDF")
    with pytest.raises(RuntimeError, match="rasteriser"):
        manifests.load_pages(spark, str(tmp_path))
    pages = manifests.load_pages(spark, str(tmp_path), lambda data, dpi: [(2, 3, bytes([7]) * 18)] * 2)
    assert sorted((r.path[-5:], r.page_index) for r in pages.collect()) == [("a.png", 0), ("b.PDF", 0), ("b.PDF", 1)]


def test_predictions_in_many_files(spark, tmp_path):
    order = list(range(95))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(i, f"d{i}", None, None, None, i % 2) for i in order], "ordinal long, id string, vendor string, date string, total string, is_forged int").repartition(4)
    manifests.write_predictions(df, str(tmp_path / "p"), 20)
    files = sorted((tmp_path / "p").glob("part-*"))
    assert len(files) == 5 and [json.loads(x)["id"] for f in files for x in f.read_text().splitlines()] == [f"d{i}" for i in range(95)]
    lines = manifests.read_ordered_records(spark, str(_records(tmp_path)))
    assert [(r.ordinal, r.id) for r in lines.orderBy("ordinal").collect()] == [(1, "x"), (3, "y")]


def _records(path):
    (path / "m.jsonl").write_text('{"id": "x", "image_path": "x.png"}\n\n{"id": "y", "image_path": "y.png"}\n')
    return path / "m.jsonl"


def test_plugins(spark, tmp_path):
    (tmp_path / "null.py").write_text("def predict(records):\n    for r in records:\n        yield {'id': r['id'], 'is_forged': 0}\n")
    (tmp_path / "other.py").write_text("N = 3\n\ndef predict(records):\n    for r in records:\n        yield {'id': r['id'], 'vendor': r['image_path'].upper(), 'total': N, 'is_forged': 1 if r['id'] < 'b' else True}\n")
    (tmp_path / "bad.py").write_text("x = 1\n")
    records = spark.createDataFrame([("a", "p"), ("b", "q")], "id string, image_path string")
    null = plugins.run_solution(records, plugins.read_solution(spark, str(tmp_path / "null.py")))
    assert sorted(map(tuple, null.drop("problem").collect())) == sorted(map(tuple, models.null_baseline(records).collect()))
    other = {r.id: tuple(r)[1:] for r in plugins.run_solution(records, plugins.read_solution(spark, str(tmp_path / "other.py"))).collect()}
    assert other == {"a": ("P", None, "3", 1, None), "b": ("Q", None, "3", 0, "is_forged is not 0 or 1")}
    with pytest.raises(ValueError, match="predict"):
        plugins.loaded((tmp_path / "bad.py").read_text())


@pytest.mark.parametrize("shard", [1, 3, 100_000])
def test_texts_with_any(spark, shard):
    r = random.Random(shard)
    patterns = ["ab", "b a", "ccc", "é", "abcabc", "z" * 50, None, "", "ab"]
    texts = [(i, r.choice([None, "".join(r.choice("abc é") for _ in range(r.randint(0, 12)))]), r.choice([None, "ccc", "x"])) for i in range(80)] + [(900, "z" * 400, None), (-1, "", "")]
    got = search.with_any(spark.createDataFrame(texts, "at long, text string, exact string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), shard).collect()
    known = {p for p in patterns if p}
    assert sorted(x.at for x in got) == sorted(i for i, t, e in texts if e in known or any(p in (t or "") for p in known))
    assert search.with_any(spark.createDataFrame(texts, "at long, text string, exact string"), spark.createDataFrame([], "pattern string"), shard).count() == 0
    named = spark.createDataFrame([(f"d{i}", t, e) for i, t, e in texts], "at string, text string, exact string")
    assert sorted(x.at for x in search.with_any(named, spark.createDataFrame([(p,) for p in patterns], "pattern string"), shard).collect()) == sorted(f"d{x.at}" for x in got)


def test_percentiles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(1e6, 3, 300), [1e-300, -1e300, 7.0, 7.0, 7.0], rng.integers(0, 3, 200), [np.nextafter(7.0, 8)]])
    counts = spark.createDataFrame([(float(v),) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n")).cache()
    fractions = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = percentiles(counts, len(values), float(values.min()), float(values.max()), fractions)
    assert got == pytest.approx(np.percentile(values, [100 * p for p in fractions]).tolist(), rel=1e-12)
    counts.unpersist()


def test_amounts_are_the_true_totals(spark):
    rows = [("A", "A", "2024-01-01", 1.0, 10.0), ("A", None, None, 2.0, None), ("B", None, None, 4.0, 30.0)]
    schema = "vendor string, true_vendor string, true_date string, amount double, true_amount double"
    s = training.training_stats(spark.createDataFrame(rows, schema)).numbers.first()
    assert tuple(s) == (2, 20.0, 10.0, 15.0, 25.0, 10.0, 30.0)
    s = training.training_stats(spark.createDataFrame(rows, schema).withColumn("true_amount", F.lit(None).cast("double"))).numbers.first()
    assert (s.n_amounts, s.amount_mean, s.amount_min, s.amount_max) == (3, pytest.approx(7 / 3), 0.0, 0.0)
    s = training.training_stats(spark.createDataFrame([], schema))
    assert tuple(s.numbers.first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) and s.vendors.count() == 0
    text = json.loads(manifests.stats_json(training.training_stats(spark.createDataFrame(rows, schema))).first().value)
    assert text["vendors"] == ["A", "B"] and text["known_vendors"] == ["a"] and text["vendor_frequencies"] == {"A": 1} and text["amount_q1"] == 15.0


def test_training_reads_true_totals(spark):
    docs = [(f"d{i}", f"Shop\nTOTAL {10 + i}.00", "Shop", "2024-01-01", f"{1000 + i}.00" if i < 3 else None, i % 2) for i in range(8)]
    schema = "doc_id string, text string, true_vendor string, true_date string, true_total string, is_forged int"
    bundle = models.train(spark.createDataFrame(docs, schema), settings=C.Settings(trees=1))
    assert (bundle.stats.numbers.first().amount_min, bundle.stats.numbers.first().amount_mean) == (1000.0, 1001.0)
    rows = spark.createDataFrame([(1, zlib.crc32(b"x") * 1.0)], "doc_id long, amount double")
    from quillstone.operators import features

    full = rows.select("doc_id", *[F.lit(1.0).alias(c) for c in features.VECTOR if c != "amount"], "amount")
    got = models.scored_without_words(bundle, full).first()
    assert 0 <= got.score <= 1 and got.reasons == [C.MODEL_REASON] and got.vector[features.VECTOR.index("img_mean")] == 0.0
