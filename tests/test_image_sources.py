"""Image features, error levels, manifests and sinks."""

import json
import struct
import zlib

import numpy as np
import pytest

from quillstone.operators import image
from quillstone.sources import manifests
from quillstone.sources.views import synthetic_receipts


def png(path, pixels):
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_constant_image_has_no_error_levels():
    rgb = np.full((48, 48, 3), 100.0)
    assert image.error_levels(rgb).max() <= 1
    f = image.base_features(rgb)
    assert (f["img_mean"], f["img_std"], f["entropy"], f["noise_std"], f["aspect_ratio"], f["total_pixels"]) == (100.0, 0.0, 0.0, 0.0, 1.0, 2304.0)


def test_noise_raises_error_levels():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (64, 64, 3)).astype(float)
    assert image.ela_features(image.error_levels(rgb))["ela_mean"] > 3
    assert image.edges(image.luma(rgb)).mean() > 20
    assert image.prepare_for_ocr(rgb).shape[1] == 300


def test_pages_from_files(spark, tmp_path):
    png(tmp_path / "a.png", np.full((32, 32, 3), 255))
    (tmp_path / "b.png").write_bytes(b"not an image")
    pages = manifests.read_images(spark, str(tmp_path)).selectExpr("path as doc_id", "page_index", "image")
    got = {r.doc_id[-5:]: r for r in image.page_features(pages).collect()}
    assert got["a.png"].img_mean == 255.0 and got["b.png"].img_mean == 0.0 and got["b.png"].width == 0
    names = manifests.manifest_of_files(spark, str(tmp_path), ("png",)).collect()
    assert [(r.id, r.image_path) for r in names] == [("a", "a.png"), ("b", "b.png")]
    with pytest.raises(RuntimeError):
        manifests.read_pdf_pages(spark, str(tmp_path))


def test_manifest_and_predictions(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text(json.dumps({"id": "a", "image_path": "a.png", "fields": {"vendor": " "}, "label": {"is_forged": 3}}) + "\n\n")
    row = manifests.read_records(spark, str(tmp_path), "train").first()
    assert row.fields.vendor is None and list(row.problems) == ["is_forged is not 0 or 1"]
    df = spark.createDataFrame([(1, "b", None, None, None, 0), (0, "a", "v", None, "1.00", 1)], "ordinal int, id string, vendor string, date string, total string, is_forged int")
    manifests.write_predictions(df, str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [{"id": "a", "vendor": "v", "date": None, "total": "1.00", "is_forged": 1}, {"id": "b", "vendor": None, "date": None, "total": None, "is_forged": 0}]
    labels = spark.createDataFrame([(1, "a", 0), (2, "a", 1)], "line_no int, id string, is_forged int")
    assert manifests.last_labels(labels).first().is_forged == 1


def test_synthetic(spark):
    rows = synthetic_receipts(spark, 200, 0.25).collect()
    assert sum(r.label.is_forged for r in rows) == 50 and {r.id for r in rows} == {f"syn{i:04d}" for i in range(200)}
    assert all(1.5 <= float(r.total) <= 150 for r in rows if not r.label.is_forged)
