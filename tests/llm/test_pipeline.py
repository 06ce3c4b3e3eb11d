"""The pipeline: each stage against brute force over what the one before kept."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from quillstone.llm.common import tokenizer_path
from quillstone.llm.pieces import library
from tests.llm.test_llm import brute_components


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r, path = random.Random(1), str(tmp_path_factory.mktemp("sf"))
    words = [f"{a}{b}" for a in ("lo", "mi", "ka", "re", "tu", "so") for b in ("ra", "ne", "li", "vo", "du")]
    rows = []
    for i in range(150):
        t = " ".join(r.choice(words) for _ in range(r.randint(20, 60))) if i % 8 else " ".join(r.choice(["$$$", "!!AAA!!", "%%%"]) for _ in range(40))
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    for i in range(150, 190):
        t = rows[r.randrange(150)][1] if i % 2 else rows[r.randrange(1, 150)][1] + " end"
        rows.append((i, t, "en", "s0", len(t)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("$" not in rows[i][1] and "%" not in rows[i][1]), 0) for i in range(0, 150, 2)] + [(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), "stage")
        kept[name] = docs.collect()
        assert docs.columns == columns or name == "tokens"
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    clean = {r.doc_id for r in whole if "%%" not in r.text and "$$" not in r.text and "!!" not in r.text}
    assert {r.doc_id for r in kept["quality"]} == clean
    last = {}
    for r in kept["quality"]:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert Counter(r.doc_id for r in kept["exact_copies"]) == Counter(last.values())
    before = sorted(kept["exact_copies"], key=lambda r: r.doc_id)
    _, roots = brute_components([r.text for r in before], 5, 80)
    assert {r.doc_id for r in kept["near_copies"]} == {before[i].doc_id for i in set(roots)}
    size, taken, weights = Counter(), Counter(), {}
    for r in kept["near_copies"]:
        size[r.source] += len(r.text.split())
    for r in kept["mixture"]:
        taken[r.source] += len(r.text.split())
    for i, s in enumerate(sorted(size)):
        weights[s] = (5, 2, 1)[i % 3]
    assert sum(taken.values()) == pytest.approx(sum(size.values()), abs=2 * len(size))
    assert all(taken[s] <= 3 * size[s] for s in size)
    tokenizer, text = library(tokenizer_path("word_bpe_49k.json")), {r.doc_id: r.text for r in whole}
    assert Counter(r.doc_id for r in kept["tokens"]) == Counter(r.doc_id for r in kept["mixture"])
    for r in kept["tokens"][:40]:
        ids = tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), "again")
    assert Counter((r.doc_id, r.source, r.ids_sha256, r.decoded_sha256) for r in rows.collect()) == Counter((r.doc_id, r.source, r.ids_sha256, r.decoded_sha256) for r in docs.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `__k` int, `at` long, `key` string, kept boolean, `a.b` int"


def odd_rows():
    r = random.Random(7)
    words = [f"{a}{b}" for a in ("lo", "mi", "ka", "re") for b in ("ra", "ne", "li")]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    long, some = make(50_000), make(30)
    values = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, long), (6, long + " end"), (7, some), (7, some), (7, make(25)), (None, some), (None, make(20)), (None, None), (8, some + " x"), (9, "É\x00 " * 9), (10, "word"), (11, "word")]
    return [(i, t, None if k % 3 else "en", ("a", None, "b")[k % 3], None, "r", k, 5, "q", True, k) for k, (i, t) in enumerate(values)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls in any column, empty and very long texts, repeated ids and rows, names that clash: each stage by itself against brute force."""
    given, stages = odd_rows(), dict(corpus_pipeline.STAGES)
    spark.createDataFrame([(7, 1, 0), (5, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {name: stage(spark, odd, str(tmp_path)) for name, stage in stages.items()}
    rows = {name: df.collect() for name, df in out.items()}
    assert all(out[name].columns == odd.columns for name in list(stages)[:-1])
    at = lambda name: Counter(x["a.b"] for x in rows[name])
    assert all(tuple(x) == given[x["a.b"]] for name in list(stages)[:-1] for x in rows[name])
    # Labels of one kind: all texts with an n-gram, which takes two bytes, stay.
    assert at("quality") == Counter(k for k, x in enumerate(given) if len((x[1] or "").encode()) > 1)
    best = {}
    for x in given:
        best.setdefault(x[1] or "", []).append(x[0])
    kept = Counter(x["text"] or "" for x in rows["exact_copies"])
    assert kept == dict.fromkeys(best, 1)
    assert all(x["doc_id"] == max((i for i in best[x["text"] or ""] if i is not None), default=None) for x in rows["exact_copies"])
    sizes, roots = brute_components([x[1] for x in given], 5, 80)
    wordless = [k for k, n in enumerate(sizes) if not n]
    assert Counter(roots[k] for k in at("near_copies").elements() if sizes[k]) == Counter({c for k, c in enumerate(roots) if sizes[k]})
    assert all(at("near_copies")[k] == 1 for k in wordless)
    size = lambda x: len((x[1] or "").split())
    words = {s: sum(size(x) for x in given if x[3] == s) for s in ("a", "b", None)}
    taken = {s: sum(size(given[k]) * n for k, n in at("mixture").items() if given[k][3] == s) for s in words}
    assert all(taken[s] <= 3 * words[s] for s in words) and all(n <= 3 for n in at("mixture").values())
    tokenizer = library(tokenizer_path("word_bpe_49k.json"))
    want = Counter((x[0], x[3], tuple(tokenizer.encode(x[1] or "", add_special_tokens=False).ids)) for x in given)
    assert Counter((x.doc_id, x.source, tuple(x.ids)) for x in rows["tokens"]) == want


def test_stages_on_an_empty_table(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd.limit(0), str(tmp_path))
        assert out.collect() == [] and (name == "tokens" or out.columns == odd.columns)
