"""The training-data operators against brute force, the libraries, and exact round trips; odd tables for each."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm.common import few_bytes, tokenizer_path

ODD = ["", None, " ", "\n", "a  b", "a\n\nb\n\n\nc d", "  x", "x  ", "\x00a b", "don't  we'll", "<|endoftext|>foo <|endoftext|> bar", "ΣΑΣ İstanbul Éé", "日本語 テスト 12", "a" * 900, "emoji 🙂 </w> x</w>y", "\nfoo", "▁x ▁"]
SCHEMA = "doc_id long, text string, source string, row string, kept boolean, size long, digest string, `a.b` int"


def texts(n=40, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "and", "Alpha", "beta,", "gamma.", "delta", "é", "x1", "zeta"]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(n)]


def table(spark, values, sources=None):
    """Documents with other columns whose names operators use themselves; ids are 3 apart."""
    rows = [(3 * i, t, (sources or ["a", "b", None])[i % 3], "r", True, 1, "d", i) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, a row that repeats, ties and copies."""
    base = table(spark, ODD + texts(6) + texts(2))
    more = spark.createDataFrame([(None, "alone", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (6, " ", "a", "r", True, 1, "d", 2), (6, " ", "a", "r", True, 1, "d", 2)], SCHEMA)
    return base.unionByName(more).cache()


# 9: exact dedup


def test_exact_dedup(spark, empty, odd):
    from quillstone.llm.exact_dedup import exact_dedup, keep_one

    rows = exact_dedup(odd).select("row.doc_id", "row.text", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups = {}
    for r in odd.collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    assert len(rows) == odd.count()
    for r in rows:
        ids = groups[r.text or ""]
        known = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (max(known) if known else None, len(ids))
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert Counter(r.text or "" for r in rows if r.kept) == Counter(dict.fromkeys(groups, 1))
    kept = keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup(empty).count() == 0


# 3: two-pass shuffle


def test_two_pass_shuffle(spark, empty, odd):
    from quillstone.llm.shards import two_pass_shuffle

    many = table(spark, texts(203))
    for docs, shards in ((odd, 5), (many, 300)):
        rows = two_pass_shuffle(docs, shards, bucket_bytes=2000).select("row.doc_id", "row.text", "size", "shard", "slot").collect()
        slots = {}
        for r in rows:
            assert r.size == len((r.text or "").encode()) + 8
            slots.setdefault(r.shard, []).append(r.slot)
        assert len(rows) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(s, [])) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
    order = [r.doc_id for r in sorted(two_pass_shuffle(many, 24).select("row.doc_id", "shard", "slot").collect(), key=lambda r: (r.shard, r.slot))]
    again = [r.doc_id for r in sorted(two_pass_shuffle(many.repartition(3), 24).select("row.doc_id", "shard", "slot").collect(), key=lambda r: (r.shard, r.slot))]
    other = [r.doc_id for r in sorted(two_pass_shuffle(many, 24, seed=7).select("row.doc_id", "shard", "slot").collect(), key=lambda r: (r.shard, r.slot))]
    assert order == again != other and order != sorted(order)
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.25
    assert two_pass_shuffle(empty).count() == 0


def test_write_shards(spark, tmp_path):
    from quillstone.llm.shards import write_shards

    docs = table(spark, texts(30))
    write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("shard").count().count() == 4 and back.select("row.*").exceptAll(docs).count() == 0


# 10: mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, heavy = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = {s: most * sizes[s] for s in free if left * weight[s] / heavy > most * sizes[s]}
        if not over:
            return fixed | {s: left * weight[s] / heavy for s in free}
        fixed |= over


def test_mix(spark, empty, odd):
    from quillstone.llm.mixture import mix, mixed

    docs = table(spark, texts(240), ["big"] * 2 + ["small"]).withColumn("source", F.when(F.col("doc_id") % 30 == 0, None).when(F.col("doc_id") % 51 == 0, "zz").otherwise(F.col("source")))
    rows = mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = Counter()
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        sizes[r.source] += r.size
    want, taken = brute_targets(sizes), Counter()
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)
    assert sorted(rows) == sorted(mix(docs.repartition(5)).join(docs.select("doc_id", "source", "text"), "doc_id").collect())
    assert mixed(docs).columns == docs.columns and mixed(docs).count() == sum(r.copies for r in rows)
    assert mix(odd).count() == odd.count() and mix(empty).count() == 0


def test_subset_sum():
    from quillstone.llm.mixture import fit

    r = random.Random(4)
    for _ in range(200):
        counts = {r.randint(0, 40): r.randint(1, 9) for _ in range(r.randint(1, 6))}
        budget = r.randint(0, 300)
        take = fit(counts, budget)
        assert all(0 <= c <= counts[n] for n, c in take.items())
        got, total = sum(n * c for n, c in take.items()), sum(n * c for n, c in counts.items())
        assert got <= max(budget, 0) and (budget < total or got == total)
        sums = {0}
        for n, c in counts.items():
            sums = {x + n * k for x in sums for k in range(c + 1) if x + n * k <= budget}
        assert got == max(sums)  # the best sum that there is


def test_subset_sum_of_long_documents():
    from quillstone.llm.mixture import ROOM, fit

    long = {70_000 + i: 1 for i in range(20)}
    assert fit(long, 100_000) == dict.fromkeys(long, 0) | {70_019: 1}
    # Sums that only pairs and triples of long documents reach.
    assert sum(n * c for n, c in fit({90_001: 3, 150_007: 2, 400_000: 1}, 240_008).items()) == 240_008
    r = random.Random(9)
    for _ in range(50):
        counts = {r.randint(ROOM + 1, 300_000): r.randint(1, 3) for _ in range(r.randint(1, 12))}
        budget = r.randint(0, sum(n * c for n, c in counts.items()))
        take = fit(counts, budget)
        left = budget - sum(n * c for n, c in take.items())
        assert left >= 0 and all(0 <= c <= counts[n] for n, c in take.items())
        assert all(n > left or take.get(n, 0) == c for n, c in counts.items())


# 1, 6, 8: tokenizers


def test_id_files(spark, empty, odd, tmp_path):
    from quillstone.llm.idfiles import from_planes, pack, read_ids, to_planes, unpack, write_ids
    from quillstone.llm.pieces import library

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = library(path)
    for name, docs in (("odd", odd), ("more", table(spark, texts(90))), ("none", empty)):
        write_ids(docs, path, str(tmp_path / name))
        got = read_ids(spark, str(tmp_path / name)).collect()
        given = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
        got = sorted(got, key=lambda r: r.start)
        start = 0
        assert len(got) == len(given)
        for r, d in zip(got, given, strict=True):
            ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2]
            assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (d.doc_id, start, len(ids), ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
    block = np.random.default_rng(1).integers(0, 1 << 17, 64).astype(np.uint32)
    for bits in (1, 8):
        assert (from_planes(to_planes(block, 24 // bits, bits), bits, 64) == block).all()
        ids = np.arange(150_000, dtype=np.uint32)
        keys, sizes, back = unpack(pack([None, 5], np.array([7, 149_993]), ids, bits))
        assert keys == [None, 5] and sizes.tolist() == [7, 149_993] and (back == ids).all()


def test_batches_are_cut_by_bytes():
    texts = ["a" * 10, None, "", "b" * 5000, "c" * 900, "d" * 900, "é" * 600, ""] * 3
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    parts = list(few_bytes([batch], rows=7, size=2000))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or (p.num_rows <= 7 and p.nbytes <= 2000) for p in parts)
    assert any(p.num_rows > 1 for p in parts) and any(p.nbytes > 2000 for p in parts)
    assert not list(few_bytes([batch.slice(0, 0)]))


def test_a_full_cache_keeps_what_is_asked_for():
    from quillstone.llm.pieces import Cache

    worked = []
    cache = Cache(lambda pieces: [worked.append(p) or p.encode() for p in pieces], 20)
    for i in range(100):
        asked = ["often", f"rare {i}", "x" * 65]
        assert cache.of(asked) == [p.encode() for p in asked]
        assert len(cache.held) + len(cache.before) <= 20
    assert worked.count("often") == 1 and worked.count("x" * 65) == 100 and cache.of([]) == []


def test_pieces_encoded_together_are_as_alone():
    from quillstone.llm import pieces

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer, r = pieces.library(path), random.Random(9)
    assert pieces._cut_at_breaks(tokenizer) is not None and pieces._cut_at_breaks(pieces.library(tokenizer_path("word_bpe_49k.json"))) is None
    odd = ["", " ", "  ", "\n", "a\nb", "a b", "a ", " \u00a0x", "\u2028", "\t.", "e\u0301", "\u0301", "'s", "s", "<|endoftext|>", "<|endof", "text|>", "12", ".", "\U0001f600", "\x85", "\r", "\x00"]
    for n in (0, 1, 5, 64, 65, 200, 3000):
        texts = [r.choice(("", " ")) + "".join(r.choice("abest'.,12é中") for _ in range(r.randint(1, 9))) for _ in range(n)]
        for mixed in (texts, [r.choice(odd) if r.random() < 0.1 else t for t in texts], [r.choice(odd) for _ in texts]):
            want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in mixed]
            assert pieces.library_work(path)(mixed) == want


def test_id_files_are_encoded_in_parts(spark, tmp_path, monkeypatch):
    from quillstone.llm import idfiles

    seen, was = [], idfiles.few_bytes
    monkeypatch.setattr(idfiles, "few_bytes", lambda batches, rows, size: [seen.append((rows, size)), was(batches, rows, size)][1])
    whole = spark.createDataFrame([(0, "a")], "doc_id long, text string")

    class Stop(Exception):
        pass

    def run(self, f, schema):
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(40), pa.int64()), "text": ["word " * 100_000] * 40})
        monkeypatch.setattr(idfiles.TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": lambda s: 0})()))
        rows = list(f(iter([batch])))
        assert sum(b.column("n_docs")[0].as_py() for b in rows) == 40
        raise Stop

    monkeypatch.setattr(type(whole), "mapInArrow", run)
    with pytest.raises(Stop):
        idfiles.write_ids(whole, tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "x"))
    assert seen and seen[0][1] <= 8 << 20


def test_exact_merging_and_proposals_try_few_pairs_and_lengths():
    from quillstone.llm.bpe import END, LEAD, SHORT, SpeculativeBPE

    bpe, r = SpeculativeBPE(tokenizer_path("word_bpe_49k.json")), random.Random(5)

    def plain(word):
        ids = [bpe.by_form[c] for c in bpe._first(word)]
        while found := [(m, i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (m := bpe.merge.get(pair))]:
            (_, new), i = min(found)
            ids[i : i + 2] = [new]
        return ids

    words = ["".join(r.choice("aeinrstlo") for _ in range(r.randint(1, 2 * SHORT))) + END for _ in range(300)] + ["a" * n + END for n in range(1, 2 * SHORT)]
    assert [bpe.exact(w) for w in words] == [plain(w) for w in words] == bpe.encode_words(words)
    # No token is longer than its first characters say, and most leads have short tokens only.
    assert all(len(f) <= bpe.longest[f[:LEAD]] for f in bpe.by_form) and np.mean(list(bpe.longest.values())) < max(map(len, bpe.by_form)) / 2


def test_words_are_proposed_and_merged_together(monkeypatch):
    from quillstone.llm.bpe import END, SHORT, SpeculativeBPE, Table
    from quillstone.llm.pieces import library

    path = tokenizer_path("word_bpe_49k.json")
    bpe, tokenizer, r = SpeculativeBPE(path), library(path), random.Random(8)
    words = ["".join(r.choice("abcdehinorst") for _ in range(r.randint(1, SHORT))) + END for _ in range(2000)]
    wanted = [bpe.exact(w) for w in words]
    texts = ["Σas ΣΑΣ", "a\u0301", "\u0301b", "<|endoftext|>x<|startoftext|>", "x\n\ny <|endoftext|>", "", "\n", "it'S 12,5", "İı", "\x00\x01 \x0b\x85é", "ab" * 200, "<|endoftext|>"]
    one_by_one = []
    for name in ("exact", "propose"):
        whole = getattr(SpeculativeBPE, name)
        monkeypatch.setattr(SpeculativeBPE, name, lambda self, w, whole=whole: one_by_one.append(w) or whole(self, w))
    assert bpe.encode_words(words) == wanted and bpe.failed > 1000 and not one_by_one
    for some in (texts, texts[:3], texts[3:4], [], ["", ""]):
        assert [np.frombuffer(x, np.uint32).tolist() for x in bpe.encode_pieces(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert set(map(len, one_by_one)) == {401}
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000))
    table = Table(keys[::2], np.arange(len(keys[::2])))
    assert table.get(keys, -7).tolist() == [i // 2 if i % 2 == 0 else -7 for i in range(len(keys))]


def test_speculative_bpe(spark, empty, odd):
    from quillstone.llm.bpe import SpeculativeBPE, encode_decode
    from quillstone.llm.pieces import library

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = library(path)
    rows = encode_decode(odd, path, ("doc_id", "a.b", "text") if False else ("doc_id", "text"), with_ids=True).collect()
    assert len(rows) == odd.count() and encode_decode(empty, path).count() == 0
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    bpe, r = SpeculativeBPE(path), random.Random(3)
    words = ["".join(r.choice("abcdeinorst") for _ in range(r.randint(1, 14))) + "\x01" for _ in range(3000)] + ["a" * n + "\x01" for n in range(1, 60)]
    assert bpe.encode_words(words) == [bpe.exact(w) for w in words]
    assert 0 < bpe.failed < bpe.proposed


def test_viterbi_counts(spark, empty, odd):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from quillstone.llm.unigram_count import token_counts, vocabulary

    path = tokenizer_path("piece_bpe_32k.model")
    plain = [("<unk>", 0.0), *vocabulary(path), *((f"<0x{i:02X}>", 0.0) for i in range(256))]
    tokenizer = Tokenizer(models.Unigram(plain, 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for docs in (odd, table(spark, texts(60, 9))):
        want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
        assert Counter((r.doc_id, r.n_tokens) for r in token_counts(docs, path).collect()) == want
    assert token_counts(empty, path).count() == 0


def test_viterbi_counts_of_space_runs(spark, odd, tmp_path):
    """The registered query against the library without splits, where pieces of several spaces match."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    from quillstone.llm.queries import op8_viterbi_counts
    from quillstone.llm.unigram_count import vocabulary

    path = tokenizer_path("piece_bpe_32k.model")
    plain = [("<unk>", 0.0), *vocabulary(path), *((f"<0x{i:02X}>", 0.0) for i in range(256))]
    # Cuts before a run of spaces and around newlines cross no piece.
    assert not [w for w, _ in vocabulary(path) if re.search("[^▁]▁|\n", w)]
    tokenizer = Tokenizer(models.Unigram(plain, 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    r = random.Random(4)
    runs = ["a   b", "    indented\n        more", "a\n   \n b", "   ", "x" + " " * 41, "\n  a", "\x00  a   b", " ▁ ▁a"]
    runs += ["".join(r.choice(["one", "Tw", "é", "\n", " ", "  ", " " * 3, " " * 17]) for _ in range(40)) for _ in range(30)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(runs, 1000)), "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((d.doc_id, len(tokenizer.encode(d.text or "", add_special_tokens=False).ids)) for d in docs.collect())
    assert Counter((d.doc_id, d.n_tokens) for d in op8_viterbi_counts(spark, str(tmp_path)).collect()) == want


# 2: fingerprints


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, empty, odd):
    from quillstone.llm.oph import BINS, fingerprint, with_edits

    values = texts(40, 5)
    values += [v + " one two three" for v in values[:20]] + ["", None, "one", "one two", values[0]]
    docs = table(spark, values)
    rows = sorted(with_edits(docs).collect())
    full = [v or "" for v in values]
    errors = []
    for i, r in enumerate(rows):
        t, after = full[i], full[i - 1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (3 * i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint) == (BINS if t.strip() else 0)
        errors += [r.near_edited - alike(shingles(t, 5), shingles(edited, 5)), r.near_next - alike(shingles(t, 5), shingles(after, 5))]
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.08
    assert rows[0].fingerprint == rows[-1].fingerprint == {r.doc_id: r.fingerprint for r in fingerprint(docs).collect()}[0]
    assert with_edits(odd).count() == odd.count() and with_edits(empty).count() == 0
    one = with_edits(table(spark, ["only this one text here"])).first()
    assert one.near_next == 1.0


def test_fingerprints_shuffle_whole_texts_once(spark, monkeypatch):
    from quillstone.llm import oph

    plans, was = {}, oph.cut
    monkeypatch.setattr(oph, "cut", lambda df, name: [plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), was(df, name)][1])
    oph.with_edits(table(spark, texts(20, 3)))
    # Each use of the grouped texts has the same aggregates, so that their exchange is one.
    grouped = [line for line in plans["fingerprints"].split("\n") if "Aggregate" in line and "first(t" in line]
    assert len(grouped) >= 4 and all("count(1)" in line for line in grouped)


# 7: Jaccard join


def brute_components(values, n, like):
    sets = [shingles(re.sub("[A-Z]", lambda m: m.group().lower(), v or ""), n) for v in values]
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= like * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(values))]


def test_jaccard_components(spark, empty, odd):
    from quillstone.llm.ngram_join import jaccard_components, keep_first, prefix_size

    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(3, 60))] for _ in range(25)]
    values = []
    for b in base:
        for _ in range(r.randint(1, 8)):
            c = list(b)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                c[r.randrange(len(c))] = r.choice(words)
            values.append(" ".join(c))
    passage = " ".join(r.choice(words) for _ in range(30))
    values += [f"{passage} {' '.join(r.choice(words) for _ in range(k))}" for k in (0, 1, 2, 3, 4, 5, 20, 60)] + ["", None, "One", "one", "one two three", "W1 w2  w3\tw4"]
    sizes, roots = brute_components(values, 4, 85)
    got = sorted(jaccard_components(table(spark, values)).collect())
    assert [(g.n_shingles, g.component_id // 3) for g in got] == list(zip(sizes, roots, strict=True))
    _, roots = brute_components(values, 5, 80)
    kept = keep_first(table(spark, values))
    assert {x.doc_id // 3 for x in kept.collect()} == set(roots)
    assert kept.columns == odd.columns and jaccard_components(empty).count() == 0
    assert [prefix_size(n) for n in (1, 2, 10, 20)] == [1, 1, 2, 4]


def null_and_repeated_ids():
    """Near copies whose ids are null or repeat, among unrelated rows under the same ids: (id, text)."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    make = lambda: [r.choice(words) for _ in range(50)]
    rows = []
    for ids in ([5, None], [None, None, None], [7, 7], [7, 30, None], [40, 41, 42], [None], [None], [7], [5]):
        b = make()
        for j, i in enumerate(ids):
            rows.append((i, " ".join(b if not j else [*b[:-1], f"end{j}"])))
    rows += [(None, rows[2][1]), (7, rows[5][1]), (7, rows[5][1]), (None, None), (None, " "), (7, ""), (7, "")]
    return rows


def test_components_of_null_and_repeated_ids(spark):
    from quillstone.llm.ngram_join import jaccard_components

    rows = null_and_repeated_ids()
    sizes, roots = brute_components([t for _, t in rows], 4, 85)
    least = {c: min((i for (i, _), q in zip(rows, roots, strict=True) if q == c and i is not None), default=None) for c in roots}
    want = Counter((i, n, least[c]) for (i, _), n, c in zip(rows, sizes, roots, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_components(docs).collect())) == want


def test_keep_first_by_row(spark):
    from quillstone.llm.ngram_join import keep_first

    rows = null_and_repeated_ids()
    sizes, roots = brute_components([t for _, t in rows], 5, 80)
    kept = keep_first(spark.createDataFrame([(i, t, j) for j, (i, t) in enumerate(rows)], "doc_id long, text string, `a.b` int")).collect()
    assert Counter(roots[x["a.b"]] for x in kept) == Counter(set(roots))
    for x in kept:
        ids = [i for (i, _), c in zip(rows, roots, strict=True) if c == roots[x["a.b"]]]
        assert (x.doc_id, x.text) == rows[x["a.b"]] and x.doc_id == min((i for i in ids if i is not None), default=None)
    assert sum(not n for n in sizes) == sum(not (x.text or "").strip() for x in kept)


def test_components(spark):
    from quillstone.llm.components import components

    links = [(i, i + 1) for i in range(100, 160)] + [(200, 150), (7, 9), (9, 8), (5, 5), (None, 3)]
    want = dict.fromkeys([*range(100, 161), 200], 100) | dict.fromkeys([7, 8, 9], 7)
    for few in (0, 1000):
        got = sorted(components(spark.createDataFrame(links, "u long, v long").repartition(7), few).collect())
        assert [(r.id, r.root) for r in got] == sorted(want.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 5: repeats


def brute_removed(raws, length):
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("most", [2000, 1])
def test_remove_repeats(spark, empty, odd, most):
    from quillstone.llm.repeats import remove_repeats

    r = random.Random(6)
    letters = "abcdefghé \n"
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [make(r.randint(30, 150)) for _ in range(4)]
    values = ["".join(r.choice([make(r.randint(0, 60)), r.choice(passages)]) for _ in range(r.randint(1, 5))) for _ in range(30)]
    values += [values[0], values[0], "a" * 100, "ab" * 70, "a" * 41, "", None, "short"]
    gone = brute_removed([(v or "").encode() for v in values], 40)
    got = sorted(remove_repeats(table(spark, values), 40, 16, most, 3000, with_text=True).collect())
    for v, g, r_ in zip(values, gone, got, strict=True):
        raw = (v or "").encode()
        left = bytes(np.frombuffer(raw, np.uint8)[~g])
        runs = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        assert (r_.n_bytes, r_.n_removed, r_.n_spans, r_.kept_sha256, bytes(r_.kept)) == (len(raw), int(g.sum()), runs, hashlib.sha256(left).hexdigest(), left)
    if most > 1:
        assert remove_repeats(empty).count() == 0
    own = odd.select("doc_id", "text").collect()
    gone = brute_removed([(x.text or "").encode() for x in own], 40)
    want = Counter((x.doc_id, bytes(np.frombuffer((x.text or "").encode(), np.uint8)[~g])) for x, g in zip(own, gone, strict=True))
    assert Counter((x.doc_id, bytes(x.kept)) for x in remove_repeats(odd, 40, 16, most, 3000, with_text=True).collect()) == want


@pytest.mark.parametrize("most", [2000, 1])
def test_copies_of_a_row_are_named_once(spark, most):
    """What is known of a text doesn't grow with the number of rows that repeat it, with an id or without."""
    from quillstone.llm.repeats import remove_repeats, repeated_spans

    r = random.Random(11)
    body = "".join(r.choice("abcdefghij ") for _ in range(700))
    sizes = []
    for copies in (2, 200, 2000):
        rows = [(None, body)] * copies + [(5, body[:300])] * 3 + [(6, "x" + body[100:200]), (7, "lone " * 3), (8, "".join(r.choice("klmnopqrst") for _ in range(200)))]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        keyed = docs.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), "text")
        spans = repeated_spans(keyed, 40, 16, most, 3000).collect()
        assert len({(x.k, x.th) for x in spans}) == len(spans)
        sizes.append(sorted(len(x.spans) for x in spans))
        got = Counter((x.doc_id, x.n_bytes, x.n_removed) for x in remove_repeats(docs, 40, 16, most, 3000).collect())
        assert got == {(None, 700, 700): copies, (5, 300, 300): 3, (6, 101, 100): 1, (7, 15, 0): 1, (8, 200, 0): 1}
    assert sizes[0] == sizes[1] == sizes[2]


def test_run_length_index():
    from quillstone.llm.repeats import RunIndex, long_repeats, suffix_array

    r = random.Random(2)
    for _ in range(60):
        raw = np.array([r.choice([1, 2, 3]) for _ in range(r.randint(1, 60))], np.uint16)
        order = suffix_array(raw).tolist()
        assert order == sorted(range(len(raw)), key=lambda i: raw[i:].tolist())
        match = RunIndex(raw).matching()
        for i in range(len(raw)):
            best = max((next((k for k in range(len(raw)) if max(i, j) + k >= len(raw) or raw[i + k] != raw[j + k]), 0) for j in range(len(raw)) if j != i), default=0)
            assert match[i] == best
        index = RunIndex(raw)
        for _ in range(20):
            i, k = r.randrange(len(raw)), r.randint(1, 6)
            want = raw[i : i + k].tolist() if r.random() < 0.7 else [r.choice([1, 2, 3, 4]) for _ in range(k)]
            assert index.count(want) == sum(raw[j : j + len(want)].tolist() == want for j in range(len(raw) - len(want) + 1))
    pieces = [b"abcabc" * 40, b"abcabc" * 40 + b"d"]
    assert RunIndex(np.frombuffer(pieces[0], np.uint8).astype(np.uint16)).runs < 20
    assert all(x.all() for x in long_repeats(pieces, 100)[:1])


# 4: importance resampling


def test_resampling(spark, empty, odd):
    from quillstone.llm.resampling import best_cut, kept_documents, kth_largest, resample

    r = random.Random(5)
    good = [" ".join(r.choice(["the", "of", "people", "water", "and", "house"]) for _ in range(r.randint(5, 80))) for _ in range(300)]
    bad = [" ".join(r.choice(["$$$", "!!BUY!!", "%%%", "CLICK", "###"]) for _ in range(r.randint(5, 80))) for _ in range(60)]
    docs = table(spark, good + bad + ["", None])
    labels = spark.createDataFrame([(3 * i, int(i < 300), 0) for i in range(0, 360, 2)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rows = resample(docs, labels).select("row.doc_id", "log_weight", "key", "kept").collect()
    assert len(rows) == 362
    unseen = [x for x in rows if x.doc_id // 3 % 2 == 1 and x.log_weight is not None]
    assert np.mean([x.kept == (x.doc_id // 3 < 300) for x in unseen]) > 0.97
    keys = sorted((x.key for x in rows if x.key is not None), reverse=True)
    k = sum(x.kept for x in rows)
    assert {x.key for x in rows if x.kept} == set(keys[:k])
    assert kept_documents(docs, labels).columns == docs.columns
    few = spark.createDataFrame([(float(x),) for x in (5, 1, 5, 2, 2, 9)], "key double")
    assert [kth_largest(few, i) for i in range(7)] == [None, 9.0, 5.0, 5.0, 2.0, 2.0, 1.0]
    assert best_cut(np.array([0.0, 1, 5, 6]), np.array([False, False, True, True])) == 3.0
    assert resample(odd, labels).count() == odd.count() and resample(empty, labels).count() == 0
    # With one kind of label, or none, there is nothing to tell apart: all that have a weight stay.
    for own in (labels.filter("quality = 1"), labels.filter("quality = 0"), spark.createDataFrame([], "doc_id long, quality int")):
        assert Counter((x.kept, x.log_weight is None) for x in resample(docs, own).collect()) == {(True, False): 360, (False, True): 2}
    # A draw of half the documents by small weights: some that stay out are heavier than some that stay in.
    drawn = resample(docs, labels, k=180, scale=8.0).collect()
    assert sum(x.kept for x in drawn) == 180
    out, in_ = ([x.log_weight for x in drawn if x.log_weight is not None and x.kept == side] for side in (False, True))
    assert sum(w > np.median(in_) for w in out) > 3 and np.mean(in_) > np.mean(out)


def test_resampling_against_brute_force(spark, odd):
    """Counts, weights, noise and the chosen set computed a second time, and a draw that isn't the k heaviest."""
    from quillstone.llm import resampling as rs

    def grams(text):
        data = (text or "").encode()
        out = []
        for n in rs.GRAMS:
            for i in range(len(data) - n + 1):
                h = n
                for b in data[i : i + n]:
                    h = h * 257 + b & 0xFFFFFFFF
                out.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 15)
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            out.append((rs.WORDS_SEED + (c == b) + 2 * (c == a) + 4 * (b == a)) * 0x9E3779B1 % (1 << 32) >> 15)
        return out

    r = random.Random(15)
    values = [" ".join(r.choice(["the", "of", "people", "water", "and", "house"]) for _ in range(r.randint(1, 40))) for _ in range(200)] + ODD
    docs = table(spark, values)
    labels = spark.createDataFrame([(3 * i, int(i % 3 > 0), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    for v in values:
        assert sorted(rs.buckets_of(v).tolist()) == sorted(grams(v))
    half = {x.doc_id: x.half for x in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).alias("half")).collect()}
    raw, good = Counter(), Counter()
    for i, v in enumerate(values):
        raw.update(grams(v))
        if i < 200 and i % 2 == 0 and i % 3 and half[3 * i] == 0:
            good.update(grams(v))
    score = lambda c, b: np.log(c[b] + 1) - np.log(sum(c.values()) + rs.BUCKETS)
    weight = [rs.SCALE * np.mean([score(good, b) - score(raw, b) for b in g]) if (g := grams(v)) else None for v in values]
    rows = sorted(rs.resample(docs, labels, k=80).select("row.doc_id", "log_weight", "key", "kept").collect())
    for x, w in zip(rows, weight, strict=True):
        assert (x.log_weight is None) == (w is None) and (w is None or x.log_weight == pytest.approx(w, abs=1e-9))
    u = [((x.u % (1 << 64) >> 11) + 0.5) / (1 << 53) for x in docs.orderBy("doc_id").select(F.xxhash64(F.lit(42), "doc_id", "text").alias("u")).collect()]
    keys = [None if w is None else w - rs.TEMPERATURE * np.log(-np.log(v)) for w, v in zip(weight, u, strict=True)]
    last = sorted((k for k in keys if k is not None), reverse=True)[79]
    assert [x.kept for x in rows] == [k is not None and k >= last for k in keys]
    # The draw leaves out documents that weigh more than some that it takes; without noise it doesn't.
    assert max(x.log_weight for x in rows if x.log_weight is not None and not x.kept) > min(x.log_weight for x in rows if x.kept)
    plain = rs.resample(docs, labels, k=80, temperature=0).select("log_weight", "kept").collect()
    assert max(x.log_weight for x in plain if x.log_weight is not None and not x.kept) < min(x.log_weight for x in plain if x.kept)


def test_gumbel_draw_follows_the_weights(spark):
    """Of two texts of which one weighs log 3 more, it is drawn three times in four."""
    from quillstone.llm.resampling import gumbel_key

    pairs = spark.range(4000).select(F.col("id").alias("doc_id"), F.explode(F.array(F.struct(F.lit("a").alias("text"), F.lit(float(np.log(3))).alias("log_weight")), F.struct(F.lit("b").alias("text"), F.lit(0.0).alias("log_weight")))).alias("d")).select("doc_id", "d.*")
    won = pairs.withColumn("key", gumbel_key(1)).groupBy("doc_id").agg(F.max_by("text", "key").alias("text")).groupBy("text").count().collect()
    assert {x.text: x["count"] for x in won}["a"] / 4000 == pytest.approx(0.75, abs=0.03)


# Many equal rows, null ids and very long texts, in all operators that deal rows out


@pytest.fixture(scope="module")
def repeats(spark):
    """A third of the rows equal, a third with null ids, and one text longer than any block."""
    r = random.Random(21)
    rows = [(None, "the same words again and again in this row")] * 400 + [(None, f"text {i} of no id {r.random()}") for i in range(200)]
    rows += [(7, "seven " * 5)] * 100 + [(i, f"{t} {i}") for i, t in enumerate(texts(100, 3), 1000)]
    rows += [(5000, " ".join(str(r.random()) for _ in range(20_000))), (5001, "x" * 300_000)]
    r.shuffle(rows)
    return spark.createDataFrame([(i, t, "ab"[i is None], str(j)) for j, (i, t) in enumerate(rows)], "doc_id long, text string, source string, row string").repartition(6).cache()


def test_repeats_in_exact_dedup(repeats):
    from quillstone.llm.exact_dedup import exact_dedup

    for hot in (64, 1):
        rows = exact_dedup(repeats, hot=hot).select("row.doc_id", "row.text", "row.row", "keep_id", "group_size", "kept").collect()
        size = Counter(x.text for x in rows)
        assert Counter(x.row for x in rows) == Counter(str(j) for j in range(len(rows)))
        assert all(x.group_size == size[x.text] and x.keep_id == x.doc_id for x in rows)
        assert Counter(x.text for x in rows if x.kept) == Counter(dict.fromkeys(size, 1))


def test_repeats_in_shuffle(spark, repeats, tmp_path):
    from quillstone.llm.shards import read_shards, write_shards

    write_shards(repeats, str(tmp_path / "s"), 24, bucket_bytes=2000)
    rows = read_shards(spark, str(tmp_path / "s")).select("row.row", "row.text", "shard", "slot", "size").collect()
    assert Counter(x.row for x in rows) == Counter(str(j) for j in range(repeats.count()))
    shards = Counter(x.shard for x in rows)
    assert sorted(shards) == list(range(24)) and max(shards.values()) - min(shards.values()) <= 1
    assert all(sorted(x.slot for x in rows if x.shard == s) == list(range(n)) for s, n in shards.items())
    same = [x.shard for x in rows if x.text.startswith("the same")]
    # Copies that fit one bucket stay together; those that don't are all over the order.
    assert len(set(same)) >= 20 and max(Counter(same).values()) < 45
    write_shards(repeats.limit(0), str(tmp_path / "none"))
    assert read_shards(spark, str(tmp_path / "none")).select("row.doc_id", "size", "shard", "slot", "law", "grown_shard").count() == 0


def test_a_bucket_is_in_the_order_of_sparks_shuffle(spark):
    """The records of one bucket stand in the order that Spark's seeded shuffle() gives their hash order: nothing before or after it moves them."""
    from quillstone.llm.shards import two_pass_shuffle

    docs = table(spark, texts(30, 17))
    rows = sorted(two_pass_shuffle(docs, 1, 42, 1 << 30).select("shard", "slot", "row.doc_id").collect())
    hashed = [x.doc_id for x in sorted(docs.select(F.xxhash64(F.lit(42), "doc_id", "text").alias("h"), "doc_id").collect())]
    # The generator's seed is the given one and the number of the task.
    one = spark.createDataFrame([(hashed,)], "a array<long>").coalesce(1)
    assert [x.doc_id for x in rows] in [one.select(F.shuffle("a", 42 + p)).first()[0] for p in range(4)]
    assert [x.doc_id for x in rows] != hashed


def test_repeats_in_fingerprints(repeats):
    from quillstone.llm.oph import with_edits

    some = repeats.filter(F.length("text") < 5000)
    rows = some.select("doc_id", "text").collect()
    th = {x.text: x.h for x in some.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x.doc_id is None, -(x.doc_id or 0), th[x.text]))
    want = Counter()
    for x, y in zip(order, [*order[1:], order[0]], strict=True):
        k = len(x.text) // 3
        want[(x.doc_id, len(x.text), hashlib.sha256((x.text[: len(x.text) - k] + y.text[:k]).encode()).hexdigest())] += 1
    got = with_edits(some).collect()
    assert Counter((g.doc_id, g.n_chars, g.edited_sha256) for g in got) == want
    same = [g for g in got if g.n_chars == len("the same words again and again in this row")]
    assert len(same) == 400 and sum(g.near_next == 1.0 for g in same) >= 399


def test_repeats_in_remove_repeats(repeats):
    from quillstone.llm.repeats import remove_repeats

    own = repeats.select("doc_id", "text").collect()
    short = [(x.doc_id, x.text.encode()) for x in own if len(x.text) < 5000]
    gone = brute_removed([b for _, b in short], 40)
    want = Counter((i, bytes(np.frombuffer(b, np.uint8)[~g])) for (i, b), g in zip(short, gone, strict=True))
    got = remove_repeats(repeats, 40, 16, block=3000, with_text=True).collect()
    assert Counter((x.doc_id, bytes(x.kept)) for x in got if x.n_bytes < 5000) == want
    # The long texts are not alike: random numbers stay, 300,000 letters x go.
    assert {x.doc_id: x.n_removed for x in got if x.n_bytes >= 5000} == {5000: 0, 5001: 300_000}


def test_repeats_in_components(repeats):
    from quillstone.llm.ngram_join import jaccard_components

    own = repeats.select("doc_id", "text").collect()
    sizes, roots = brute_components([x.text for x in own], 4, 85)
    least = {c: min((x.doc_id for x, q in zip(own, roots, strict=True) if q == c and x.doc_id is not None), default=None) for c in set(roots)}
    want = Counter((x.doc_id, n, least[c]) for x, n, c in zip(own, sizes, roots, strict=True))
    assert Counter(map(tuple, jaccard_components(repeats).collect())) == want


def test_large_family_of_near_copies(spark):
    """Many near copies of one text, of which those with few changes link all: against brute force, with few candidates."""
    from quillstone.llm.ngram_join import jaccard_components

    r = random.Random(31)
    words = [f"w{i}" for i in range(3000)]
    base, values = [r.choice(words) for _ in range(120)], []
    for _ in range(260):
        c = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 5, 6, 8])):
            c[r.randrange(len(c))] = r.choice(words)
        values.append(" ".join(c[: len(c) - r.randint(0, 12)]))
    sizes, roots = brute_components(values, 4, 85)
    got = sorted(jaccard_components(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")).collect())
    assert [(x.n_shingles, x.component_id) for x in got] == list(zip(sizes, roots, strict=True)) and 1 < len(set(roots)) < 200


def test_repeats_in_mix(repeats):
    from quillstone.llm.mixture import mix, mixed

    for cell in (1 << 16, 4):
        rows = mix(repeats, cell_rows=cell).collect()
        assert len(rows) == repeats.count()
        taken, target = Counter(), {}
        for x in rows:
            assert x.copies <= 3 and x.taken == x.copies * x.size
            taken[x.source_size] += x.taken
            target[x.source_size] = x.target
        assert all(abs(taken[s] - t) <= 10 for s, t in target.items()) and len(target) == 2
        out = mixed(repeats, cell_rows=cell)
        assert out.columns == repeats.columns and out.count() == sum(x.copies for x in rows)
        assert max(x["count"] for x in out.groupBy("row").count().collect()) <= 3


def test_repeats_in_id_files(spark, repeats, tmp_path):
    from quillstone.llm.idfiles import read_ids, write_ids
    from quillstone.llm.pieces import library

    path = tokenizer_path("byte_bpe_50k.json")
    write_ids(repeats, path, str(tmp_path / "ids"))
    got = sorted(read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda x: x.start)
    given = sorted(((x.doc_id, x.text) for x in repeats.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tokenizer = library(path)
    start = 0
    for x, (i, t) in zip(got, given, strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
