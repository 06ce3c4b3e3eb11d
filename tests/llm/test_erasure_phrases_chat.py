"""Cascading erasure, phrase mining and chat windows against brute force, on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillstone.llm import chat, collocations, erasure
from quillstone.llm.common import shared_dir, tokenizer_path


# 11: erasure


def crc(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def order(value):
    """A value's place: nulls first, NaN above all numbers, nested ones by their text."""
    if value is None:
        return (0, 0, 0)
    if isinstance(value, float):
        return (1, math.isnan(value), 0.0 if math.isnan(value) else value)
    return (1, 0, value.encode() if isinstance(value, str) else value)


def shop(spark, seed, n=60, empty=False):
    """clients, clicks, sales, lines: a hot client with a third of all, nulls, ties, repeated rows, columns whose names clash, NaN."""
    r = random.Random(seed)
    ids = [None, 1, 1, 1, *range(1, 12)]
    clients = [(i, r.choice([None, 1, 5, 7, i]), r.choice(["a", None, "key"]), r.choice([1.005, -3.0, None, float("nan")])) for i in [None, None, *range(1, 13)]]
    clicks = [(r.randint(0, 5), r.choice(ids), r.choice([0.0, -0.0, 2.5, None, float("nan"), -1.5]), r.choice([None, "é", "z", ""]), r.random() < 0.5) for _ in range(n)]
    clicks += clicks[:9] * 3
    sales = [(i, r.choice(ids), r.choice([None, 10.25, 99.999])) for i in [*range(n), None, None, 3]]
    lines = [(r.choice([None, 2, 2, 2, *range(n + 20)]), r.choice([1.0, 2.345, None]), r.choice([[1, 2], [1], None, []])) for _ in range(3 * n)]
    tables = [
        (clients, "client_id long, master_id long, `key` string, balance double"), (clicks, "click_id int, client_id long, value double, `path` string, `row` boolean"),
        (sales, "sale_id long, client_id long, total double"), (lines, "sale_id long, amount double, `a.b` array<int>"),
    ]
    return [spark.createDataFrame([] if empty else rows, schema).repartition(3) for rows, schema in tables]


def expected(frames, files, divisor):
    names = ("clients", "clicks", "sales", "sale_lines")
    rows = {t: [tuple(r) for r in df.collect()] for t, df in zip(names, frames, strict=True)}
    column = {t: df.columns for t, df in zip(names, frames, strict=True)}
    times = Counter(r[1] for r in rows["clicks"])
    masters = {}
    for client, master, *_ in rows["clients"]:
        if master is not None:
            masters.setdefault(master, set()).update([client] * (client is not None))
    gone = {m for m in masters if crc(m) % divisor == 0} | ({min(masters, key=lambda m: (-sum(times[c] for c in masters[m]), m))} if masters else set())
    clients = {c for m in gone for c in masters[m]}
    lost = {r[0] for r in rows["sales"] if r[1] in clients and r[0] is not None}
    owner = {}
    for sale, client, _ in rows["sales"]:
        if sale is not None and (client is not None or sale not in owner):
            owner[sale] = client if owner.get(sale) is None else min(owner[sale], client)
    key = {"clients": lambda r: crc(r[0]), "clicks": lambda r: crc(r[1]), "sales": lambda r: crc(r[1]), "sale_lines": lambda r: crc(owner.get(r[0]))}
    victim = {"clients": lambda r: r[1] in gone, "clicks": lambda r: r[1] in clients, "sales": lambda r: r[1] in clients, "sale_lines": lambda r: r[0] in lost}
    amount = {"clients": 3, "clicks": 2, "sales": 2, "sale_lines": 1}
    out = {}
    for t in names:
        text = [f'{{"x":{str(r[2]).replace(" ", "")}}}' if t == "sale_lines" and r[2] is not None else "{}" for r in rows[t]]
        whole = sorted(zip(rows[t], text, strict=True), key=lambda x: (key[t](x[0]), [order(x[1] if t == "sale_lines" and i == 2 else v) for i, v in enumerate(x[0])]))
        size = 1 + len(whole) // files
        for f, i in enumerate(range(0, len(whole), size)):
            part = [r for r, _ in whole[i : i + size]]
            left = [r for r in part if not victim[t](r)]
            if left:
                cents = sum(math.floor(100 * x + 0.5) for r in left if (x := r[amount[t]]) is not None and not math.isnan(x))
                out[t, f] = (left, len(part) - len(left), cents, ",".join(column[t]))
    return out


@pytest.mark.parametrize(("seed", "files", "run", "chunk"), [(1, 7, 600, 4), (2, 150, 1 << 20, 64), (3, 3, 300, 1)])
def test_erase_masters(spark, seed, files, run, chunk):
    frames = shop(spark, seed)
    folder = f"{shared_dir(spark)}/erasure-test-{seed}"
    got = erasure.read_back(erasure.erase_masters(spark, *frames, folder, files, 3, run, chunk), {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}).collect()
    want = expected(frames, files, 3)
    assert {(r.table_name, r.file_no) for r in got} == set(want) and any(r.rewritten for r in got) and len(got) > 3
    filesystem, path = erasure.store(folder)
    from pyarrow import fs

    assert sorted(f.path for f in filesystem.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File) == sorted(erasure.store(r.path)[1] for r in got)
    for r in got:
        rows, erased, cents, columns = want[r.table_name, r.file_no]
        assert (r.n_rows, r.n_erased, r.cents, r.rewritten, r.columns) == (len(rows), erased, cents, erased > 0, columns)
        assert r.ids_sha256 == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in rows).encode()).hexdigest()
        file = pq.ParquetFile(erasure.store(r.path)[1])
        back = list(zip(*[c.to_pylist() for c in file.read().columns], strict=True))
        assert repr(back).replace("-0.0", "0.0") == repr(rows).replace("-0.0", "0.0")
        first = file.metadata.row_group(0).column(0).statistics
        known = [x[0] for x in rows if x[0] is not None]
        assert not known or (first.min, first.max) == (min(known), max(known))


def test_erase_empty_tables(spark):
    frames = shop(spark, 1, empty=True)
    got = erasure.read_back(erasure.erase_masters(spark, *frames, f"{shared_dir(spark)}/erasure-empty"), {t: "x" for t in ("clients", "clicks", "sales", "sale_lines")})
    assert got.collect() == []
    some = [*shop(spark, 1, empty=True)[:2], *shop(spark, 5)[2:]]
    got = erasure.erase_masters(spark, *some, f"{shared_dir(spark)}/erasure-no-clients", 4).collect()
    assert {r.table_name for r in got} == {"sales", "sale_lines"} and not any(r.rewritten for r in got)


def test_selection_is_exact():
    """Cuts of runs with many ties: they add up to the rank, and nothing before a cut is above anything after one."""
    r = random.Random(4)
    for _ in range(60):
        chunk = r.choice([1, 2, 5])
        place_of = lambda x: (x[0], x[1] is not None, x[1] or 0)
        runs = [sorted(((r.randint(0, 3), r.choice([None, 0, 1])) for _ in range(r.randint(1, 30))), key=place_of) for _ in range(r.randint(1, 5))]
        batches = [pa.RecordBatch.from_pydict({"k0": pa.array([a for a, _ in x], pa.int64()), "k1": pa.array([b for _, b in x], pa.int64())}) for x in runs]
        total = sum(map(len, runs))
        ranks = sorted({0, total, *(r.randint(0, total) for _ in range(5))})
        bounds = erasure.windows([b.take(pa.array(range(0, b.num_rows, chunk))) for b in batches], list(map(len, runs)), chunk, ranks)
        for rank, window in zip(ranks, bounds, strict=True):
            parts = [erasure.Keys(b.slice(lo, hi - lo)) for b, (lo, hi) in zip(batches, window, strict=True)]
            cut = [lo + k for (lo, _), k in zip(window, erasure.select(parts, rank - sum(lo for lo, _ in window)), strict=True)]
            assert sum(cut) == rank
            place = [list(map(place_of, x)) for x in runs]
            before, after = [k for x, c in zip(place, cut, strict=True) for k in x[:c]], [k for x, c in zip(place, cut, strict=True) for k in x[c:]]
            assert not before or not after or max(before) <= min(after)


# 12: phrases


def phrases(docs, least, top, inside):
    """The contract, by counting all phrases."""
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        totals[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for (lang, g), a in counts.items():
        if len(g) < 2 or a < least:
            continue
        if any(len(h) > len(g) and b >= least and m == lang and 100 * b >= inside * a and any(h[i : i + len(g)] == g for i in range(len(h))) for (m, h), b in counts.items()):
            continue
        score, k = min((2000000 * a // (counts[lang, g[:k]] + counts[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, score, a, " ".join(g), counts[lang, g[:k]], counts[lang, g[k:]], totals[lang]))
    out.sort(key=lambda x: (x[0], -x[1], -x[2], x[3].encode()))
    seen = Counter()
    return [(x[0], seen.update([x[0]]) or seen[x[0]], x[3], x[2], x[4], x[5], x[6], x[1]) for x in out if seen[x[0]] < top]


def prose(seed, n=60):
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "ÉÉ", "x-1", "new", "york", "city"]
    texts = [" ".join(r.choice(words) + r.choice(["", "", "", ".", "\t", ",", "\n", "  "]) for _ in range(r.randint(0, 40))) for _ in range(n)]
    texts += ["new york city hall is in new york city"] * 15 + ["a a a a a a"] * 4 + ["", None, " . ", "b" * 3000, "the of " * 4000]
    return [(r.choice(["en", "fr", None, "und"]), t) for t in texts]


@pytest.mark.parametrize(("least", "top", "most"), [(3, 2000, 1 << 17), (6, 7, 3)])
def test_collocations(spark, least, top, most):
    docs = prose(least)
    df = spark.createDataFrame([(l, t, "x", 1) for l, t in docs], "lang string, text string, pivot string, f int").repartition(3)
    got = collocations.collocations(df, least, top, most=most).orderBy("lang", "rank").collect()
    want = sorted(phrases(docs, least, top, 80))
    assert sorted(tuple(r) for r in got) == want and len(want) > 10


def test_collocations_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_words_of_long_texts(monkeypatch):
    """Texts are cut into stretches between words only."""
    text = ("ab. cd ef\tgh\nij " * 7 + "k" * 40 + " lm").encode()
    whole = collocations.Vocabulary("en")
    ids = whole.ids([text, b"", b"zz"])
    monkeypatch.setattr(collocations, "STRETCH", 11)
    cut = collocations.Vocabulary("en")
    assert [cut.words[i] for i in cut.ids([text, b"", b"zz"])] == [whole.words[i] for i in ids]
    assert max(map(len, collocations.stretches([text]))) < 60


# 13: chat windows

HARD = [r"\### Assistant: </turn> ok", "###", "#" * 7, "</turn>\n", "<\\/", "\\n", "\\", "a\n### user\nb</turn>", "", None, "é🙂" * 5, "word " * 30]


def conversations(spark, seed):
    r = random.Random(seed)
    rows = []
    for conv in [None, 0, 1, 2, 3, -4]:
        for turn in range(r.randint(1, 12)):
            rows.append((conv, turn if turn else None, r.choice(["user", "assistant", "system", "a\nb#", None]), r.choice(HARD), "x"))
    rows += [(9, t, "system" if t == 0 else "assistant" if t % 2 else "user", f"{t} " * (t % 5), "x") for t in range(90)]
    rows += [(10, 0, "user", "same", "x")] * 3 + [(11, 0, "system", "s " * 500, "x"), (11, 1, "assistant", "y " * 900, "x"), (11, 2, "assistant", "z", "x")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, body string").repartition(3)


@pytest.mark.parametrize(("budget", "history", "block"), [(60, 20, 7), (1024, 256, 1024), (25, 0, 1), (100, 60, 50)])
def test_windows(spark, budget, history, block):
    rows, df = conversations(spark, budget)
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    made = chat.windows(df, tokenizer, budget, history, block).cache()
    got = {r.conv_id: r for r in chat.read_windows(made).collect()}
    turns = {}
    for c, t, role, text, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(turns)
    for c, said in turns.items():
        loss = "".join(t for role, t in said if role == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(said), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in said).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    order = sorted(made.collect(), key=lambda w: (w.conv_id is not None, w.conv_id or 0, w.block, w.window))
    assert got[9].formatted_chars == sum(len(w.text) for w in order if w.conv_id == 9)
    at, previous = {}, None
    for w in order:
        parsed, start = chat.parse(w.text), at.get(w.conv_id, 0)
        said = turns[w.conv_id]
        sizes = [len(library.encode(x + "</turn>\n", add_special_tokens=False).ids) for x in w.text.split("</turn>\n")[:-1]]
        assert sum(sizes) == w.n_tokens and len(sizes) == w.n_turns == len(parsed)
        new = len(parsed) - w.n_repeated
        assert new >= 1 and (w.n_tokens <= budget or new == 1)
        assert [(a, t) for a, t, _, _ in parsed[w.n_repeated :]] == said[start : start + new]
        first = next((i for i, (a, _) in enumerate(said) if a == "system"), None)
        head = int(first is not None and first < start and (w.n_repeated == 0 or start - w.n_repeated > first or parsed[0][:2] == said[first]))
        if first is not None and first < start:
            assert said[first] in [(a, t) for a, t, _, _ in parsed[: w.n_repeated]]
        back = w.n_repeated - head
        tail = [(a, t) for a, t, _, _ in parsed[: w.n_repeated]]
        assert tail[len(tail) - max(0, back) :] == said[start - max(0, back) : start] and sum(sizes[w.n_repeated - max(0, back) : w.n_repeated]) <= max(history, 0)
        spans = [(s.start, s.end) for s in w.loss]
        assert spans == [(lo, hi) for a, _, lo, hi in parsed[w.n_repeated :] if a == "assistant"]
        assert "###" not in w.text.replace("### ", "", 0)[4:].split("\n### ")[0]
        if previous and previous[0] == (w.conv_id, w.block):  # the window before could not take this one's first new turn
            assert previous[1] + sizes[w.n_repeated] > budget or head
        previous = ((w.conv_id, w.block), w.n_tokens)
        at[w.conv_id] = start + new
    assert at == {c: len(x) for c, x in turns.items()}


def test_windows_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_windows(chat.windows(df, tokenizer_path("byte_bpe_50k.json"))).collect() == []
