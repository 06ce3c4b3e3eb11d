"""Phrases mined by pivot partitioning: each n-gram is counted where its rarest word is.

Words are ordered by counters of hashed words over all texts, rarest first (ties by hash, then by the word), so that every task knows the
same order without holding a vocabulary. For each occurrence of a word a fragment is made: the word with up to three neighbours on either side, cut
where a piece ends, where a word is rarer (to the left: or the same), and where the counter of the words up to there is below the least count. An n-gram belongs to
the first occurrence of its rarest word in it. Those that start before the pivot come from one fragment, those that start at it from another, dealt by
pivot and neighbour, so that all occurrences of an n-gram meet in one task and its count is final there. A task merges its equal fragments and packs those of a bucket of pivots into one compressed row before they are dealt.

Counters are of words and pairs in a first pass over the texts and of three and four words in a second one. They only bound counts from above: they order and cut, what is counted is
exact. They have a fixed size (WORDS, GRAMS), 13 MB in all once they are levels and bits; that is all that is broadcast. With more text than they can tell apart, less is cut, and
results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import cut, few_rows, partitions

LONGEST = 4
WORDS, GRAMS, SLICES = 1 << 20, 1 << 25, 64
#: Bytes of text that are cut into words at once, bytes of a batch, and words that a task knows at once.
STRETCH, BATCH, KNOWN = 4 << 20, 6 << 20, 1_000_000
#: Fragments that a task merges at once, and buckets for each partition: a task counts the n-grams of one bucket at a time.
HELD, BUCKETS = 1_500_000, 2
#: A pivot with more occurrences than this is dealt to several tasks, by neighbour.
PART = 1 << 17

_END = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")


class Vocabulary:
    """Numbers of the words of one language; 0 is the end of a piece."""

    def __init__(self, lang: str):
        self.seed = lang.encode() + b"\0"
        self.clear()

    def clear(self) -> None:
        self.numbers, self.words, self.hashes = {b".": 0}, [b"."], np.zeros(1, np.uint64)

    def ids(self, texts: list[bytes]) -> np.ndarray:
        """The words of the texts in order, a 0 wherever a piece ends and after each text."""
        import xxhash

        if len(self.words) > KNOWN:
            self.clear()
        out, get = [], self.numbers.get
        for text in stretches(texts):
            tokens = text.translate(_END).replace(b".", b" . ").split()
            found = list(map(get, tokens))
            if None in found:
                for t in dict.fromkeys(t for t, i in zip(tokens, found, strict=True) if i is None):
                    self.numbers[t] = len(self.words)
                    self.words.append(t)
                found = list(map(get, tokens))
            out.append(np.array(found, np.int32))
        fresh = self.words[len(self.hashes) :]
        self.hashes = np.concatenate((self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(self.seed + w) for w in fresh), np.uint64, len(fresh))))
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def stretches(texts: list[bytes]) -> Iterator[bytes]:
    """The texts, each ended by a '.', joined and cut before spaces, so that no word is cut and only a bounded part is a list of words."""
    held, size = [], 0
    for text in texts:
        lo = 0
        while len(text) - lo > STRETCH:
            hi = max(text.rfind(b" ", lo + 1, lo + STRETCH), text.rfind(b"\n", lo + 1, lo + STRETCH))
            if hi < 0:
                hi = min(x for x in (text.find(b" ", lo + STRETCH), text.find(b"\n", lo + STRETCH), len(text)) if x >= 0)
            yield b" ".join([*held, text[lo:hi]])
            held, size, lo = [], 0, hi
        held += [text[lo:], b"."]
        size += len(text) - lo
        if size > STRETCH:
            yield b" ".join(held)
            held, size = [], 0
    if held:
        yield b" ".join(held)


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, BATCH bytes or a little more at once."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] > BATCH or sum(sizes.values()) > 4 * BATCH:
                most = max(sizes, key=sizes.get)
                yield most, held.pop(most)
                del sizes[most]
    yield from held.items()


def vocabulary_of(known: dict[str, Vocabulary], lang: str) -> Vocabulary:
    """A language's vocabulary; those of a few languages are held at once."""
    if lang not in known and len(known) >= 16:
        known.clear()
    return known.setdefault(lang, Vocabulary(lang))


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + (first << np.uint64(31)))
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def buckets(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(32)).astype(np.int64) & (GRAMS - 1)


def passes(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the counters of n-grams reach the least count."""
    at = buckets(grams)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact below 128, then four steps for each doubling."""
    return np.clip(np.where(counts < 128, counts, 128 + 4 * np.log2(np.maximum(counts, 128) / 128)), 0, 255).astype(np.uint8)


def counted(level: np.ndarray) -> np.ndarray:
    """About how many occurrences a level stands for."""
    return np.where(level < 128, level, 128 * 2.0 ** ((level.astype(float) - 128) / 4))


def tallies(texts: DataFrame, tell, sizes: tuple[int, ...], least: int) -> list[np.ndarray]:
    """Counters over all texts (lang, text). tell(vocabulary, ids) gives, for each table, the places to count; the first table of size WORDS comes as levels, tables of size GRAMS as bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        # All that is asked of n-grams is whether they reach the least count, so a byte holds as much of theirs as matters.
        enough = min(least, 255)
        tables, known = [np.zeros(n, np.uint8 if n == GRAMS else np.uint32) for n in sizes], {}
        for lang, some in by_language(batches):
            vocabulary = vocabulary_of(known, lang)
            for table, places in zip(tables, tell(vocabulary, vocabulary.ids(some)), strict=True):
                at, n = np.unique(places, return_counts=True)
                table[at] = np.minimum(table[at].astype(np.int64) + n, enough if table.dtype == np.uint8 else 0xFFFFFFFF)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for k, table in enumerate(tables):
            yield pa.RecordBatch.from_pydict({"tally": pa.array([k] * SLICES, pa.int32()), "slice": pa.array(range(SLICES), pa.int32()), "counts": [squeeze(x.tobytes()) for x in np.split(table, SLICES)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        loose = zstandard.ZstdDecompressor().decompress
        size = sizes[int(rows["tally"].iloc[0])]
        total = np.zeros(size // SLICES, np.int64)
        for x in rows["counts"]:
            total += np.frombuffer(loose(x), np.uint8 if size == GRAMS else np.uint32)
        made = np.packbits(total >= min(least, 255)) if size == GRAMS else level_of(total)
        return pd.DataFrame({"tally": rows["tally"].iloc[:1], "slice": rows["slice"].iloc[:1], "counts": [made.tobytes()]})

    schema = "tally int, slice int, counts binary"
    parts = sorted(texts.mapInArrow(count, schema).groupBy("tally", "slice").applyInPandas(add, schema).collect())
    empty = [np.zeros(n // 8 if n == GRAMS else n, np.uint8) for n in sizes]
    return [np.frombuffer(b"".join(p["counts"] for p in parts if p["tally"] == k), np.uint8) if parts else empty[k] for k in range(len(sizes))]


def words_and_pairs(vocabulary: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = vocabulary.hashes[ids]
    both = (ids[:-1] > 0) & (ids[1:] > 0)
    return (h[ids > 0] & np.uint64(WORDS - 1)).astype(np.int64), buckets(mixed(h[:-1][both], h[1:][both]))


class Context:
    """Where words stand in the common order, and which n-grams from each word on may be frequent."""

    def __init__(self, vocabulary: Vocabulary, ids: np.ndarray, levels: np.ndarray, bits: list[np.ndarray], least: int):
        rank, self.level = rarity(vocabulary, levels)
        place = np.where((ids > 0) & (self.level[ids] >= level_of(np.array([least]))[0]), rank[ids], -1)
        pad = np.full(LONGEST, -1)
        self.place, self.ids = np.concatenate((pad, place, pad)), np.concatenate((np.zeros(LONGEST, np.int32), ids, np.zeros(LONGEST, np.int32)))
        h = vocabulary.hashes[self.ids]
        known = self.place >= 0
        self.grams, self.fine = [h], [known]
        for k in range(1, LONGEST):
            gram = mixed(self.grams[-1][:-1], h[k:])
            fine = self.fine[-1][:-1] & self.fine[-1][1:] & known[k:]
            if k <= len(bits):
                at = np.flatnonzero(fine)
                fine[at] = passes(gram[at], bits[k - 1])
            self.grams.append(gram)
            self.fine.append(fine)


def rarity(vocabulary: Vocabulary, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each known word in the common order, rarest first, and its level."""
    h = vocabulary.hashes
    level = levels[(h & np.uint64(WORDS - 1)).astype(np.int64)]
    order = np.lexsort((h, level))
    if (same := h[order[1:]] == h[order[:-1]]).any() and len(same):
        order = np.array(sorted(range(len(h)), key=lambda i: (level[i], h[i], vocabulary.words[i])))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    return rank, level


def fragments_of(vocabulary: Vocabulary, ids: np.ndarray, levels: np.ndarray, bits: list[np.ndarray], least: int, most: int = PART, into: int = 1) -> pa.RecordBatch | None:
    """bucket (below `into`, by pivot and part), at (words before the pivot), words, n: each word alone with its count, then fragments of two or more words."""
    c = Context(vocabulary, ids, levels, bits, least)
    ids, place, (_, pair, three, four) = c.ids, c.place, c.fine
    at = np.flatnonzero(place >= 0)
    if not len(at):
        return None
    own = place[at]
    rarer = lambda d: place[at + d] > own if d < 0 else place[at + d] >= own
    left = [pair[at - 1] & rarer(-1)]
    left.append(left[0] & three[at - 2] & rarer(-2))
    left.append(left[1] & four[at - 3] & rarer(-3))
    right = [pair[at] & rarer(1)]
    right.append(right[0] & three[at] & rarer(2))
    right.append(right[1] & four[at] & rarer(3))
    through = left[0] & right[0] & three[at - 1]  # from before the pivot to behind it
    beyond = through & four[at - 1] & rarer(2)
    never = np.zeros(len(at), bool)
    sides = []
    for chosen, reach in ((left[0], (left[2], left[1], left[0], None, through, beyond, never)), (right[0], (never, never, never, None, *right))):
        some = np.flatnonzero(chosen)
        sides.append(np.stack([np.where(True if r is None else r[some], ids[at[some] + d], 0) for d, r in zip(range(-3, 4), reach, strict=True)]))
    columns = np.concatenate(sides, 1)
    h = vocabulary.hashes
    key = np.zeros(columns.shape[1], np.uint64)
    for column in columns:
        key = mixed(key, np.where(column > 0, h[column], np.uint64(1)))
    order = np.argsort(key)
    columns = columns[:, order]
    # Equal fragments stand together; unequal ones with equal hashes may keep some apart, which only costs a row.
    heads = np.flatnonzero(np.concatenate(([True], (columns[:, 1:] != columns[:, :-1]).any(0)))) if len(order) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate((heads, [len(order)])))
    columns = columns[:, heads]
    alone, count = np.unique(ids[at], return_counts=True)
    names = pa.array(vocabulary.words, pa.binary())
    parts = 1 + (counted(c.level[columns[3]]) // most).astype(np.int64)
    neighbour = np.where(columns[2] > 0, columns[2], columns[4])
    part = (h[neighbour] >> np.uint64(20)).astype(np.int64) % parts
    texts = pc.binary_join_element_wise(*[names.take(pa.array(x, mask=x == 0)) for x in columns], b" ", null_handling="skip")
    owner = np.concatenate((h[alone], mixed(h[columns[3]], part.astype(np.uint64))))
    before = np.concatenate((np.zeros(len(alone), np.int64), (columns[:3] > 0).sum(0)))
    return pa.RecordBatch.from_pydict({
        "bucket": (owner >> np.uint64(11)).astype(np.int64) % into, "at": pa.array(before, pa.int8()), "words": pa.concat_arrays([names.take(pa.array(alone)), texts]), "n": np.concatenate((count, times)).astype(np.int64),
    })


def packed(lang: str, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Fragments of one language as a compressed list for each bucket: words, at and n of each, which '.' ends and ',' parts, since no word has either."""
    import zstandard

    whole = pa.Table.from_batches(rows).group_by(["bucket", "at", "words"]).aggregate([("n", "sum")]).combine_chunks()
    order = pc.sort_indices(whole, sort_keys=[("bucket", "ascending"), ("words", "ascending")])
    whole = whole.take(order)
    bucket = whole.column("bucket").to_numpy()
    text = lambda c: whole.column(c).cast(pa.string()).cast(pa.binary())
    lines = pc.binary_join_element_wise(whole.column("words"), text("at"), text("n_sum"), b",").to_pylist()
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    squeeze = zstandard.ZstdCompressor(level=3).compress
    data = [squeeze(b".".join(lines[lo:hi])) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[edges[:-1]], pa.int32()), "lang": pa.array([lang] * len(data), pa.string()), "data": data})


def fragments(texts: DataFrame, levels: np.ndarray, bits: list[np.ndarray], least: int, most: int = PART, into: int = 200) -> DataFrame:
    """bucket, lang, data: all texts' fragments, packed by the bucket of their pivot; without words, the number of all words of a language. A task merges its equal fragments, HELD at once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Vocabulary] = {}
        held: dict[str, list[pa.RecordBatch]] = {}
        for lang, some in by_language(batches):
            vocabulary = vocabulary_of(known, lang)
            ids = vocabulary.ids(some)
            rows = held.setdefault(lang, [])
            rows.append(pa.RecordBatch.from_pydict({"bucket": [0], "at": pa.array([0], pa.int8()), "words": [b""], "n": [int((ids > 0).sum())]}))
            if (made := fragments_of(vocabulary, ids, levels, bits, least, most, into)) is not None:
                rows.append(made)
            if sum(b.num_rows for x in held.values() for b in x) > HELD:
                largest = max(held, key=lambda x: sum(b.num_rows for b in held[x]))
                yield packed(largest, held.pop(largest))
        for lang, rows in held.items():
            yield packed(lang, rows)

    return texts.mapInArrow(make, "bucket int, lang string, data binary")


def miner(least: int):
    """The frequent n-grams of each bucket, which holds all occurrences of its own; rows come sorted by bucket and lang."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose = zstandard.ZstdDecompressor().decompress
        key, counts = None, {}

        def found() -> list[tuple]:
            return [(key[1], g, f) for g, f in counts.items() if f >= least or not g]

        for batch in few_rows(batches, 64):
            for bucket, lang, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, lang) != key:
                    if key is not None and (rows := found()):
                        yield _grams(rows)
                    key, counts = (bucket, lang), {}
                for line in loose(data).split(b"."):
                    words, at, n = line.split(b",")
                    n = int(n)
                    space = words.find(b" ")
                    if space < 0:
                        counts[words] = counts.get(words, 0) + n
                        continue
                    edges = [0]
                    while space >= 0:
                        edges.append(space + 1)
                        space = words.find(b" ", space + 1)
                    edges.append(len(words) + 1)
                    at, last = int(at), len(edges) - 1
                    for lo in range(at) if at else (0,):
                        for hi in range(max(at + 1, lo + 2), min(last, lo + LONGEST) + 1):
                            gram = words[edges[lo] : edges[hi] - 1]
                            counts[gram] = counts.get(gram, 0) + n
        if key is not None and (rows := found()):
            yield _grams(rows)

    return mine


def _grams(rows: list[tuple]) -> pa.RecordBatch:
    lang, gram, f = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"lang": list(lang), "gram": pa.array(gram, pa.binary()), "f": list(f)})


def frequent_phrases(docs: DataFrame, least: int = 30, most: int = PART) -> DataFrame:
    """lang, gram (space-joined string), f: every phrase of 1 to 4 words that occurs at least `least` times; with an empty gram the number of all words. most: see PART."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    levels, pairs = tallies(texts, words_and_pairs, (WORDS, GRAMS), least)

    def longer(vocabulary: Vocabulary, ids: np.ndarray) -> list[np.ndarray]:
        c = Context(vocabulary, ids, levels, [pairs], least)
        return [buckets(c.grams[k][c.fine[k]]) for k in (2, 3)]

    bits = [pairs, *tallies(texts, longer, (GRAMS, GRAMS), least)]
    into = BUCKETS * partitions(docs.sparkSession)
    found = fragments(texts, levels, bits, least, most, into).repartition(partitions(docs.sparkSession), "bucket", "lang")
    mined = found.sortWithinPartitions("bucket", "lang").mapInArrow(miner(least), "lang string, gram binary, f long")
    return mined.select("lang", F.col("gram").cast("string").alias("gram"), "f")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, most: int = PART) -> DataFrame:
    """The best `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ASCII letters are lower-cased, pieces end at . , ; : ! ? and line ends, words at spaces and tabs; null texts are empty, a null lang is 'und'. Phrases of 2
    to 4 words with count a >= least are scored floor(2000000 a / (l + r)) at their worst cut (ties: the first) and dropped when a longer phrase that holds them has
    at least `inside` per cent of their count. Order: score, a, then the phrase by bytes. An empty table gives no rows.
    """
    grams = cut(frequent_phrases(docs, least, most), "phrases")
    whole = grams.select("lang", "gram", "f")
    words = F.split("gram", " ", -1)
    found = grams.filter("gram != ''").withColumn("words", words).withColumn("k", F.size("words")).filter("k > 1")
    cuts = found.select("lang", "gram", "words", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("head", F.array_join(F.slice("words", 1, F.col("cut")), " ")).withColumn("tail", F.array_join(F.slice("words", F.col("cut") + 1, F.col("k")), " "))
    cuts = cuts.join(whole.select("lang", F.col("gram").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(whole.select("lang", F.col("gram").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("cast((cast(2000000 as decimal(12,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"))
    best = cuts.groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    # The largest count of the longer phrases around a phrase decides.
    spans = F.explode(F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(words, i, s), ' '))))"))
    around = found.filter("k > 2").select("lang", spans.alias("gram"), "f").groupBy("lang", "gram").agg(F.max("f").alias("longer"))
    kept = best.join(around, ["lang", "gram"], "left").filter(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {inside}")
    totals = grams.filter("gram = ''").select("lang", F.col("f").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = kept.select("lang", F.col("gram").alias("phrase"), "a", "b.l", "b.r", "b.score").withColumn("rank", place).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
