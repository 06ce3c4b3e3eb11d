"""Removing long repeated strings, with a run-compressed index of the places where texts may agree.

1. Each window of 400 bytes names the 64-byte gram in it with the smallest hash. That depends on the window's bytes alone, so equal
   windows name equal grams. Consecutive windows that name the same gram form a stretch.
2. A gram that is named once has no repeats. Where all stretches of a gram are equal (by a 128-bit digest), all are repeats.
3. Only the distinct stretches of other grams are compared: those of a gram come to one block, whose run-length index says for
   each window whether it occurs elsewhere in the block.
4. A gram with too many distinct stretches for a block has the 128-bit digests of its windows dealt to groups instead, as many as keep a group's size, in which equal windows meet.

The index: the suffix array of a block gives its Burrows-Wheeler transform, of which the runs are kept with the
suffixes at their ends. Only there, where the transform changes, are neighbouring suffixes compared; between two such
places in the text, the length of the match falls by one with each byte. So matching statistics are streamed over the text from
as many comparisons as there are runs, few in repetitive text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, drop, few_rows, partitions

LENGTH = 400
GRAM = 64
#: Distinct stretches of a gram beyond which its windows are counted by digest.
MOST = 2000
#: Stretches of a crowded gram whose windows one group has at least.
FEW = 500
#: Rows over which the stretches of a crowded gram spread.
SALTS = 64
#: Bytes of a block of whole grams' stretches.
BLOCK = 1 << 21


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each position on; gram is 8 times a power of two."""
    n = len(data) - gram + 1
    h = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    step = 8
    while step < gram:
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + (h[step:] ^ (h[step:] >> np.uint64(29)))
        step *= 2
    h = h[:n] * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


def stretches(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, and hash of the named gram, of each stretch of a text."""
    total = len(data) - length + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width, part = length - gram + 1, 1 << 22
    named = []
    for at in range(0, total, part):
        piece = data[at : min(len(data), at + part + length - 1)]
        h = gram_hashes(piece, gram)
        # The hash's upper bits, then the place: the smallest is the leftmost of equals.
        key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(key) // width) * width, ~np.uint64(0))
        padded[: len(key)] = key
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, 1).reshape(-1)
        back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
        least = np.minimum(back[: len(key) - width + 1], ahead[width - 1 : len(key)])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        named.append((place + at, h[place]))
    place, h = np.concatenate([x for x, _ in named]), np.concatenate([x for _, x in named])
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return first, np.diff(np.concatenate((first, [total]))), h[first]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By doubling; symbols are below 512."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key, depth = np.zeros(n, np.int64), 7
    for k in range(7):
        key = key << 9 | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or depth >= n:
            return order
        follow = np.zeros(n, np.int64)
        if depth < n:
            follow[:-depth] = rank[depth:] + 1
        key = rank * (n + 1) + follow
        depth *= 2


def common_prefixes(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix of suffixes a and b, of all pairs at once."""
    n, out = len(symbols), np.zeros(len(a), np.int64)
    live, padded = np.arange(len(a)), np.concatenate([symbols.astype(np.int32), np.full(16, -1, np.int32)])
    step = np.arange(16)
    for _ in range(n // 16 + 1):
        p, q = np.minimum(a[live] + out[live], n), np.minimum(b[live] + out[live], n)
        same = (padded[p[:, None] + step] == padded[q[:, None] + step]) & (np.maximum(p, q)[:, None] + step < n)
        many = np.where(same.all(1), 16, same.argmin(1))
        out[live] += many
        live = live[many == 16]
        if not len(live):
            break
    return out


class RunIndex:
    """The runs of a text's Burrows-Wheeler transform, the suffixes at their ends and what neighbours there have in common.

    The suffix array and the text are needed to build it only; everything is answered from a few numbers a run.
    """

    def __init__(self, symbols: np.ndarray):
        sa = suffix_array(symbols)
        before = symbols[sa - 1].astype(np.int32)
        before[sa == 0] = -1
        change = np.flatnonzero(before[1:] != before[:-1])
        self.size = len(symbols)
        self.ends, self.starts = sa[change], sa[change + 1]
        self.shared = common_prefixes(symbols, self.ends, self.starts)
        self.top, self.bottom = (sa[0], sa[-1]) if len(sa) else (0, 0)
        # The whole transform begins with the letter before the text's end.
        whole = np.concatenate((symbols[-1:].astype(np.int32), before))
        self.begins = np.flatnonzero(np.concatenate(([True] * (len(whole) > 0), whole[1:] != whole[:-1])))
        self.letters = whole[self.begins]

    @property
    def runs(self) -> int:
        return len(self.letters)

    @cached_property
    def _by_letter(self) -> tuple[np.ndarray, ...]:
        """Runs in the order of letters: letter, begin, length, and the lengths of the letter's runs before."""
        order = np.lexsort((self.begins, self.letters))
        length = np.diff(np.concatenate((self.begins, [self.size + 1])))[order]
        letters, ahead = self.letters[order], np.concatenate(([0], np.cumsum(length)[:-1]))
        return letters, self.begins[order], length, ahead - ahead[np.searchsorted(letters, letters)]

    def count(self, pattern) -> int:
        """How often a pattern occurs, by backward search over the runs."""
        letters, begins, length, ahead = self._by_letter
        low, high = 0, self.size + 1
        for c in reversed(list(pattern)):
            first, last = np.searchsorted(letters, c), np.searchsorted(letters, c, "right")
            base = int(length[:first].sum())

            def rank(i: int, first=first, last=last) -> int:
                j = first + np.searchsorted(begins[first:last], i) - 1
                return 0 if j < first else int(ahead[j] + min(i - begins[j], length[j]))

            low, high = base + rank(low), base + rank(high)
            if low >= high:
                return 0
        return high - low

    def matching(self) -> np.ndarray:
        """For each position, the longest match that also begins at another position."""
        n = self.size

        def stream(place: np.ndarray, alone: int) -> np.ndarray:
            value, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            value[place], known[place] = self.shared, place
            value[alone], known[alone] = 0, alone
            last = np.maximum.accumulate(known)
            return np.maximum(value[last] - (np.arange(n) - last), 0)

        # Against the suffix before in the order, known at the starts of runs; and the one after, known at their ends.
        return np.maximum(stream(self.starts, self.top), stream(self.ends, self.bottom))


def long_repeats(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of the pieces, whether each of its windows occurs elsewhere in them."""
    sizes = np.array([len(p) + 1 for p in pieces])
    symbols = np.zeros(int(sizes.sum()), np.uint16)
    ends = np.cumsum(sizes)
    symbols[:] = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8).astype(np.uint16) + 1
    symbols[ends - 1] = 0
    match = RunIndex(symbols).matching() >= length
    return [match[e - s : e - length] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2] - edge[::2]


def _signed(data: bytes) -> tuple[int, int]:
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """k, th and spans (array of first byte and end) of the texts that hold repeats, sorted but not merged.

    docs: k and th (together a key; rows that share it have the same text), text.
    """
    digest = ["key", "d1", "d2"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in few_rows(batches):
            rows: list[list] = [[] for _ in range(5)]
            many = []
            for text in batch.column(2).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                first, windows, h = stretches(np.frombuffer(raw, np.uint8), length, gram)
                many.append(len(first))
                view = memoryview(raw)
                ids = [_signed(xxhash.xxh3_128_digest(view[s : s + w + length - 1])) for s, w in zip(first.tolist(), windows.tolist(), strict=True)]
                for out, x in zip(rows, (first, windows, h.view(np.int64), np.array([i for i, _ in ids], np.int64), np.array([i for _, i in ids], np.int64)), strict=True):
                    out.append(x)
            key = [np.repeat(batch.column(i).to_numpy(), many) for i in (0, 1)]
            out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in rows]
            yield pa.RecordBatch.from_arrays([*map(pa.array, key), pa.array(out[0].astype(np.int32)), pa.array(out[1].astype(np.int32)), *map(pa.array, out[2:])], names=["k", "th", "s", "w", "key", "d1", "d2"])

    # Rows that share a key have one text: it is named once, with their number, and where that is above one all its windows are repeated.
    same = cut(docs.groupBy("k", "th").agg(F.count("*").alias("rows")).filter("rows > 1"), "same-rows")
    named = cut(docs.select("k", "th", "text").mapInArrow(name, "k long, th long, s int, w int, key long, d1 long, d2 long"), "named")
    told = named.join(same, ["k", "th"], "left")
    once = told.filter("rows is not null").groupBy("k", "th", "s", "w", *digest).agg(F.max("rows").alias("rows"))
    found = cut(told.filter("rows is null").withColumn("rows", F.lit(1).cast("long")).unionByName(once), "stretches")
    drop(named)
    often = found.groupBy("key").agg(F.sum("rows").alias("n"), F.min("d1").alias("low"), F.max("d1").alias("high"), F.min("d2").alias("low2"), F.max("d2").alias("high2")).filter("n > 1")
    # Written first: then the join's sides are mere exchanges, and Spark splits a gram that a large part of the texts share.
    often = cut(often.select("key", ((F.col("low") != F.col("high")) | (F.col("low2") != F.col("high2"))).alias("mixed")), "often")
    again = cut(found.join(often, "key"), "again")
    drop(found, often)
    distinct = cut(again.filter("mixed").groupBy(*digest).agg(F.sum("rows").alias("n"), F.min(F.struct("k", "th", "s", "w")).alias("at")), "distinct")
    # Only crowded grams are joined, each in SALTS rows (so at most SALTS for each `most` stretches), and their stretches spread over those.
    crowd = distinct.groupBy("key").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > most)
    crowd = crowd.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), (1 + F.floor(F.col("kinds") / max(most, FEW))).alias("groups"))
    wanted = distinct.withColumn("salt", F.pmod("d1", F.lit(SALTS)).cast("int")).join(crowd, ["key", "salt"], "left")
    wanted = wanted.select(*digest, "groups", "at.*")
    bodies = docs.select("k", "th", F.col("text").cast("binary").alias("b"))
    several = bodies.join(same, ["k", "th"], "left_semi").groupBy("k", "th").agg(F.max("b").alias("b"))
    bodies = bodies.join(same, ["k", "th"], "left_anti").unionByName(several)
    piece = F.expr(f"substring(b, s + 1, w + {length - 1})")
    pieces = cut(wanted.join(bodies, ["k", "th"]).select(*digest, "groups", piece.alias("piece")), "pieces")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            ids: list = [[] for _ in range(5)]
            for (key, d1, d2, _), flags in zip(rows, long_repeats([r[3] for r in rows], length), strict=True):
                for o, m in zip(*_runs(flags), strict=True):
                    for x, v in zip(ids, (key, d1, d2, o, m), strict=True):
                        x.append(v)
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in ids[:3]), *(pa.array(x, pa.int32()) for x in ids[3:])], names=["key", "d1", "d2", "o", "m"])

        size = 0
        for batch in few_rows(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= block and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield out(held)

    n = partitions(docs.sparkSession)
    few = pieces.filter("groups is null").select(*digest, "piece").repartition(n, "key").sortWithinPartitions(*digest)
    indexed = few.mapInArrow(mark, "key long, d1 long, d2 long, o int, m int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digests of a stretch's windows by groups, in which equal ones meet: packed, with the windows' places."""
        import xxhash

        for batch in few_rows(batches):
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                raw = memoryview(batch.column(4)[i].as_buffer())
                ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[o : o + length]) for o in range(len(raw) - length + 1)]), "<u8").reshape(-1, 2)
                group = (ids[:, 0] >> np.uint64(8)) % np.uint64(batch.column(3)[i].as_py())
                order = np.argsort(group, kind="stable")
                edges = np.concatenate(([0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]))
                own = tuple(batch.column(c)[i].as_py() for c in range(3))
                rows += [(*own, int(group[order[lo]]), order[lo:hi].astype("<i4").tobytes(), ids[order[lo:hi]].tobytes()) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[*digest, "g", "o", "h"])

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of a group that another one equals. A group has about as many windows as `most` stretches."""
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            o, h = (np.frombuffer(b"".join([r[k] for r in held]), t) for k, t in ((4, "<i4"), (5, "<u8")))
            whose = np.repeat(np.arange(len(held)), [len(r[4]) // 4 for r in held])
            h = h.reshape(-1, 2)
            order = np.lexsort((h[:, 1], h[:, 0]))
            same = np.concatenate(([False], (h[order[1:]] == h[order[:-1]]).all(1), [False]))
            hit = order[same[:-1] | same[1:]]
            ids = [np.array([r[c] for r in held], np.int64)[whose[hit]] for c in range(3)]
            held.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(o[hit].astype(np.int32))], names=[*digest, "o"])

        for batch in few_rows(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0], row[3]) != (held[0][0], held[0][3]):
                    yield out()
                held.append(row)
        if held:
            yield out()

    each = pieces.filter("groups is not null").select(*digest, "groups", "piece").mapInArrow(windows, "key long, d1 long, d2 long, g long, o binary, h binary")
    met = each.repartition(n, "key", "g").sortWithinPartitions("key", "g")
    counted = met.mapInArrow(twice, "key long, d1 long, d2 long, o int").withColumn("m", F.lit(1))
    # Of runs of single windows, neighbours make one.
    from pyspark.sql import Window

    over = Window.partitionBy(*digest).orderBy("o")
    counted = counted.withColumn("g", F.col("o") - F.row_number().over(over)).groupBy(*digest, "g").agg(F.min("o").alias("o"), F.count("*").cast("int").alias("m")).drop("g")
    whole = distinct.filter("n > 1").select(*digest, F.lit(0).alias("o"), F.col("at.w").alias("m"))
    marks = indexed.unionByName(counted).unionByName(whole)
    hits = again.filter("mixed").join(marks, digest).select("k", "th", (F.col("s") + F.col("o")).alias("a"), (F.col("s") + F.col("o") + F.col("m") + length - 1).alias("z"))
    hits = hits.unionByName(again.filter("not mixed").select("k", "th", F.col("s").alias("a"), (F.col("s") + F.col("w") + length - 1).alias("z")))
    out = cut(hits.groupBy("k", "th").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("spans")), "spans")
    drop(again, distinct, pieces, same)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, with_text also kept (binary)
    and kept_text (with replacement characters where a removed string cuts a character).

    Texts are bytes of UTF-8; each byte of a string of `length` bytes that also begins elsewhere, in the same text or
    another, is removed. Null: empty. Texts under `length` bytes stay whole, equal rows lose the same bytes, and a null
    id is an id like others. What is left may end within a character, so it is bytes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.xxhash64(text, F.col("doc_id").isNull()).alias("th"), text.alias("text"))
    spans = repeated_spans(keyed.drop("doc_id"), length, gram, most, block)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string" * with_text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows: list[list] = [[] for _ in range(5)]
            lists = batch.column(2)
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                left, at, runs, end = [], 0, 0, -1
                if lists[i].is_valid:
                    a, z = (lists[i].values.field(f).to_numpy() for f in (0, 1))
                    z = np.maximum.accumulate(z)
                    new = np.flatnonzero(np.concatenate(([True], a[1:] > z[:-1])))
                    for s, end in zip(a[new].tolist(), z[np.concatenate((new[1:] - 1, [len(z) - 1]))].tolist(), strict=True):
                        left.append(raw[at:s])
                        at, runs = end, runs + 1
                left.append(raw[at:])
                kept = b"".join(left)
                for out, x in zip(rows, (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    out.append(x)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(rows[3], pa.string()), *([pa.array(rows[4], pa.binary()), pa.array([x.decode("utf-8", "replace") for x in rows[4]], pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "kept_text"][: 2 * with_text]])

    return keyed.join(spans, ["k", "th"], "left").select("doc_id", "text", "spans").mapInArrow(remove, schema)
