"""N-gram Jaccard join by grouped prefixes.

A document's set: its distinct shingles of four words, as 64-bit hashes. All sets are put in one order of hashes, rare ones
first. Two sets can only be alike enough if their prefixes in that order share a hash, and the places of the first hash
that they share bound how much they can have in common.

1. Equal sets collapse to one, and sets with the same prefix and size to one group.
2. In each hash's list of groups, those of about one size meet the group with the smallest place (its hub), if the places
   allow it. Hubs are verified against what they meet, members against the head of their group. Linked sets are joined to components.
3. Each list pairs the groups that aren't yet all of one component, as size and places allow; group pairs are made
   distinct, expanded to the members that stand in different components, and these are verified too.

So each pair that prefixes, sizes and places admit is either verified or joined by verified links already: no component is
lost, and a large family of near copies is never paired with itself in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, drop, few_rows, partitions, whole_row, word_spans
from quillstone.llm.components import components

WORDS = 4
#: Similarity in hundredths.
LIKE = 85
#: Counters for the frequency of hashes, in SLICES rows; fixed, so what is broadcast is a byte for each.
COUNTERS, SLICES = 1 << 20, 64
#: Bits of the filter for texts whose sets are wanted again; fixed, so what is broadcast is WANTED / 8 bytes.
WANTED = 1 << 23
#: A hub's pairs are verified in parts of about so many.
PART = 64
CLASSES, MANY = 128, 65535

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xCA5A826395121157)
    return x ^ (x >> np.uint64(32))


def _power(k: int, n: int) -> np.ndarray:
    if len(_powers[k]) < n:
        m = max(n, 2 * len(_powers[k]), 1 << 15)
        _powers[k] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, (BASE, INVERSE)[k], np.uint64))), dtype=np.uint64)
    return _powers[k][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, all at once, from running sums of a polynomial."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(0, len(data)), dtype=np.uint64)))
    return _mix((sums[end] - sums[start]) * _power(1, len(data) + 1)[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of a text with fewer words, of the whole sequence."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    h = span_hashes(data, start, end)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out * np.uint64(BASE) + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def prefix_size(n: int, like: int = LIKE) -> int:
    return n - -(-like * n // 100) + 1


def _long(data: bytes) -> int:
    return int.from_bytes(data[:8], "little", signed=True)


def hash_levels(docs: DataFrame, words: int) -> np.ndarray:
    """For each counter of hashes, a level from 0 to 255 that grows with how often its hashes occur in all texts.

    Levels are in quarters of what chance makes a counter vary by, and above a bound in logarithms. They settle the
    order only: any order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held = np.zeros(COUNTERS, np.uint32)
        for batch in few_rows(batches):
            found = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            held += np.bincount((np.concatenate(found) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": [squeeze(x.tobytes()) for x in np.split(held, SLICES)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        loose = zstandard.ZstdDecompressor().decompress
        total = sum((np.frombuffer(loose(x), np.uint32).astype(np.int64) for x in rows["counts"]), np.zeros(COUNTERS // SLICES, np.int64))
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "counts": [total.tobytes()]})

    parts = docs.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    total = np.zeros(COUNTERS, np.int64)
    for row in parts:
        total.reshape(SLICES, -1)[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    above = (total - total.mean()) / max(1.0, total.mean() ** 0.5)
    return np.clip(np.where(above < 24, 64 + 4 * above, 160 + 8 * np.log2(np.maximum(above, 24) / 24)), 0, 255).astype(np.uint8)


def in_order(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set in the order of all: by level, then by value."""
    return hashes[np.argsort(levels[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")]


def class_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall in each of CLASSES classes. The top value means as many or more."""
    n = np.bincount((hashes >> np.uint64(40) & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
    return np.minimum(n, MANY).astype("<u2")


def _possible(pairs: DataFrame, sets: DataFrame, like: int) -> DataFrame:
    """The pairs (x, y) that their class counts don't rule out: two sets share at most the smaller count of each class."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, CLASSES).astype(np.int64) for c in (4, 5))
            most = np.minimum(a, b).sum(1)
            total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            keep = pa.array((100 * most >= like * (total - most)) | ((a == MANY) & (b == MANY)).any(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    x, y = (sets.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("classes").alias(f"c{c}")) for c in "xy")
    return pairs.join(x, "x").join(y, "y").select("x", "y", "nx", "ny", "cx", "cy").mapInArrow(check, "x long, y long")


def _slots(k: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (_mix(k.astype(np.int64).view(np.uint64) * np.uint64(BASE) + t.astype(np.int64).view(np.uint64)) & np.uint64(WANTED - 1)).astype(np.int64)


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A bit for each slot that a key (k, t) falls in; WANTED bits reach the driver, whatever the number of keys."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(WANTED, bool)
        for batch in batches:
            bits[_slots(batch.column(0).to_numpy(), batch.column(1).to_numpy())] = True
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "bits": [np.packbits(x).tobytes() for x in np.split(bits, SLICES)]})

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]]).tobytes()]})

    held = np.zeros((SLICES, WANTED // SLICES // 8), np.uint8)
    for row in keys.select("k", "t").mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInPandas(join, "slice int, bits binary").collect():
        held[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return held.reshape(-1)


def _sets_again(held: DataFrame, sets: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(sid, hashes) of the sids in held: rebuilt from a set's first row (k, t) and known again by digest, so ids needn't be distinct."""
    wanted = cut(sets.select("sid", "k", "t", "d1", "d2").join(held, "sid"), "wanted")
    if wanted.count() > WANTED // 8:
        # Too many for the filter to tell much: the texts are joined instead.
        texts = texts.join(wanted.select("k", "t"), ["k", "t"], "left_semi")
    shared = texts.sparkSession.sparkContext.broadcast(_filter_bits(wanted))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            slot = _slots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            want = (shared.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
            found = [shingle_set(t, words) for t in batch.column(2).filter(pa.array(want)).to_pylist()]
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([_long(d) for d in digests], pa.int64()), pa.array([_long(d[8:]) for d in digests], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["d1", "d2", "hashes"])

    rebuilt = texts.select("k", "t", "text").mapInArrow(rebuild, "d1 long, d2 long, hashes binary")
    out = cut(rebuilt.join(wanted.select("sid", "d1", "d2"), ["d1", "d2"]).select("sid", "hashes").dropDuplicates(["sid"]), "hashes")
    drop(wanted)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int, like: int) -> DataFrame:
    """The pairs (x, y) whose sets are alike enough, as links (u, v): ruled out by class counts or compared in full.

    Each y gets the sets of its x in parts, and its own once a part, so many x of one y spread over tasks.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, own = None, None
        for batch in few_rows(batches):
            u, v, hashes = [], [], batch.column(2)
            for i, (b, a) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                p = np.frombuffer(hashes[i].as_buffer(), np.uint64)
                if a is None:
                    y, own = b, p.copy()
                    continue
                assert y == b
                same = len(np.intersect1d(p, own, assume_unique=True))
                if 100 * same >= like * (len(p) + len(own) - same):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    pairs = cut(_possible(pairs, sets, like), "pairs")
    if pairs.isEmpty():
        return pairs.select(F.col("x").alias("u"), F.col("y").alias("v"))
    hashes = _sets_again(pairs.select(F.col("x").alias("sid")).unionByName(pairs.select(F.col("y").alias("sid"))).distinct(), sets, texts, words)
    parts = pairs.groupBy("y").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    met = pairs.join(hashes.withColumnRenamed("sid", "x"), "x").join(parts, "y").select("y", F.pmod(F.xxhash64("x"), "parts").cast("int").alias("part"), "x", "hashes")
    own = parts.join(hashes.withColumnRenamed("sid", "y"), "y").select("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("x"), "hashes")
    both = met.unionByName(own).repartition(partitions(pairs.sparkSession), "y", "part").sortWithinPartitions("y", "part", F.asc_nulls_first("x"))
    links = cut(both.select("y", "x", "hashes").mapInArrow(check, "u long, v long"), "links")
    drop(pairs, hashes)
    return links


def _fits(x: str, y: str, like: int) -> Column:
    """Whether sizes and the places of a shared hash let two sets be alike enough, if it is the first that they share."""
    return F.least(F.col(f"n{x}") - F.col(f"p{x}"), F.col(f"n{y}") - F.col(f"p{y}")) * (100 + like) >= (F.col(f"n{x}") + F.col(f"n{y}")) * like


def _lists(heads: DataFrame, like: int) -> DataFrame:
    """The lists of hashes that more than one group holds, as rows (token, g, n, p), and with kind 0 the pairs (g, h) of groups and hubs.

    Rows are dealt by ranges, so a long list is many tasks' work, each with hubs of its own. A list of one row at the end of a
    range may have its others in the next, so it stays.
    """
    band = F.floor(F.log("n") / float(np.log(100 / like))).cast("int")
    tokens = heads.select("g", "n", F.posexplode("prefix").alias("p", "token")).select("token", "g", "n", "p", band.alias("band"))
    dealt = tokens.repartitionByRange(partitions(heads.sparkSession), "token", "band", "p", "g").sortWithinPartitions("token", "band", "p", "g")
    schema = "kind int, token long, g long, n int, p int, h long"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "token", "g", "n", "p", "h"]
        held, start, hub = None, True, None

        def rows(kind: int, t, g, n, p, h) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(t), kind, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in (t, g, n, p, h))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            t, g, n, p, band = (batch.column(c).to_numpy() for c in range(5))
            # The last row waits, since only the next batch tells whether it is alone.
            if held is not None:
                t, g, n, p, band = (np.concatenate(([x], y)) for x, y in zip(held[:5], (t, g, n, p, band), strict=True))
            before = np.concatenate(([start if held is None else held[5]], t[1:] == t[:-1]))
            shared = before[:-1] | (t[1:] == t[:-1])
            held, start = (t[-1], g[-1], n[-1], p[-1], band[-1], before[-1]), False
            yield rows(1, t[:-1][shared], g[:-1][shared], n[:-1][shared], p[:-1][shared], g[:-1][shared])
            first = np.concatenate(([True], (t[1:] != t[:-1]) | (band[1:] != band[:-1])))
            at = np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
            gh, nh, ph = g[at], n[at].astype(np.int64), p[at]
            if hub is not None and hub[:2] == (t[0], band[0]):
                same = at == 0
                gh, nh, ph = np.where(same, hub[2], gh), np.where(same, hub[3], nh), np.where(same, hub[4], ph)
            hub = (t[-1], band[-1], gh[-1], nh[-1], ph[-1])
            meet = (g != gh) & ((100 + like) * np.minimum(n - p, nh - ph) >= like * (n + nh))
            pair = np.unique(np.stack([g[meet], gh[meet]], 1), axis=0)
            zero = np.zeros(len(pair), np.int32)
            yield rows(0, zero.astype(np.int64), pair[:, 0], zero, zero, pair[:, 1])
        if held is not None:
            yield rows(1, *(np.array([x]) for x in (*held[:4], held[1])))

    return cut(dealt.mapInArrow(each, schema), "lists")


#: What tells rows apart: whether the id is null (z), the id (k) and a hash of the text (t). Rows alike in all are copies. Null ids come last.
ROW = ["z", "k", "t"]


def _row_key() -> list[Column]:
    text = F.col("text").cast("string")
    return [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(text, F.col("doc_id").isNull())]


def _unsettled(lists: DataFrame, members: DataFrame, like: int) -> DataFrame:
    """Pairs of sets (x, y) in different components (members: g, sid, c), of groups whose prefixes, sizes and places admit them."""
    kinds = cut(members.select("g", "c").distinct(), "kinds")
    spans = cut(kinds.groupBy("g").agg(F.min("c").alias("c"), F.max("c").alias("d")), "spans")
    apart = lists.join(spans, "g")
    # Nothing is left of a list that is all of one component.
    largest = apart.filter("c = d").groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("c", F.struct("m", "c")).alias("top"))
    mixed = apart.groupBy("token").agg(F.min("c").alias("low"), F.max("d").alias("high")).filter("low != high").select("token").join(largest, "token", "left")
    split = cut(apart.join(mixed, "token").withColumn("out", ~F.coalesce((F.col("c") == F.col("top")) & (F.col("d") == F.col("top")), F.lit(False))), "apart")
    a = split.filter("out").select("token", F.col("g").alias("gx"), F.col("n").alias("nx"), F.col("p").alias("px"), F.col("c").alias("cx"), F.col("d").alias("dx"))
    b = split.select("token", F.col("g").alias("gy"), F.col("n").alias("ny"), F.col("p").alias("py"), F.col("c").alias("cy"), F.col("d").alias("dy"), "out")
    settled = (F.col("cx") == F.col("dx")) & (F.col("cx") == F.col("cy")) & (F.col("cy") == F.col("dy"))
    across = a.join(b, "token").filter(~settled & (~F.col("out") | (F.col("gx") < F.col("gy"))) & _fits("x", "y", like)).select(F.least("gx", "gy").alias("gx"), F.greatest("gx", "gy").alias("gy")).distinct()
    within = spans.filter("c != d").select(F.col("g").alias("gx"), F.col("g").alias("gy"))
    named = lambda f, e: f.select(*[F.col(c).alias(c + e) for c in f.columns])
    # Components first, then members: those of one component never meet.
    pairs = across.unionByName(within).join(named(kinds, "x"), "gx").join(named(kinds, "y"), "gy").filter("cx != cy and (gx != gy or cx < cy)")
    pairs = pairs.join(named(members, "x"), ["gx", "cx"]).join(named(members, "y"), ["gy", "cy"])
    out = cut(pairs.select(F.least("sidx", "sidy").alias("y"), F.greatest("sidx", "sidy").alias("x")), "unsettled")
    drop(kinds, spans, split)
    return out


def _components(docs: DataFrame, words: int, like: int) -> DataFrame:
    """One row per row of docs: its key (ROW), n and f, the key of the first row of its component (null without words)."""
    spark = docs.sparkSession
    texts = docs.select(*[c.alias(n) for n, c in zip(ROW, _row_key(), strict=True)], F.col("text").cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(hash_levels(texts, words))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            n, d1, d2, p1, p2, prefix, classes = [], [], [], [], [], [], []
            for text in batch.column(3).to_pylist():
                found = shingle_set(text, words)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                first = in_order(found, levels.value)[: prefix_size(len(found), like) if len(found) else 0]
                group = hashlib.blake2b(first.tobytes() + len(found).to_bytes(8, "little"), digest_size=16).digest()
                n.append(len(found))
                for out, x in ((d1, digest), (d2, digest[8:]), (p1, group), (p2, group[8:])):
                    out.append(_long(x))
                prefix.append(first.view(np.int64))
                classes.append(class_counts(found).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (d1, d2, p1, p2)), pa.array(prefix, pa.list_(pa.int64())), pa.array(classes, pa.binary())], names=[*ROW, "n", "d1", "d2", "p1", "p2", "prefix", "classes"])

    signed = cut(texts.mapInArrow(signatures, "z boolean, k long, t long, n int, d1 long, d2 long, p1 long, p2 long, prefix array<long>, classes binary"), "signatures")
    # Sets are numbered, since ids may be null or repeat; the numbers stand once they are written.
    first = [F.first(c).alias(c) for c in ("n", "p1", "p2", "prefix", "classes")]
    sets = signed.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct(*ROW)).alias("f"), *first)
    sets = cut(sets.select(F.monotonically_increasing_id().alias("sid"), "d1", "d2", "f.z", "f.k", "f.t", "n", "p1", "p2", "prefix", "classes"), "sets")
    # A group is named after its first set, its head.
    many = sets.groupBy("p1", "p2").agg(F.min("sid").alias("g"), F.count("*").alias("m")).filter("m > 1")
    rest = cut(sets.select("sid", "p1", "p2").join(many, ["p1", "p2"]).filter("sid != g").select("sid", "g"), "rest")
    lists = _lists(sets.select(F.col("sid").alias("g"), "n", "prefix").join(rest.select(F.col("sid").alias("g")), "g", "left_anti"), like)

    met = lists.filter("kind = 0").select(F.col("g").alias("x"), F.col("h").alias("y")).unionByName(rest.select(F.col("sid").alias("x"), F.col("g").alias("y"))).distinct()
    links = _verified(met, sets, texts, words, like)
    groups = sets.select("sid").join(rest, "sid", "left").select("sid", F.coalesce("g", "sid").alias("g"))
    members = cut(groups.join(components(links).withColumnRenamed("id", "sid"), "sid", "left").select("g", "sid", F.coalesce("root", "sid").alias("c")), "members")
    pairs = _unsettled(lists.filter("kind = 1").select("token", "g", "n", "p"), members, like)
    more = _verified(pairs.select("x", "y").distinct(), sets, texts, words, like)
    whole = components(links.unionByName(more))
    drop(lists, rest, members, pairs)
    firsts = whole.join(sets.select(F.col("sid").alias("id"), *ROW), "id").groupBy("root").agg(F.min(F.struct(*ROW)).alias("f"))
    linked = whole.join(firsts, "root").select(F.col("id").alias("sid"), "f")
    named = sets.select("d1", "d2", "sid", F.struct(*ROW).alias("own")).join(linked, "sid", "left").select("d1", "d2", F.coalesce("f", "own").alias("f"))
    out = signed.select(*ROW, "n", "d1", "d2").join(named, ["d1", "d2"], "left").select(*ROW, "n", "f")
    out = cut(out, "components")
    drop(signed, sets, links, more)
    return out


def jaccard_components(docs: DataFrame, words: int = WORDS, like: int = LIKE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased. Documents whose sets are at least `like` hundredths alike
    are linked; component_id is the smallest doc_id that links reach. Null and wordless texts have no shingles and are
    linked with nothing. Rows that repeat an id are compared like any other; a null id takes part, but is the smallest
    of a component only where all its ids are null (then component_id is null).
    """
    out = _components(docs, words, like)
    whose = F.coalesce("f", F.struct(*ROW))
    return out.select(F.when(~F.col("z"), F.col("k")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(~whose["z"], whose["k"]).alias("component_id"))


def keep_first(docs: DataFrame, words: int = 5, like: int = 80) -> DataFrame:
    """docs with one row of each component, one with its smallest doc_id (null where it has no other), and all wordless rows; their columns as they are."""
    rows = _components(docs, words, like).filter("f is not null").withColumn("first", F.struct(*ROW) == F.col("f"))
    gone = rows.filter("not first").select(*ROW).distinct()
    copies = rows.filter("first").groupBy(*ROW).count().filter("count > 1").select(*ROW)
    # The table's own columns travel in a struct, so that their names can't clash.
    left = docs.select(whole_row(docs).alias("row"), *[c.alias(n) for n, c in zip(ROW, _row_key(), strict=True)]).join(gone.hint("merge"), list(ROW), "left_anti")
    if copies.isEmpty():
        return left.select("row.*")
    # Copies under one id are alike in all keys: one of them stays.
    one = left.join(copies, list(ROW), "left_semi").dropDuplicates(list(ROW))
    return left.join(copies, list(ROW), "left_anti").unionByName(one).select("row.*")
