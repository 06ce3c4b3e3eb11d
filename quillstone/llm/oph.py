"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once. Its upper bits name one of 256 bins, and a bin keeps its smallest hash. An
empty bin copies a full one by optimal densification: it probes the bins in a random order of its own, a full cycle, and
takes the first that is full. Four low-order bits of each bin make the fingerprint; equal bits by chance
(1 in 16) are corrected for in the estimate of likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import SPACE, cut, partitions, text_or_empty

WORDS = 5
BINS = 256
BITS = 4
CHANCE = 1 / (1 << BITS)
LOW = (1 << 56) - 1
#: So many probes are written out, each tried only if those before it met empty bins; beyond them all full bins are ranked.
ATTEMPTS = 10


def _scramble(i: int) -> int:
    x = (i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 31) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 32


#: Each bin's probes: where they begin and how far they step; odd steps meet all bins.
STARTS = [_scramble(i) % BINS for i in range(BINS)]
STEPS = [_scramble(i) >> 20 & (BINS - 1) | 1 for i in range(BINS)]
INVERSES = [pow(d, -1, BINS) for d in STEPS]


def _fixed(values: list[int], kind: str = "int") -> Column:
    """A literal array, folded from one string."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def add_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`: the packed bins of column text as an array of longs, null for a text without words."""
    a, b, c = f"__{name}_a", f"__{name}_b", f"__{name}_c"
    words = F.array_remove(F.split(F.lower(F.col(text)), f"[{SPACE}]+"), "")
    df = df.withColumn(a, words)
    shingle = lambda i: F.xxhash64(*[F.get(F.col(a), i + k) for k in range(WORDS)])
    n = F.size(a)
    hashes = F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), shingle)).when(n > 0, F.array(F.xxhash64(F.array_join(a, " "))))
    df = df.withColumn(b, F.sort_array(hashes))
    first = lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(F.col(b), i - 1), 56))
    df = df.withColumn(c, F.filter(b, first)).drop(a, b)
    # Bins stand by the sign-extended upper bits, 0 to 255, so that sorted hashes are in the order of their bins. An empty bin is a hash without lower bits.
    bin_of = lambda x: F.shiftright(x, 56) + BINS // 2
    empty = F.array_except(_fixed(list(range(BINS)), "long"), F.transform(c, bin_of))
    df = df.withColumn(b, F.sort_array(F.concat(c, F.transform(empty, lambda i: F.shiftleft(i - BINS // 2, 56)))))
    is_full = lambda x: x.bitwiseAND(LOW) != 0
    def attempt(i: Column, t: int) -> Column:
        there = F.get(F.col(b), F.get(_fixed([(s + t * d) % BINS for s, d in zip(STARTS, STEPS, strict=True)]), i))
        return F.when(is_full(there), there)

    def far(i: Column) -> Column:
        # The attempt at which the probe meets each full bin, then that bin's hash: the smallest is of the first full bin met.
        met = lambda x: F.shiftleft(F.pmod((bin_of(x) - F.get(_fixed(STARTS), i)) * F.get(_fixed(INVERSES), i), F.lit(BINS)), 55).bitwiseOR(x.bitwiseAND(LOW >> 1))
        return F.array_min(F.transform(F.col(c), met))

    def bits(x: Column, i: Column) -> Column:
        # Each bin takes bits from its own place of the hash, so that a hash copied to many bins doesn't agree by chance in all.
        chosen = F.when(is_full(x), x).otherwise(F.coalesce(*[attempt(i, t) for t in range(ATTEMPTS)], far(i)))
        return F.call_function("shiftrightunsigned", chosen, F.get(_fixed([i % 13 * BITS for i in range(BINS)]), i)).bitwiseAND((1 << BITS) - 1)

    df = df.withColumn(a, F.when(F.size(c) > 0, F.transform(b, bits))).drop(b, c)
    each = 64 // BITS
    put = lambda acc, e: F.shiftleft(acc, BITS).bitwiseOR(e.bitwiseAND((1 << BITS) - 1))
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // each - 1)), lambda i: F.aggregate(F.slice(a, i * each + 1, each), F.lit(0).cast("long"), put))
    return df.withColumn(name, F.when(F.size(a) == BINS, packed)).drop(a)


def as_text(packed: str) -> Column:
    """Lower-case hex, a digit for each bin; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """The estimated resemblance of two packed fingerprints, 0 to 1; two without words are alike, one is like no other."""
    low = int("1" * 16, 16)

    def unlike(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(low).cast("long")))

    differ = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda acc, x: acc + x)
    alike = F.greatest(F.lit(0.0), (F.lit(1.0) - differ / BINS - CHANCE) / (1 - CHANCE))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(alike)


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with fingerprint: hex of the packed bins. Null text: empty, with an empty fingerprint."""
    return add_fingerprint(docs.select("doc_id", text_or_empty().alias("__text")), "__text", "fp").select("doc_id", as_text("fp").alias("fingerprint"))


def _followers(texts: DataFrame) -> DataFrame:
    """(k, z, th, next_k, next_z, next_th) of texts (k, z, th, each once): each text and the next one in descending order of k.

    Range partitions hold neighbours; only the first row of each partition is looked at across partitions.
    """
    order = ["z", F.desc("k"), "th"]
    keys = cut(texts.select("k", "z", "th").repartitionByRange(partitions(texts.sparkSession), *order).withColumn("p", F.spark_partition_id()), "order")
    down = Window.partitionBy("p").orderBy(*order)
    key = F.struct("k", "z", "th")
    rows = keys.select("p", "k", "z", "th", F.lead(key).over(down).alias("after"))
    firsts = keys.groupBy("p").agg(F.min(F.struct("z", (-F.col("k").cast("decimal(20)")).alias("m"), "th", key.alias("own"))).alias("f")).select("p", "f.own")
    # One row per partition.
    by_part, all_parts = Window.orderBy("p"), Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("p", F.coalesce(F.lead("own").over(by_part), F.first("own").over(all_parts)).alias("turn"))
    return rows.join(firsts, "p").withColumn("next", F.coalesce("after", "turn")).select("k", "z", "th", F.col("next.k").alias("next_k"), F.col("next.z").alias("next_z"), F.col("next.th").alias("next_th"))


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document's.

    Edited: the last floor(n_chars / 3) code points give way to as many first ones (or all) of the next document in
    descending doc_id; after the last comes the first. One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null id comes last in the order; rows that repeat an id follow
    one another by the hash of their text. Rows that repeat both are one text with a count: all but the last are followed by
    their own text. A table of one row is its own next. Null text: empty.
    """
    t = text_or_empty()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("z"), F.xxhash64(t).alias("th"), t.alias("t"))
    own, after = ["k", "z", "th"], ["next_k", "next_z", "next_th"]
    # The filter takes nothing away: with it every use of texts has their number too, so that all read the one shuffle of whole texts.
    texts = rows.groupBy(*own).agg(F.first("t").alias("t"), F.count("*").alias("times")).filter("times > 0")
    chain = cut(_followers(rows.select(*own).distinct()), "followers")
    n, third = F.char_length("t"), F.floor(F.char_length("t") / 3).cast("int")
    # What a text lends is cut to what its follower takes, so the follower's length goes to it first.
    takes = chain.join(cut(rows.select(*own, third.alias("take")).distinct(), "takes"), own).select(F.col("next_k").alias("k"), F.col("next_z").alias("z"), F.col("next_th").alias("th"), *[F.col(c).alias(f"of_{c}") for c in own], "take")
    heads = texts.join(takes, own).select(*[F.col(f"of_{c}").alias(c) for c in own], F.expr("substring(t, 1, take)").alias("head"))
    edited = lambda head: F.concat(F.expr("substring(t, 1, char_length(t) - floor(char_length(t) / 3))"), head)
    last = texts.join(heads, own).select(*own, "t", edited(F.col("head")).alias("edited"), F.lit(1).cast("long").alias("times"), F.lit(True).alias("last"))
    inner = texts.filter("times > 1").select(*own, "t", edited(F.expr("substring(t, 1, floor(char_length(t) / 3))")).alias("edited"), (F.col("times") - 1).alias("times"), F.lit(False).alias("last"))
    both = last.unionByName(inner).withColumn("n", n.cast("long"))
    marked = add_fingerprint(add_fingerprint(both.withColumn("edited_sha256", F.sha2("edited", 256)), "t", "fp"), "edited", "efp")
    marked = cut(marked.select(*own, "n", "edited_sha256", "fp", "efp", "times", "last"), "fingerprints")
    firsts = marked.filter("last")
    nexts = chain.join(firsts.select(*[F.col(c).alias(f"next_{c}") for c in own], F.col("fp").alias("nfp")), after).select(*own, F.lit(True).alias("last"), "nfp", F.lit(True).alias("met"))
    out = marked.join(nexts, [*own, "last"], "left").withColumn("nfp", F.when(F.col("met"), F.col("nfp")).otherwise(F.col("fp")))
    out = out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(
        F.when(~F.col("z"), F.col("k")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", as_text("fp").alias("fingerprint"), as_text("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "nfp").alias("near_next"),
    )
