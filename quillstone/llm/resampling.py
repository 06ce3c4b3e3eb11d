"""Quality by importance resampling: how much likelier a text is under a model of target text than under one of raw text.

Both models are generative, over hashed n-grams of bytes and of word identities: the target's from documents labelled good, the
raw one from all documents. A document's log weight is the mean of its n-grams' log ratios times a fixed number of n-grams: summed
over whole texts, small errors of the models would weigh more in long clean documents than all signs of junk in short ones.
Documents are drawn without replacement by Gumbel top-k: log weight plus Gumbel noise, the k largest stay. Unless it is
given, k is the number of documents whose weight is at least the one that, of the labelled documents held out of the fit,
keeps nearly all good ones and drops the most bad ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, few_rows, whole_row, word_spans
from quillstone.llm.ngram_join import span_hashes

BUCKETS, SLICES = 1 << 17, 64
GRAMS = (2, 3)
#: Sets the n-grams of words apart from those of bytes.
WORDS_SEED = 0x51ED2701
#: At most so many labelled documents are used, those with the smallest hash of their id: half to fit, half to set k.
LABELLED = 20_000
#: A log weight is that of so many n-grams like the document's own.
SCALE = 256
#: Scale of the Gumbel noise: with 1, the k largest keys are a draw without replacement in which each next document is taken with odds exp(log weight).
TEMPERATURE = 1.0
#: The share of held-out good documents that the cut must keep.
KEEP = 0.995
#: A threshold is narrowed down by histograms of so many cells, until so few keys are left.
CELLS = 4096


def _bucket(gram: np.ndarray) -> np.ndarray:
    return gram * np.uint32(0x9E3779B1) >> np.uint32(32 - 17)


def buckets_of(text: str | None) -> np.ndarray:
    """The buckets of all n-grams of a text: of its bytes, and of its words up to renaming (which of three words in a row are the same)."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    data, out = raw.astype(np.uint32), []
    for n in GRAMS:
        if len(data) >= n:
            gram = np.full(len(data) - n + 1, n, np.uint32)
            for k in range(n):
                gram = gram * np.uint32(257) + data[k : k + len(gram)]
            out.append(_bucket(gram))
    words = span_hashes(raw, *word_spans(raw))
    if len(words) > 2:
        last, middle, first = words[2:], words[1:-1], words[:-2]
        same = (last == middle) + 2 * (last == first).astype(np.uint32) + 4 * (middle == first).astype(np.uint32)
        out.append(_bucket(np.uint32(WORDS_SEED) + same.astype(np.uint32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts: summed in tasks, then by slices; BUCKETS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in few_rows(batches):
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 256):
                held += np.bincount(np.concatenate([buckets_of(t) for t in texts[i : i + 256]]), minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": [x.tobytes() for x in np.split(held, SLICES)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(x, np.int64) for x in rows["counts"]), np.zeros(BUCKETS // SLICES, np.int64))
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "counts": [total.tobytes()]})

    total = np.zeros(BUCKETS, np.int64)
    for row in docs.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        total.reshape(SLICES, -1)[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return total


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    share = lambda c: np.log(c + 1.0) - math.log(c.sum() + len(c))
    return share(target) - share(raw)


def log_weight(text: str | None, ratios: np.ndarray, scale: float = SCALE) -> float | None:
    """None for a text without n-grams, of which the models say nothing."""
    found = buckets_of(text)
    return scale * float(ratios[found].mean()) if len(found) else None


def best_cut(weights: np.ndarray, good: np.ndarray, keep: float = KEEP) -> float:
    """The weight from which on documents count as good: of those that keep at least `keep` of the good ones, one that drops the most bad ones.

    Among equals, the middle of the widest gap. With one kind only, or none, there is nothing to tell apart: minus infinity keeps all.
    """
    if good.all() or not good.any():
        return -math.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    below_bad, below_good = np.concatenate(([0], np.cumsum(~g))), np.concatenate(([0], np.cumsum(g)))
    fair = np.flatnonzero(below_good <= (1 - keep) * g.sum())
    top = fair[below_bad[fair] == below_bad[fair].max()]
    low, high = np.concatenate(([w[0] - 1], w)), np.concatenate((w, [w[-1] + 1]))
    best = top[np.argmax(high[top] - low[top])]
    return float((low[best] + high[best]) / 2)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, scale: float = SCALE) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket and the cut. Labels: doc_id, quality (1 is good); null labels and ids are left out."""
    chosen = labels.select("doc_id", (F.col("quality") == 1).alias("good")).dropna().groupBy("doc_id").agg(F.max("good").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)))
    # At most `labelled` ids, so the broadcast is bounded.
    texts = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id"), "labelled")
    ratios = log_ratios(gram_counts(texts.filter("good and half = 0")), gram_counts(docs))
    held = weigh(texts.filter("half = 1").select("good", "text"), ratios, scale).select("good", "log_weight").dropna().toPandas()
    return ratios, best_cut(held["log_weight"].to_numpy(float), held["good"].to_numpy(bool))


def weigh(docs: DataFrame, ratios: np.ndarray, scale: float = SCALE) -> DataFrame:
    """docs with log_weight beside their own columns (of which none may have that name), in place."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out = pa.array([log_weight(t, shared.value, scale) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "log_weight"])

    from pyspark.sql import types as T

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField("log_weight", T.DoubleType())]))


def gumbel_key(seed: int, temperature: float = TEMPERATURE) -> Column:
    """log_weight and noise that hangs on the id and the text."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + 0.5) / float(1 << 53)
    return F.col("log_weight") - temperature * F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest of column key, by histograms; None for k = 0."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if k <= 0 or low is None:
        return None
    inside = keys
    while low < high:
        step = (high - low) / CELLS
        if low + step == low:
            break
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("key") - low) / step)).cast("int")
        rows = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for row in sorted(rows, key=lambda r: -r["cell"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        low, high = row["low"], row["high"]
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
    return low


def resample(docs: DataFrame, labels: DataFrame, seed: int = 42, k: int | None = None, temperature: float = TEMPERATURE, scale: float = SCALE) -> DataFrame:
    """docs' columns as struct row, log_weight, key and kept.

    k: how many documents to draw; None: as many as weigh at least the labelled cut (the mode for cleaning: weights then lie far apart on both sides of the cut, so that noise hardly moves any document across
    it). With a k below that and a smaller scale the draw is a sample by weight, in which lighter documents take the place of heavier ones. temperature 0 makes the draw a plain
    choice of the k heaviest. A text without n-grams (null, empty, one byte) has no weight and isn't kept. Keys that tie with
    the k-th are all kept. Rows that repeat an id and text have the same noise. Without labels of both kinds all documents
    with a weight are kept. An empty table gives an empty result.
    """
    ratios, least = fit(docs, labels, scale=scale)
    plain = docs.select(whole_row(docs).alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    scores = cut(weigh(plain.drop("row"), ratios, scale).select(gumbel_key(seed, temperature).alias("key"), "log_weight").dropna(), "keys")
    last = kth_largest(scores, scores.filter(F.col("log_weight") >= least).count() if k is None else min(k, scores.count()))
    kept = F.lit(False) if last is None else F.coalesce(F.col("key") >= last, F.lit(False))
    return weigh(plain, ratios, scale).withColumn("key", gumbel_key(seed, temperature)).select("row", "log_weight", "key", kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, seed: int = 42, k: int | None = None) -> DataFrame:
    return resample(docs, labels, seed, k).filter("kept").select("row.*")
