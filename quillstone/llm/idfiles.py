"""Token-id files: blocks of ids are transposed into byte or bit planes, each plane is compressed on its own.

A file's rows are segments, each a run of whole documents in ascending doc_id order that can be read alone:

    magic 'QPL1' | u32 documents | u64 ids | u32 ids a block | u8 bits in a plane (8 or 1) | u8 planes a block
    | u32 length, then zstandard of: i64 doc_id of each document, u8 that is 1 for a null id, u32 ids of each document
    | the chunk index: u32 compressed length of each plane of each block | the planes

The last block is filled up with zeros. Beside the segment, its row has its part, its number in the part and its
counts of documents and ids, which are the index across segments: a reader gets it without touching the planes.
Segments lie in Parquet files, so that Spark's committer writes them to any store and a lost task leaves nothing behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import few_bytes, partitions
from quillstone.llm.pieces import Pieces, ids_of, library_cache

MAGIC = b"QPL1"
HEAD = struct.Struct("<4sIQIBBI")
BLOCK = 1 << 16
SEGMENT = 1 << 20
SCHEMA = "part int, seq int, n_docs int, n_ids long, data binary"


def to_planes(block: np.ndarray, planes: int, bits: int) -> list[bytes]:
    """The planes of a block of uint32 ids, the lowest first."""
    octets = np.ascontiguousarray(block.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if bits == 8:
        return [octets[p].tobytes() for p in range(planes)]
    return [np.packbits(octets[p // 8] >> (p % 8) & 1).tobytes() for p in range(planes)]


def from_planes(planes: list[bytes], bits: int, size: int) -> np.ndarray:
    out = np.zeros((4, size), np.uint8)
    for p, data in enumerate(planes):
        if bits == 8:
            out[p] = np.frombuffer(data, np.uint8)
        else:
            out[p // 8] |= np.unpackbits(np.frombuffer(data, np.uint8)) << (p % 8)
    return np.ascontiguousarray(out.T).reshape(-1).view("<u4")


def pack(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, bits: int = 8, block: int = BLOCK) -> bytes:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    top = int(ids.max()) if len(ids) else 0
    planes = max(1, -(-max(1, top.bit_length()) // bits))
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + sizes.astype("<u4").tobytes()
    keys = squeeze(keys)
    filled = np.zeros(-(-len(ids) // block) * block, np.uint32)
    filled[: len(ids)] = ids
    out = [squeeze(p) for k in range(0, len(filled), block) for p in to_planes(filled[k : k + block], planes, bits)]
    index = np.array([len(x) for x in out], "<u4").tobytes()
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(ids), block, bits, planes, len(keys)), keys, index, *out])


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, ids of each document, all ids."""
    import zstandard

    loose = zstandard.ZstdDecompressor().decompress
    magic, docs, n, block, bits, planes, length = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEAD.size + length
    keys = loose(data[HEAD.size : at])
    doc_ids = [None if gone else d for d, gone in zip(np.frombuffer(keys, "<i8", docs).tolist(), keys[8 * docs : 9 * docs], strict=True)]
    sizes = np.frombuffer(keys, "<u4", docs, 9 * docs)
    blocks = -(-n // block)
    index = np.frombuffer(data, "<u4", blocks * planes, at).tolist()
    at += 4 * len(index)
    out, held = [], []
    for size in index:
        held.append(loose(data[at : at + size]))
        at += size
        if len(held) == planes:
            out.append(from_planes(held, bits, block))
            held = []
    return doc_ids, sizes, (np.concatenate(out) if out else np.zeros(0, np.uint32))[:n]


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, bits: int = 8) -> None:
    """Encode docs (doc_id, text; null text: empty) and write their ids, each document closed by end_id, to path.

    Documents stand in ascending doc_id order (null first; equal ids by text). An empty table gives no segments.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seq = library_cache(tokenizer), TaskContext.get().partitionId(), 0
        keys: list = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def row():
            nonlocal seq
            ids, size = np.concatenate(held), np.concatenate(sizes)
            out = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(keys)], pa.int32()), "n_ids": [len(ids)], "data": [pack(keys, size, ids, bits)]}
            )
            seq += 1
            for x in (keys, sizes, held):
                x.clear()
            return out

        for batch in few_bytes(batches, rows=10_000, size=8 << 20):
            ids, offsets = ids_of(Pieces(batch.column("text"), keep_runs=True), cache)
            ids, offsets = np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
            doc_ids, first = batch.column("doc_id").to_pylist(), 0
            while first < len(doc_ids):
                room = SEGMENT - sum(map(len, held))
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + room, "right")) - 1)
                keys += doc_ids[first:last]
                sizes.append(np.diff(offsets[first : last + 1]))
                held.append(ids[offsets[first] : offsets[last]])
                first = last
                if sum(map(len, held)) >= SEGMENT or first < len(doc_ids):
                    yield row()
        if keys:
            yield row()

    n = partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.repartitionByRange(n, F.asc_nulls_first("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text").mapInArrow(segments, SCHEMA)
    rows.write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """What write_ids wrote: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the ids (array of int)."""
    schema = "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "data")), strict=True):
                doc_ids, sizes, ids = unpack(data)
                ends = np.cumsum(sizes.astype(np.int64))
                view = memoryview(ids.astype("<u4").tobytes())
                out = {
                    "part": pa.array([part] * len(doc_ids), pa.int32()), "seq": pa.array([seq] * len(doc_ids), pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()),
                    "before": ends - sizes, "n_tokens": sizes.astype(np.int64), "ids_crc32": [zlib.crc32(view[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)],
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), ids.astype(np.int32))
                yield pa.RecordBatch.from_pydict(out)

    files = spark.read.schema(SCHEMA).parquet(path)
    rows = files.select("part", "seq", "data").mapInArrow(read, schema)
    # The index alone: sums by part, of which there are as many as writing tasks, then sums within parts.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = files.select("part", "seq", within.alias("within"), "n_ids").join(parts, "part").select("part", "seq", (F.col("first") + F.col("within")).alias("base"))
    rows = rows.join(starts, ["part", "seq"]).withColumn("start", F.col("base") + F.col("before"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
