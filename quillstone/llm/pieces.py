"""Cutting texts where no tokenizer's token can cross, so that each distinct piece is tokenised once.

Arrow's kernels cut and count the pieces of a whole batch; Python sees the distinct ones only, and a bounded cache
keeps them from batch to batch.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Two white-space characters in a row: a tokenizer that tells runs of white space apart must see the whole text.
RUNS = r"[\pZ\t-\r\x1c-\x1f\x{85}]{2}"


class Pieces:
    """codes[offsets[d]:offsets[d + 1]] are the numbers in `distinct` of text d's pieces; `whole`: texts left uncut (no pieces)."""

    def __init__(self, texts: pa.Array, keep_runs: bool, cut_spaces: bool = True):
        """cut_spaces: before each space; otherwise only before a run of spaces, which stays with the word that follows it."""
        texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
        uncut = pc.match_substring(texts, "\x00")
        if keep_runs:
            uncut = pc.or_(uncut, pc.match_substring_regex(texts, RUNS))
        self.whole = np.flatnonzero(uncut.to_numpy(zero_copy_only=False))
        if len(self.whole):
            self.texts = texts
            texts = pc.if_else(uncut, "", texts)
        marked = pc.replace_substring(texts, "\n", "\x00\n\x00")
        marked = pc.replace_substring(marked, " ", "\x00 ") if cut_spaces else pc.replace_substring_regex(marked, "( +)", "\x00\\1")
        lists = pc.split_pattern(marked, "\x00")
        self.offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.distinct = coded.dictionary.to_pylist()

    def uncut(self) -> list[str]:
        return [self.texts[i].as_py() for i in self.whole.tolist()]


class Cache:
    """What `work` makes of each distinct piece. At `most` are held: when half as many have come or been asked for again, the half before is given up."""

    def __init__(self, work: Callable[[list[str]], list], most: int = 800_000):
        self.work, self.most, self.held, self.before = work, most, {}, {}

    def of(self, distinct: list[str]) -> list:
        found = list(map(self.held.get, distinct))
        others = [i for i, x in enumerate(found) if x is None]
        if not others:
            return found
        texts = [distinct[i] for i in others]
        values = list(map(self.before.get, texts))
        if missing := [t for t, x in zip(texts, values, strict=True) if x is None]:
            made = iter(self.work(missing))
            values = [next(made) if x is None else x for x in values]
        for i, x in zip(others, values, strict=True):
            found[i] = x
        kept, half = [(t, x) for t, x in zip(texts, values, strict=True) if len(t) <= 64], max(1, self.most // 2)
        while kept:
            if len(self.held) >= half:
                self.before, self.held = self.held, {}
            room = half - len(self.held)
            self.held.update(kept[:room])
            kept = kept[room:]
        return found


def ids_of(pieces: Pieces, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """All ids (uint32) of a batch and the offsets of its texts; the cache holds each piece's ids as bytes."""
    blobs = cache.of(pieces.distinct)
    table = np.frombuffer(b"".join(blobs), np.uint32)
    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    start = np.concatenate(([0], np.cumsum(size)))
    many = size[pieces.codes]
    ends = np.concatenate(([0], np.cumsum(many)))
    ids = table[np.repeat(start[pieces.codes] - ends[:-1], many) + np.arange(ends[-1])]
    offsets = ends[pieces.offsets]
    if len(pieces.whole):
        parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1)]
        for i, blob in zip(pieces.whole.tolist(), cache.work(pieces.uncut()), strict=True):
            parts[i] = np.frombuffer(blob, np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        ids = np.concatenate(parts) if parts else ids
    return ids, offsets


def library(path: str):
    """A tokenizer of the tokenizers library; one thread, since tasks already use all cores."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def library_cache(path: str) -> Cache:
    """One for all tasks of a Python worker."""
    return Cache(library_work(path))


#: So many pieces are encoded as one text.
JOINED = 64


def _cut_at_breaks(tokenizer) -> int | None:
    """The id of a line break, if the tokenizer never lets it meet what stands beside it (GPT-2's pattern, nothing normalised, plain added tokens)."""
    import json

    spec = json.loads(tokenizer.to_str())
    split = spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or "\n" in t["content"] for t in spec["added_tokens"]):
        return None
    ids = tokenizer.encode("\n", add_special_tokens=False).ids
    return ids[0] if len(ids) == 1 else None


def library_work(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids as bytes. Texts without white space but a space in front are encoded many at once, with line breaks between."""
    tokenizer = library(path)
    mark = _cut_at_breaks(tokenizer)

    def each(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def work(texts: list[str]) -> list[bytes]:
        # Of what prints, only the space is white; a break, a tab or the like is encoded alone.
        able = [t for t in texts if t.isprintable()] if mark is not None else []
        groups = [able[i : i + JOINED] for i in range(0, len(able), JOINED)]
        joined = ["\n".join(g) for g in groups]
        fine = [bool(g[0]) and bool(g[-1]) and j[-1] != " " and not ("\n\n" in j or "  " in j or " \n" in j) for g, j in zip(groups, joined, strict=True)]
        found = iter(tokenizer.encode_batch_fast([j for j, ok in zip(joined, fine, strict=True) if ok], add_special_tokens=False))
        made: list[bytes] = []
        for group, ok in zip(groups, fine, strict=True):
            if not ok:
                made += each(group)
                continue
            ids = np.array(next(found).ids, np.uint32)
            blob, ends, at = ids.tobytes(), (4 * np.flatnonzero(ids == mark)).tolist(), 0
            for end in [*ends, len(blob)]:
                made.append(blob[at:end])
                at = end + 4
        if len(made) == len(texts):
            return made
        both, rest = iter(made), iter(each([t for t in texts if mark is None or not t.isprintable()]))
        return [next(both) if mark is not None and t.isprintable() else next(rest) for t in texts]

    return work
