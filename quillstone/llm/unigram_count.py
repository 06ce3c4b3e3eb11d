"""Counting the tokens of a unigram tokenizer without making them.

Aho-Corasick lists each place where a vocabulary piece occurs; a dynamic programme over the places carries the best score and
the number of pieces. Ties fall as the tokenizers library lets them: the piece that begins first (the longest) stays. A
character that no piece covers alone costs the lowest score less 10 and counts as its bytes.

Scores are the vocabulary's own, whole numbers for the file used here, so sums are exact and a text's count is the sum over its
words. Pieces of several space letters match whole runs of spaces: a text is cut only before a run, which no piece can cross,
unless `split` asks for a cut before each space (the library's Metaspace with split=True).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.pieces import Cache, Pieces

SPACE_LETTER = "▁"
UNKNOWN_COST = 10.0
#: A word with the space letter before it, or what stands before the first.
WORD = re.compile(f"{SPACE_LETTER}?[^{SPACE_LETTER}]+|{SPACE_LETTER}")
#: The same with a whole run of space letters.
RUN = re.compile(f"{SPACE_LETTER}*[^{SPACE_LETTER}]+|{SPACE_LETTER}+")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model that can match text, and their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in plain]


class Counter:
    def __init__(self, path: str):
        import ahocorasick

        words = vocabulary(path)
        self.unknown = min(0.0, *(s for _, s in words)) - UNKNOWN_COST
        self.automaton = ahocorasick.Automaton()
        for w, s in words:
            self.automaton.add_word(w, (len(w), s))
        self.automaton.make_automaton()

    def count(self, word: str) -> int:
        """Pieces of the best path through a word whose spaces are SPACE_LETTER already."""
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(word):
            ending[end].append(piece)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            best = None
            alone = False
            for size, s in sorted(ending[end], reverse=True):
                alone |= size == 1
                at = end + 1 - size
                if best is None or s + score[at] > best:
                    best, many = s + score[at], pieces[at] + 1
            if not alone and (best is None or self.unknown + score[end] > best):
                best, many = self.unknown + score[end], pieces[end] + len(word[end].encode())
            score[end + 1], pieces[end + 1] = best, many
        return pieces[n]

    def counts(self, words: list[str]) -> list[int]:
        return [self.count(w.replace(" ", SPACE_LETTER)) for w in words]

    def whole(self, text: str, split: bool) -> int:
        """Of a text, with the space letter put before it unless it begins with a space."""
        if not text:
            return 0
        text = (text if text[0] in f" {SPACE_LETTER}" else f" {text}").replace(" ", SPACE_LETTER)
        return sum(map(self.count, (WORD if split else RUN).findall(text)))


@lru_cache(maxsize=2)
def counter_of(model: str) -> tuple[Counter, Cache]:
    """One for all tasks of a Python worker."""
    counter = Counter(model)
    return counter, Cache(counter.counts)


def token_counts(docs: DataFrame, model: str, split: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens (null or empty text: 0), n_chars (code points).

    split: each space begins a word of its own, so pieces of several spaces never match. Without it they do.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, cache = counter_of(model)
        for batch in batches:
            pieces = Pieces(pc.replace_substring(batch.column("text"), SPACE_LETTER, " "), keep_runs=False, cut_spaces=split)
            of = np.array(cache.of(pieces.distinct), np.int64)
            sums = np.concatenate(([0], np.cumsum(of[pieces.codes])))
            out = sums[pieces.offsets[1:]] - sums[pieces.offsets[:-1]]
            # The first piece of a text stands without a space; count it anew with the space letter before it.
            for i, code in enumerate(pieces.codes[pieces.offsets[:-1]].tolist()):
                first = pieces.distinct[code]
                if first and first[0] not in f" {SPACE_LETTER}":
                    out[i] += cache.of([f" {first}"])[0] - of[code]
                elif not first and pieces.codes[pieces.offsets[i] : pieces.offsets[i + 1]].size > 1 and pieces.distinct[pieces.codes[pieces.offsets[i] + 1]] == "\n":
                    out[i] += 1
            for i, text in zip(pieces.whole.tolist(), pieces.uncut() if len(pieces.whole) else [], strict=True):
                out[i] = counter.whole(text, split)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), batch.column("n_chars")], names=["doc_id", "n_tokens", "n_chars"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return texts.mapInArrow(work, "doc_id long, n_tokens long, n_chars long")
