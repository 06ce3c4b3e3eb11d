"""Byte-pair encoding by speculation: propose by longest match, verify each adjacent pair, merge only where that fails.

A row of tokens is what merging gives exactly if each token is what merging gives for its own characters and no
merge ever happens across a boundary of two neighbours. Both are looked at for all words of a batch at once. At a boundary, the left neighbour shows in turn the tokens on the right
edge of its merge tree, the right neighbour those on the left edge of its own. A merge (x, y) of such tokens happens
if it ranks before the merge that absorbs x, and not after the one that absorbs y (of equal merges the leftmost is first).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import few_bytes
from quillstone.llm.pieces import Cache, Pieces, ids_of

#: Stands for a word's end within a token's characters; no byte maps to it.
END = "\x01"
NEVER = np.int64(1) << 60
#: Up to so many characters, looking through all pairs' ranks again is faster than a queue.
SHORT = 64
#: How many characters say how long a token that begins with them can be.
LEAD = 3
#: A byte at a word's end has so much added.
LAST = 256
#: So many cells of words' letters are merged at once.
CELLS = 1 << 20


class Table:
    """Numbers (from 0, under 2^62, distinct) to numbers, for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at = self._at(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self.mask

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        at = self._at(keys)
        held = self.keys[at]
        found = held == keys
        out = np.where(found, self.values[at], default)
        live = np.flatnonzero(~found & (held >= 0))
        while len(live):
            at[live] = (at[live] + 1) & self.mask
            held = self.keys[at[live]]
            found = held == keys[live]
            out[live[found]] = self.values[at[live[found]]]
            live = live[~found & (held >= 0)]
        return out


def spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start, start + 1, ... of runs, one run after the other; and where each run begins among them, and the last ends."""
    ends = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(start - ends[:-1], size) + np.arange(ends[-1]), ends


def byte_letters() -> list[str]:
    """The letter of each byte: itself where it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class SpeculativeBPE:
    """Encodes as the tokenizer file says: a word-end BPE after NFC, lower case and the file's split pattern."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.vocab, n = model["vocab"], 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.tokens = [""] * n
        for t, i in self.vocab.items():
            self.tokens[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.tokens[i] = t
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words, self.words_or_breaks = regex.compile(pattern), regex.compile(f"{pattern}|\n")
        self.letters = dict(enumerate(byte_letters()))
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.made = np.full(n, -1, np.int64)  # the rank of the merge that makes it
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        every = self.letters.values()
        letters = {c: c for c in every} | {c + suffix: c + END for c in every}
        form = {self.vocab[t]: f for t, f in letters.items() if t in self.vocab}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, new = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if (a, b) in self.merge:
                continue
            self.merge[a, b] = (rank, new)
            if self.made[new] < 0 and new not in form:
                self.left[new], self.right[new], self.made[new] = a, b, rank
                form[new] = form[a] + form[b]
        self.by_form = {f: i for i, f in form.items()}
        self.longest: dict[str, int] = {}  # of the tokens that begin so
        for f in self.by_form:
            self.longest[f[:LEAD]] = max(len(f), self.longest.get(f[:LEAD], 0))
        self.made_by = [new for _, new in sorted(self.merge.values())]
        self.rank_of = {pair: i for i, pair in enumerate(sorted(self.merge, key=self.merge.get))}
        ranks = np.array([r for r, _ in self.merge.values()], np.int64)
        self.ranks = Table(np.array([a << 32 | b for a, b in self.merge], np.int64), ranks)
        self.of_rank = np.full(1 + max(ranks, default=-1), -1, np.int64)  # what the merge of a rank makes
        self.of_rank[ranks] = [new for _, new in self.merge.values()]
        self.failed = self.proposed = 0
        self._plant(form)

    def _plant(self, form: dict[int, str]) -> None:
        """The tokens as a tree of bytes: where each leads from a node (the root is 0), and the token that ends at a node; and which tokens merging their own letters gives."""
        byte_of = {c: b for b, c in self.letters.items()}
        self.byte_of = str.maketrans({c: chr(b) for c, b in byte_of.items()} | {END: None})
        to: dict[int, int] = {}
        ends: dict[int, int] = {}
        spelt = {}
        for token, f in form.items():
            spelt[token] = [byte_of[c] for c in f.removesuffix(END)]
            spelt[token][-1] += LAST * f.endswith(END)
            node = 0
            for c in spelt[token]:
                node = to.setdefault(node << 9 | c, len(to) + 1)
            ends[node] = token
        self.to = Table(np.array(list(to), np.int64), np.array(list(to.values()), np.int64))
        self.token_at = np.full(len(to) + 1, -1, np.int64)
        self.token_at[list(ends)] = list(ends.values())
        self.of_byte = np.full(2 * LAST, -1, np.int64)
        for token, letters in spelt.items():
            if len(letters) == 1:
                self.of_byte[letters[0]] = token
        self.is_sound = np.zeros(len(self.tokens), bool)
        short = [t for t, x in spelt.items() if len(x) <= SHORT]
        ids, size = self._merged(np.array([c for t in short for c in spelt[t]], np.int64), np.array([len(spelt[t]) for t in short], np.int64))
        self.is_sound[short] = (size == 1) & (ids[np.cumsum(size) - size] == short)
        for t in spelt.keys() - set(short):
            self.is_sound[t] = self.exact(form[t]) == [t]

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.ranks.get(x << 32 | y, NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the boundary of a and b, for all pairs at once."""
        crossed = np.zeros(len(a), bool)
        x, taken_x, live_x = a.copy(), np.full(len(a), NEVER), np.arange(len(a))
        while len(live_x):
            live, xx, tx = live_x, x[live_x], taken_x[live_x]
            y, ty = b[live], np.full(len(live), NEVER)
            while len(live):
                r = self.rank(xx, y)
                crossed[live] |= (r < tx) & (r <= ty)
                go = self.left[y] >= 0
                live, xx, tx, ty, y = live[go], xx[go], tx[go], self.made[y[go]], self.left[y[go]]
            go = (self.right[x[live_x]] >= 0) & ~crossed[live_x]
            live_x = live_x[go]
            taken_x[live_x] = self.made[x[live_x]]
            x[live_x] = self.right[x[live_x]]
        return ~crossed

    def exact(self, word: str) -> list[int]:
        """Merging by rank, the leftmost first among equals."""
        ids = [self.by_form[c] for c in self._first(word)]
        if len(ids) <= SHORT:
            return self._exact_short(ids)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if m := self.merge.get((new, ids[after[j]])):
                    heapq.heappush(queue, (m[0], i, new, ids[after[j]], m[1]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], new))):
                heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def _exact_short(self, ids: list[int]) -> list[int]:
        rank_of, none = self.rank_of.get, len(self.made_by)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i : i + 2] = [self.made_by[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), none)
        return ids

    @staticmethod
    def _first(word: str) -> list[str]:
        return [*word[:-2], word[-2:]] if word.endswith(END) else [*word]

    def propose(self, word: str) -> list[int] | None:
        out, at, known, n = [], 0, self.by_form, len(word)
        longest = self.longest.get
        while at < n:
            # A token shorter than LEAD is not under its longer leads.
            for end in range(min(n, at + (longest(word[at : at + LEAD]) or LEAD - 1)), at, -1):
                if (token := known.get(word[at:end])) is not None:
                    break
            else:
                return None
            if not self.is_sound[token]:
                return None
            out.append(token)
            at = end
        return out

    def _propose(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each place (-1: none) and its length. No token reaches over a word's last byte."""
        token, size = np.full(len(letters), -1, np.int64), np.ones(len(letters), np.int64)
        at, node, depth = np.arange(len(letters)), self.to.get(letters, 0), 0
        while len(at):
            depth += 1
            at, node = at[node > 0], node[node > 0]
            here = self.token_at[node]
            ends = here >= 0
            token[at[ends]], size[at[ends]] = here[ends], depth
            more = at + depth < len(letters)
            at, node = at[more], node[more]
            node = self.to.get(node << 9 | letters[at + depth], 0)
        return token, size

    def _merged(self, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As exact, for many words of up to SHORT letters: each round merges the first pair of least rank of each word. All ids, and how many each word has."""
        start, many, parts, order = np.cumsum(size) - size, np.zeros(len(size), np.int64), [], []
        first, low, none = self.of_byte[letters], 0, len(self.tokens)
        if (first < 0).any():
            raise KeyError("a byte without a token")
        for width in (4, 8, 12, 16, 32, SHORT):
            rows = np.flatnonzero((size > low) & (size <= width))
            low, step = width, CELLS // (width + 2)
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                ids, columns = np.full((len(some), width + 2), none, np.int64), np.arange(width + 2)
                inside = (columns > 0) & (columns <= size[some][:, None])
                ids[inside] = first[spread(start[some], size[some])[0]]
                ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(some), -1)
                before, after = np.tile(columns - 1, (len(some), 1)), np.tile(columns + 1, (len(some), 1))
                live = np.arange(len(some))
                while len(live):
                    seen = ranks[live]
                    x = seen.argmin(1)
                    rank = seen[np.arange(len(live)), x]
                    go = rank < NEVER
                    live, x, new = live[go], x[go], self.of_rank[rank[go]]
                    y = after[live, x]
                    left, right = before[live, x], after[live, y]
                    ids[live, x], ids[live, y], ranks[live, y] = new, -1, NEVER
                    after[live, x], before[live, right] = right, x
                    ranks[live, x], ranks[live, left] = self.rank(new, ids[live, right]), self.rank(ids[live, left], new)
                left = (ids >= 0) & (ids < none)
                parts.append(ids[left])
                many[some] = left.sum(1)
                order.append(some)
        order = np.concatenate([*order, np.zeros(0, np.int64)])
        at = np.zeros(len(size), np.int64)
        at[order] = np.cumsum(many[order]) - many[order]
        return np.concatenate([*parts, np.zeros(0, np.int64)])[spread(at, many)[0]], many

    def encode(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words as bytes, one after the other, and their sizes (from 1), to ids and where each word's begin among them and how many they are."""
        n, ends = len(size), np.concatenate(([0], np.cumsum(size)))
        letters = data.astype(np.int64)
        letters[ends[1:] - 1] += LAST
        token, step = self._propose(letters)
        starts, at, end = np.zeros(len(letters), bool), ends[:-1][size <= SHORT], ends[1:][size <= SHORT]
        while len(at):
            starts[at] = True
            at = at + step[at]
            at, end = at[at < end], end[at < end]
        ids, word = token[starts], np.repeat(np.arange(n), size)[starts]
        # Words longer than that are proposed, and merged, one by one.
        long = np.flatnonzero(size > SHORT).tolist()
        texts = [data[ends[i] : ends[i + 1]].tobytes().decode("latin-1").translate(self.letters) + END for i in long]
        proposed = [self.propose(t) for t in texts]
        ids = np.concatenate([ids, *[np.array(x or [-1], np.int64) for x in proposed]])
        word = np.concatenate([word, np.repeat(np.array(long, np.int64), [len(x or [-1]) for x in proposed])])
        bad = np.zeros(n, bool)
        bad[word[(ids < 0) | ~self.is_sound[ids]]] = True
        inner = np.flatnonzero((word[1:] == word[:-1]) & ~bad[word[1:]])
        if len(inner):
            pairs, place = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
            bad[word[inner[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[place]]]] = True
        self.proposed, self.failed = self.proposed + n, self.failed + int(bad.sum())
        many = np.bincount(word, minlength=n)
        first = np.zeros(n, np.int64)
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        first[word[begins]] = begins
        wrong = np.flatnonzero(bad & (size <= SHORT))
        merged, sizes = self._merged(letters[spread(ends[wrong], size[wrong])[0]], size[wrong])
        first[wrong], many[wrong] = len(ids) + np.cumsum(sizes) - sizes, sizes
        parts, total = [ids, merged], len(ids) + len(merged)
        for i, t in zip(long, texts, strict=True):
            if bad[i]:
                parts.append(np.array(self.exact(t), np.int64))
                first[i], many[i] = total, len(parts[-1])
                total += many[i]
        return np.concatenate(parts), first, many

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Words in byte letters with END behind the last."""
        plain = [w.translate(self.byte_of).encode("latin-1") for w in words]
        ids, first, many = self.encode(np.frombuffer(b"".join(plain), np.uint8), np.array([len(w) for w in plain], np.int64))
        return [ids[a : a + n].tolist() for a, n in zip(first.tolist(), many.tolist(), strict=True)]

    def _normal(self, text: str) -> str:
        # Lower case letter by letter, as the file's normaliser has it (Python looks at a word's end for a sigma).
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _split(self, text: str) -> list[str]:
        """A text's words; those of special tokens have a line break in front."""
        found, at = [], 0
        for m in self.at_special.finditer(text) if self.at_special else ():
            found += [*self.words.findall(self._normal(text[at : m.start()])), "\n" + m.group()]
            at = m.end()
        return found + self.words.findall(self._normal(text[at:]))

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        """Texts to their ids as bytes. Texts without line breaks and special tokens are split as one, with line breaks between."""
        special = self.at_special is not None and self.at_special.search("\n".join(texts)) is not None
        odd = [i for i, t in enumerate(texts) if "\n" in t or (special and self.at_special.search(t))]
        alone = set(odd)
        order = [i for i in range(len(texts)) if i not in alone]
        # No white space belongs to a word, and nothing is composed or lowered across a line break.
        words = self.words_or_breaks.findall(self._normal("".join([texts[i] + "\n" for i in order])))
        for i in odd:
            words += [*self._split(texts[i]), "\n"]
        if not texts:
            return []
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        ends = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        ids, first, many = self.encode(np.frombuffer(distinct.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.diff(ends))
        stop = distinct.index(pa.scalar("\n", pa.large_string())).as_py()
        many[stop] = 0
        for t, token in self.special.items() if odd else ():
            if (i := distinct.index(pa.scalar("\n" + t, pa.large_string())).as_py()) >= 0:
                first[i], many[i] = len(ids), 1
                ids = np.append(ids, token)
        places, at = spread(first[codes], many[codes])
        blob = ids[places].astype(np.uint32).tobytes()
        stops = (4 * at[:-1][codes == stop]).tolist()
        made = [blob[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        if not odd:
            return made
        found = dict(zip([*order, *odd], made, strict=True))
        return [found[i] for i in range(len(texts))]

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: the tokens, a space between them."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def bpe_of(path: str) -> tuple[SpeculativeBPE, Cache]:
    """One for all tasks of a Python worker."""
    bpe = SpeculativeBPE(path)
    return bpe, Cache(bpe.encode_pieces, 300_000)


def encode_decode(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode and decode each text of docs (null: empty, 0 tokens): the columns of keep, n_tokens, ids_sha256, decoded_sha256.

    with_ids adds ids (array of int). One row per row of docs, equal rows included.
    """
    chosen = [F.col(c) for c in keep]
    fields = {f.name: f for f in docs.select(*chosen).schema.fields}
    own = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    schema = ", ".join([*(f"`{n}` {f.dataType.simpleString()}" for n, f in fields.items()), own])
    width = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = bpe_of(tokenizer)
        for batch in few_bytes(batches):
            ids, offsets = ids_of(Pieces(batch.column(width), keep_runs=False), cache)
            ids_sha, decoded_sha = [], []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                one = ids[a:b]
                ids_sha.append(hashlib.sha256(one.astype("<u4").tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(one.tolist()).encode()).hexdigest())
            columns = [batch.column(i) for i in range(width)]
            columns += [pa.array(np.diff(offsets)), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select(*chosen, F.col("text").cast("string").alias("__text")).mapInArrow(work, schema)
