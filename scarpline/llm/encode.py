"""Byte-pair encoding by replaying the merges over all words of a batch at once.

The words of a batch, each once, lie behind each other as one run of symbols. An index inverted from symbol pair to the positions
where it stands is worked off in the order of the merges' ranks: all places of a pair are merged, and only the pairs with the two
neighbours of a merged place are entered anew. A merge makes a symbol that only later merges use, so one pass over the ranks does.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Encoded words that a worker keeps for the batches to come; it starts anew beyond them.
KEPT_WORDS = 400_000
#: Fixed: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_signs() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself where it is printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeReplay:
    """The merges of a byte-level vocabulary file, and the words encoded so far."""

    def __init__(self, path: str) -> None:
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        signs = _byte_signs()
        self.byte = [0] * 256
        for sign, b in signs.items():
            self.byte[b] = vocab[sign]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault(vocab[a] << 20 | vocab[b], r)
            self.made.append(vocab[a + b])
        self.split = regex.compile(PATTERN).findall
        #: Ids are below this.
        self.size = max(vocab.values()) + 1
        self.known: dict[str, int] = {}
        self.start, self.ids = [0], []

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, all together."""
        byte, rank_of, made = self.byte, self.rank.get, self.made
        sym: list[int] = []
        ends: list[int] = []
        for w in words:
            sym.extend([byte[b] for b in w.encode("utf-8", "surrogatepass")])
            sym.append(-1)  # no pair crosses it
            ends.append(len(sym))
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for p in range(n - 1):
            a, b = sym[p], sym[p + 1]
            if a >= 0 and b >= 0:
                r = rank_of(a << 20 | b)
                if r is not None:
                    at = index.get(r)
                    if at is None:
                        index[r] = [p]
                    else:
                        at.append(p)
        queue = list(index)
        heapq.heapify(queue)
        first_of = {}
        while queue:
            r = heapq.heappop(queue)
            places = index.pop(r)
            pair = first_of.get(r)
            if pair is None:
                p = places[0]
                pair = first_of[r] = self.pair_of(r)
            a, b = pair
            new = made[r]
            places.sort()
            for p in places:
                if sym[p] != a:
                    continue
                q = after[p]
                if q >= n or sym[q] != b:
                    continue
                sym[p], sym[q] = new, -2
                nxt = after[q]
                after[p] = nxt
                if nxt < n:
                    before[nxt] = p
                    c = sym[nxt]
                    if c >= 0:
                        s = rank_of(new << 20 | c)
                        if s is not None:
                            at = index.get(s)
                            if at is None:
                                index[s] = [p]
                                heapq.heappush(queue, s)
                            else:
                                at.append(p)
                o = before[p]
                if o >= 0:
                    c = sym[o]
                    if c >= 0:
                        s = rank_of(c << 20 | new)
                        if s is not None:
                            at = index.get(s)
                            if at is None:
                                index[s] = [o]
                                heapq.heappush(queue, s)
                            else:
                                at.append(o)
        known, start, ids, p = self.known, self.start, self.ids, 0
        for w, e in zip(words, ends):
            known[w] = len(start) - 1
            ids.extend([s for s in sym[p : e - 1] if s >= 0])
            start.append(len(ids))
            p = e

    def pair_of(self, r: int) -> tuple[int, int]:
        if not hasattr(self, "pairs"):
            self.pairs = {v: (k >> 20, k & 0xFFFFF) for k, v in self.rank.items()}
        return self.pairs[r]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text k are ids[offsets[k]:offsets[k + 1]]."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.start, self.ids = {}, [0], []
        split, known = self.split, self.known
        parts = [split(t) if t else [] for t in texts]
        fresh = set(chain.from_iterable(parts)).difference(known)
        if fresh:
            self.learn(list(fresh))
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=sum(map(len, parts)))
        start, ids = np.array(self.start, dtype=np.int64), np.array(self.ids, dtype=np.int32)
        length = start[which + 1] - start[which]
        done = np.r_[0, np.cumsum(length)]
        flat = ids[np.repeat(start[which] - done[:-1], length) + np.arange(done[-1])]
        return done[np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)], flat


@lru_cache(maxsize=4)
def replay(path: str) -> MergeReplay:
    """One per worker and file."""
    return MergeReplay(path)


#: Texts of about so many characters are encoded together.
_CHARS = 4_000_000


def some(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts): rows in lots of about _CHARS characters."""
    lot: list[str | None] = []
    size, first = 0, 0
    for k in range(len(texts)):
        t = texts[k].as_py()
        lot.append(t)
        size += len(t or "")
        if size >= _CHARS:
            yield first, lot
            lot, size, first = [], 0, k + 1
    if lot:
        yield first, lot


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens, whose look-alikes are plain text.

    The empty list for an empty text, NULL for a NULL text. One row for each row of documents; texts may be of any length.
    tokenizer: path of a byte-level vocabulary file, by default byte_bpe_50k of TOKENIZERS, which every executor must have.
    """
    path = tokenizer or os.path.join(TOKENIZERS, BYTE_BPE)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = replay(path)
        for b in batches:
            for first, texts in some(b.column(1)):
                offsets, flat = m.encode(texts)
                at = pa.array(np.append(offsets, 0)[: len(texts) + 1], pa.int32(), mask=np.array([*(t is None for t in texts), False]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(at, pa.array(flat, pa.int32()))], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
