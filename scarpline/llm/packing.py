"""Texts packed into containers of fixed capacity, like with like.

Items are texts or, of a text longer than a container, what remains after whole containers are cut off. They are divided into shards;
each shard has a BM25 index of its items' tokens. The largest unused item opens a container and is the query, with all of its terms; its
unused neighbours, nearest first and any number of them, fill it as long as they fit and no unused item fills what is left exactly. What
is still empty is closed with the items whose sizes come out best: one or two that fit exactly, else the largest that fits. Containers
that stay loose go to a second round over fewer shards.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.encode import BYTE_BPE, TOKENIZERS, replay, some
from scarpline.session import materialize

CAPACITY = 2048
#: A shard has at most about so many items and so many tokens of them; what lies in containers of the first shards that are emptier than LOOSE goes to the second round.
SHARD, SHARD_TOKENS, LOOSE = 5_000, 2_500_000, 0.985
#: BM25's constants.
K1, B = 1.2, 0.75
#: Terms in more than one of so many items of a shard are scored as a matrix, so many seeds at once; the others by their postings.
COMMON, SEEDS = 16, 64


def items(documents: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(key, tokens, terms, counts) of each text with tokens: its number of tokens, and the different tokens of its last piece with their counts."""
    path = tokenizer or os.path.join(TOKENIZERS, BYTE_BPE)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = replay(path)
        for b in batches:
            for first, texts in some(b.column(1)):
                offsets, flat = m.encode(texts)
                n = np.diff(offsets)
                keep = np.flatnonzero(n > 0)
                n, begin, end = n[keep], offsets[:-1][keep], offsets[1:][keep]
                size = (n - 1) % capacity + 1
                doc = np.repeat(np.arange(len(n)), size)
                at = np.repeat(end - size - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(n) else np.zeros(0, np.int64)
                pair, count = np.unique(doc * m.size + flat[at], return_counts=True)
                ends = np.searchsorted(pair, np.arange(len(n) + 1) * m.size)
                off = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)).take(pa.array(keep)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(off, pa.array(pair % m.size, pa.int32())), pa.ListArray.from_arrays(off, pa.array(count, pa.int32()))],
                    names=[key, "tokens", "terms", "counts"],
                )

    return documents.select(key, text).where(f"`{text}` is not null and `{text}` <> ''").mapInArrow(run, f"`{key}` {kind}, tokens long, terms array<int>, counts array<int>")


class _Pool:
    """Unused items by size."""

    def __init__(self, size: np.ndarray, capacity: int) -> None:
        self.size = size
        self.by = [[] for _ in range(capacity + 1)]
        for i in np.argsort(-np.arange(len(size))):
            self.by[size[i]].append(int(i))
        self.left = np.bincount(size, minlength=capacity + 1)
        self.free = np.ones(len(size), bool)
        self.top = capacity

    def take(self, i: int) -> None:
        self.free[i] = False
        self.left[self.size[i]] -= 1

    def one(self, size: int) -> int:
        """An unused item of that size, which must exist."""
        own = self.by[size]
        while not self.free[own[-1]]:
            own.pop()
        return own[-1]

    def largest(self) -> int | None:
        while self.top and not self.left[self.top]:
            self.top -= 1
        return self.one(self.top) if self.top else None

    def closing(self, gap: int) -> list[int]:
        """Items that together fill gap best: one that fits exactly, two that do, or the largest that fits."""
        if self.left[gap]:
            return [self.one(gap)]
        have = self.left[1:gap] > 0
        two = np.flatnonzero(have & have[::-1])
        for s in two[::-1]:
            a, b = int(s) + 1, gap - int(s) - 1
            if a == b and self.left[a] < 2:
                continue
            i = self.one(a)
            if a != b:
                return [i, self.one(b)]
            self.free[i] = False
            j = self.one(b)
            self.free[i] = True
            return [i, j]
        fits = np.flatnonzero(have)
        return [self.one(int(fits[-1]) + 1)] if len(fits) else []


class _Scores:
    """BM25 scores of all items of a shard for one of them as the query, by all of its terms."""

    def __init__(self, size: np.ndarray, start: np.ndarray, terms: np.ndarray, counts: np.ndarray, df: np.ndarray, total: float, average: float) -> None:
        n = self.n = len(size)
        idf = np.log1p((total - df + 0.5) / (df + 0.5)).astype(np.float32)
        owner = np.repeat(np.arange(n), np.diff(start))
        norm = (K1 * (1 - B + B * size / max(average, 1.0))).astype(np.float32)
        weight = (idf[terms] * counts * (K1 + 1) / (counts + norm[owner])).astype(np.float32)
        here = np.bincount(terms, minlength=len(df))
        common = np.flatnonzero(here * COMMON > n)
        column = np.full(len(df), -1, np.int64)
        column[common] = np.arange(len(common))
        often = column[terms] >= 0
        self.matrix = np.zeros((n, len(common)), np.float32)
        self.matrix[owner[often], column[terms[often]]] = weight[often]
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(terms[rare], kind="stable")]
        self.who, self.weight = owner[rare].astype(np.int32), weight[rare]
        self.index = np.searchsorted(terms[rare], np.arange(len(df) + 1))
        self.start, self.terms, self.column = start, terms, column
        #: Later seeds in the order of their turn; scores by common terms are worked out for some of them at once.
        self.line = np.lexsort((np.arange(n), -size))
        self.place = np.empty(n, np.int64)
        self.place[self.line] = np.arange(n)
        self.ready: dict[int, np.ndarray] = {}

    def own(self, item: int) -> np.ndarray:
        return self.terms[self.start[item] : self.start[item + 1]]

    def of(self, seed: int, free: np.ndarray) -> np.ndarray:
        got = self.ready.pop(seed, None)
        if got is None:
            later = self.line[self.place[seed] + 1 :]
            seeds = [seed, *later[free[later]][: SEEDS - 1].tolist()]
            query = np.zeros((self.matrix.shape[1], len(seeds)), np.float32)
            for k, s in enumerate(seeds):
                c = self.column[self.own(s)]
                query[c[c >= 0], k] = 1
            part = np.ascontiguousarray((self.matrix @ query).T)
            self.ready = dict(zip(seeds, part))
            got = self.ready.pop(seed)
        t = self.own(seed)
        t = t[self.column[t] < 0]
        spans = [slice(a, b) for a, b in zip(self.index[t], self.index[t + 1]) if b > a]
        if not spans:
            return got
        return got + np.bincount(np.concatenate([self.who[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)


def _downwards(score: np.ndarray, some: int = 128) -> Iterator[int]:
    """Places from the highest score down, equal ones in their order; the first some are sorted before the others."""
    if len(score) > 2 * some:
        top = score >= np.partition(score, len(score) - some)[-some]
        first, rest = np.flatnonzero(top), np.flatnonzero(~top)
        yield from first[np.argsort(-score[first], kind="stable")].tolist()
        yield from rest[np.argsort(-score[rest], kind="stable")].tolist()
    else:
        yield from np.argsort(-score, kind="stable").tolist()


def pack(size: np.ndarray, start: np.ndarray, terms: np.ndarray, counts: np.ndarray, df: np.ndarray, total: float, average: float, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, place) of each item. Item i has the terms terms[start[i]:start[i + 1]]; df: texts that have a term, of total texts in the corpus."""
    n = len(size)
    container, place = np.full(n, -1, np.int64), np.zeros(n, np.int32)
    scores = _Scores(size, start, terms, counts, df, total, average)
    pool = _Pool(size, capacity)
    k, smallest = 0, 1
    while (seed := pool.largest()) is not None:
        pool.take(seed)
        inside, gap = [seed], capacity - int(size[seed])
        while smallest < capacity and not pool.left[smallest]:
            smallest += 1
        if gap >= smallest:
            near = np.flatnonzero(pool.free & (size <= gap))
            score = scores.of(seed, pool.free)[near]
            near, score = near[score > 0], score[score > 0]
            for j in _downwards(score):
                i = int(near[j])
                if gap < smallest or pool.left[gap]:
                    break  # nothing fits, or one item fills what is left exactly
                if size[i] <= gap:
                    pool.take(i)
                    inside.append(i)
                    gap -= int(size[i])
            while gap:
                more = pool.closing(gap)
                if not more:
                    break
                for i in more:
                    pool.take(i)
                    inside.append(i)
                    gap -= int(size[i])
        container[inside] = k
        place[inside] = np.arange(len(inside))
        k += 1
    return container, place


_PACKED = "key {0}, tokens long, container string, place int, fill long, terms array<int>, counts array<int>"


def pack_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, shard: int = SHARD) -> DataFrame:
    """(container_id, place, key, piece, first_token, n_tokens): which text, or which piece of it, lies where.

    A text of at most capacity tokens is whole in one container. A longer one is cut into pieces of capacity tokens, each alone in a
    container, and a rest that is packed like a text. NULL and empty texts have no tokens and are in no container; every other row of
    documents is in exactly one (or its pieces are), repeated texts too. Document frequencies are counted over the whole corpus.
    """
    kind = documents.schema[key].dataType.simpleString()
    every = materialize(items(documents, key, text, capacity, tokenizer))
    last = F.pmod(F.col("tokens") - 1, F.lit(capacity)) + 1
    n, average = every.agg(F.count(F.lit(1)), F.coalesce(F.avg(last), F.lit(1.0))).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(b.column(0).flatten().to_numpy())
            sums, got = (got, sums) if len(got) > len(sums) else (sums, got)
            sums[: len(got)] += got
        t = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(sums[t], pa.int64())], names=["t", "n"])

    found = every.select("terms").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    t = found.column("t").to_numpy()
    df = np.zeros(int(t.max()) + 1 if len(t) else 1, dtype=np.float64)
    df[t] = found.column("n").to_numpy()

    def run(name: str):
        def one(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            tokens = table.column("tokens").to_numpy()
            size = (tokens - 1) % capacity + 1
            terms = table.column("terms").combine_chunks()
            counts = table.column("counts").combine_chunks()
            start = np.r_[0, np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            got, place = pack(size, start, terms.flatten().to_numpy(), counts.flatten().to_numpy(), df, float(n), float(average), capacity)
            fill = np.bincount(got, size, got.max() + 1).astype(np.int64)
            s = table.column("shard")[0].as_py()
            loose = fill < (LOOSE * capacity if name == "a" else 0)
            mask = pa.array(~loose[got])
            empty = lambda a: pc.if_else(mask, pa.nulls(len(a), a.type), a)
            return pa.table({"key": table.column("key"), "tokens": table.column("tokens"), "container": pa.array([f"{name}{s}-{c}" for c in got.tolist()]), "place": pa.array(place), "fill": pa.array(fill[got]), "terms": empty(terms), "counts": empty(counts)})

        return one

    shards = max(1, round(n / shard), round(n * average / SHARD_TOKENS))
    of = every.select(F.col(key).alias("key"), "tokens", "terms", "counts")
    first = materialize(of.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(run("a"), _PACKED.format(kind)))
    packed = first
    loose = first.where(F.col("fill") < LOOSE * capacity)
    few = loose.count()
    if shards > 1 and few:
        groups = max(1, round(few / shard), round(few * average / SHARD_TOKENS))
        again = loose.select("key", "tokens", "terms", "counts").withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(groups)).cast("int"))
        second = again.groupBy("shard").applyInArrow(run("b"), _PACKED.format(kind))
        packed = first.where(F.col("fill") >= LOOSE * capacity).unionByName(second)
    rest = packed.select(
        F.col("container").alias("container_id"), "place", "key", F.floor((F.col("tokens") - 1) / capacity).cast("int").alias("piece"),
        (F.floor((F.col("tokens") - 1) / capacity) * capacity).cast("long").alias("first_token"), last.cast("int").alias("n_tokens"),
    )
    full = every.where(F.col("tokens") > capacity).select(F.col(key).alias("key"), F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int") - 1)).alias("piece"))
    whole = full.select(
        F.concat(F.lit("w"), F.col("key").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container_id"), F.lit(0).alias("place"), "key", "piece",
        (F.col("piece") * capacity).cast("long").alias("first_token"), F.lit(capacity).alias("n_tokens"),
    )
    return whole.unionByName(rest).withColumnRenamed("key", key)
