"""Scores of texts under an n-gram model that is compiled into a weighted automaton with failure arcs.

The model learns from part of the documents and smooths by Dirichlet priors: with h a context and h' the one without its
first word, P(w | h) = (c(hw) + mu P(w | h')) / (c(h) + mu), and P(w) = (c(w) + 1) / (N + V + 1), where the 1 is what all
unknown words share.  So every P sums up to one.  As an automaton: each context seen in training is a state, each
n-gram an arc to the longest state that ends it, and a word without an arc takes the failure arc to the state of h',
at the price mu / (c(h) + mu).  A text is read once from left to right, from the state of a text's beginning to its end
token, and the logarithms on the way are added up.

The n-grams of all documents don't fit one machine, so each task compiles the part of the automaton that its documents
can reach:

1. Documents are dealt into blocks of some million tokens, written with word numbers of the block's own.
2. Every block sends its distinct n-grams, as hashes with their counts in its training documents, to buckets of
   the range of hashes, one row per block, order and bucket; the buckets grow in number with the tokens.
3. A bucket adds up the counts and answers each block in the order in which it was asked.
4. A block compiles its automaton from the answers and traverses its documents, each once from left to right.

Where a text stands after a token is the longest state that ends there, so a state is known by its length, which the
traversal carries, and its place in the text: arcs and failure arcs are looked up by place, not searched.

A word's part of the tokens doesn't matter, as a block sends an n-gram once.  Hashes stand for words and n-grams; they are
as wide, up to 64 bits, as it takes that one of some 300 million n-grams meets another.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then an end token.  Documents whose crc32 of the id as
text leaves ``held`` by ``modulus`` aren't learned from.

Defined results: a null text counts as empty, of which the end token is scored.  A null id counts as the empty string.
Repeated rows are learned and scored each.  Without training documents every score is 0, as the unknown word has all of
the probability.  A block has one document at least, of any length.  Extra columns don't matter, and an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import spread
from .base import text_of, written

ORDER = 3
MU = (1000.0, 5.0)  # by length of the context; held-out texts gain on nearly all word pairs at this strength
MODULUS, HELD = 7, 2
TOKENS = 1_000_000  # of a block
BUCKET = 4_000_000  # tokens of the corpus for each bucket
SURE = 28
BEGIN, END = 0, 1  # word numbers of the begin of a text, a context only, and of its end
MARKS = (b" begin", b" end")  # no word has a blank


def held_out(id_col: Column, modulus: int = MODULUS, held: int = HELD) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == held


class WordNumbers(dict):
    """Numbers of words in the order in which they come."""

    def __init__(self):
        super().__init__({m: k for k, m in enumerate(MARKS)})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self))


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokens: int = TOKENS, modulus: int = MODULUS,
              held: int = HELD) -> DataFrame:
    """Written table, one row per block: ids and ``held`` flags of its documents, their ``ends`` among the tokens, the
    hashes of its words and its tokens, each document from its begin to its end."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), held_out(F.col(f"`{id_col}`"), modulus, held).alias("held"),
                       text_of(f"`{text}`").alias("text"))

    def row(ids: list, out: list, parts: list[np.ndarray], numbers: WordNumbers) -> pd.DataFrame:
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        return pd.DataFrame({"n": [int(ends[-1])], "ids": [ids], "held": [out], "ends": [ends.tobytes()],
                             "words": [numbers.hashes().tobytes()], "tokens": [planes(np.concatenate(parts))]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, out, parts, size, numbers = [], [], [], 0, WordNumbers()
        for frame in frames:
            for doc, is_held, content in zip(frame["id"], frame["held"], frame["text"]):
                words = content.encode("utf-8", "replace").lower().split()
                part = np.empty(len(words) + 2, np.int32)
                part[0], part[-1] = BEGIN, END
                part[1:-1] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                ids.append(doc)
                out.append(bool(is_held))
                parts.append(part)
                size += len(part)
                if size >= tokens:
                    yield row(ids, out, parts, numbers)
                    ids, out, parts, size, numbers = [], [], [], 0, WordNumbers()
        if ids:
            yield row(ids, out, parts, numbers)

    dealt = rows.mapInPandas(run, "n long, ids array<string>, held array<boolean>, ends binary, words binary, tokens binary")
    return written(dealt.select(F.monotonically_increasing_id().alias("block"), "*"), "lm-blocks")


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the hashes ``a`` followed by ``b``."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Grams:
    """The distinct n-grams of a block, for one n."""

    def __init__(self, at: np.ndarray, keys: np.ndarray, prefix: np.ndarray, suffix: np.ndarray):
        self.at = at  # for each token the number of the n-gram that ends there, -1 where there is none
        self.keys = keys
        self.prefix, self.suffix = prefix, suffix  # the shorter n-grams that begin and end an n-gram
        self.counts = None


class Content:
    """A block read back, with its n-grams of every order up to ``order``."""

    def __init__(self, row, order: int, width: int):
        self.ids, self.held = list(row.ids), np.asarray(row.held, bool)
        self.ends = np.frombuffer(row.ends, np.int64)
        self.starts = np.append(0, self.ends[:-1])
        self.words = np.frombuffer(row.words, np.uint64)
        self.tokens = from_planes(row.tokens)
        self.levels = [Grams(np.where(self.tokens == BEGIN, np.int32(-1), self.tokens), self.words, None, None)]
        for _ in range(1, order):
            self.levels.append(self._longer(self.levels[-1], self.tokens if len(self.levels) == 1 else self.levels[-1].at))
        for level in self.levels:
            level.keys = level.keys >> np.uint64(64 - 8 * width)

    def _longer(self, last: Grams, contexts: np.ndarray) -> Grams:
        where = np.flatnonzero((self.tokens[1:] != BEGIN) & (contexts[:-1] >= 0)) + 1
        codes = contexts[where - 1].astype(np.int64)
        codes *= len(self.words)
        codes += self.tokens[where]
        codes, back = np.unique(codes, return_inverse=True)
        at = np.full(len(self.tokens), -1, np.int32)
        at[where] = back
        some = np.empty(len(codes), np.int32)  # a token where the n-gram ends
        some[back] = where
        prefix = (codes // len(self.words)).astype(np.int32)
        return Grams(at, fold(last.keys[prefix], self.words[self.tokens[some]]), prefix, last.at[some])

    def own_counts(self, level: Grams) -> np.ndarray:
        """Of each n-gram in the training documents."""
        learned = np.repeat(~self.held, self.ends - self.starts) & (level.at >= 0)
        return np.bincount(level.at[learned], minlength=len(level.keys))


def planes(x: np.ndarray) -> bytes:
    """Whole numbers by bytes, the first bytes of all and so on, which packs well; the width stands in front."""
    if x.dtype.kind == "i":
        x = x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)
    return bytes([x.itemsize]) + zlib.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def from_planes(data: bytes) -> np.ndarray:
    size = data[0]
    each = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(size, -1).T
    x = np.ascontiguousarray(each).view(np.uint64 if size == 8 else np.uint32).ravel()
    return x if size == 8 else x.view(np.int32) if not len(x) or x.max() < 1 << 31 else x


def key_bytes(tokens: int) -> int:
    """Width of the hashes with which an n-gram meets another by about 2 ** -``SURE`` in a corpus of so many tokens."""
    return min(8, -(-(tokens.bit_length() + SURE) // 8))


def packed_keys(keys: np.ndarray, width: int) -> bytes:
    """Ascending hashes as differences: the low bytes as they are, as they don't pack, the three high ones packed."""
    each = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return each[:width - 3].tobytes() + zlib.compress(each[width - 3:width].tobytes(), 1)


def unpacked_keys(data: bytes, n: int, width: int) -> np.ndarray:
    each = np.zeros((8, n), np.uint8)
    each[:width - 3] = np.frombuffer(data, np.uint8, (width - 3) * n).reshape(width - 3, n)
    each[width - 3:width] = np.frombuffer(zlib.decompress(data[(width - 3) * n:]), np.uint8).reshape(3, n)
    return np.cumsum(np.ascontiguousarray(each.T).view(np.uint64).ravel(), dtype=np.uint64)


def _cuts(keys: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """Where the buckets, equal ranges of hashes, begin among sorted ``keys``."""
    bounds = np.array([-(-(k << 8 * width) // buckets) for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def asked(blocks: DataFrame, order: int, buckets: int, width: int) -> DataFrame:
    """One row per block, ``order`` and ``bucket``: hashes of distinct n-grams in ascending order and their own counts."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                content = Content(row, order, width)
                for n, level in enumerate(content.levels, 1):
                    by = np.argsort(level.keys)
                    keys, counts = level.keys[by], content.own_counts(level)[by]
                    cuts, out = _cuts(keys, buckets, width), []
                    for bucket in np.flatnonzero(np.diff(cuts)):
                        mine = slice(cuts[bucket], cuts[bucket + 1])
                        out.append((n, int(bucket), int(row.block), int(mine.stop - mine.start), packed_keys(keys[mine], width),
                                    planes(counts[mine])))
                    yield pd.DataFrame(out, columns=["order", "bucket", "block", "n", "keys", "counts"])

    return blocks.mapInPandas(run, "order int, bucket int, block long, n int, keys binary, counts binary")


def answered(requests: DataFrame, width: int) -> DataFrame:
    """For each request the counts over all blocks, in its order; ``types`` and ``mass`` are those of a bucket, on one of its
    rows."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        ends = np.cumsum(group["n"])
        keys = np.concatenate([unpacked_keys(k, n, width) for k, n in zip(group["keys"], group["n"])])
        distinct, back = np.unique(keys, return_inverse=True)
        del keys
        counts = np.concatenate([from_planes(c) for c in group["counts"]])
        totals = np.bincount(back, weights=counts, minlength=len(distinct)).astype(np.int64)
        out = [planes(totals[back[e - n:e]]) for n, e in zip(group["n"], ends)]
        first = np.arange(len(group)) == 0
        return pd.DataFrame({"order": group["order"], "bucket": group["bucket"], "block": group["block"], "totals": out,
                             "types": np.where(first, np.count_nonzero(totals), 0), "mass": np.where(first, totals.sum(), 0)})

    schema = "order int, bucket int, block long, totals binary, types long, mass long"
    return written(spread(requests, "order", "bucket").groupBy("order", "bucket").applyInPandas(add, schema), "lm-totals")


class Automaton:
    """Arcs and failure arcs of a block's n-grams.

    A state is a context, by its length and its number among the block's n-grams of that length; the arc of an n-gram
    leads from the context that begins it to the longest state that ends it.
    """

    NO_ARC = 1.0  # no logarithm of a probability is above 0

    def __init__(self, levels: list[Grams], train_tokens: int, train_types: int, mu: tuple[float, ...]):
        self.levels = levels
        p = (levels[0].counts + 1) / (train_tokens + train_types + 1)
        self.arcs, self.prices = [np.log10(p)], [None]  # every word has an arc from the empty context
        self.known = levels[0].counts > 0
        for n, level in enumerate(levels[1:], 1):
            context = levels[n - 1].counts
            if n == 1:
                context = context.copy()
                context[BEGIN] = context[END]  # as many texts begin as end
                self.start = int(context[BEGIN] > 0)
            # of each n-gram, from the shorter one that ends it
            p = (level.counts + mu[n - 1] * p[level.suffix]) / (context[level.prefix] + mu[n - 1])
            self.arcs.append(np.where(level.counts > 0, np.log10(p), self.NO_ARC))
            self.prices.append(np.log10(mu[n - 1] / (context + mu[n - 1])))

    def traverse(self, tokens: np.ndarray, place: slice) -> float:
        """The logarithms on the way of one text, read from left to right; ``place`` is where it lies, its begin left out."""
        top = len(self.levels) - 1
        read = [level.at[place] for level in self.levels]
        before = slice(place.start - 1, place.stop - 1)
        arcs = [a[g].tolist() if not n else np.where(g >= 0, a[g], self.NO_ARC).tolist()
                for n, (a, g) in enumerate(zip(self.arcs, read))]
        # what it costs to leave the state that ends at the token before
        prices = [None] + [p[tokens[before] if n == 1 else self.levels[n - 1].at[before]].tolist()
                           for n, p in enumerate(self.prices) if n]
        known = self.known[read[0]].tolist()
        state, total = self.start if top else 0, 0.0
        for i in range(len(known)):
            while arcs[state][i] > 0:
                total += prices[state][i]
                state -= 1
            total += arcs[state][i]
            if state < top:
                state = state + 1 if state or known[i] else 0
        return total


def score_block(content: Content, train_tokens: int, train_types: int, mu: tuple[float, ...]) -> pd.DataFrame:
    machine = Automaton(content.levels, train_tokens, train_types, mu)
    words = content.tokens != BEGIN
    base = np.add.reduceat(np.where(words, machine.arcs[0][content.tokens], 0), content.starts)
    n_known = np.add.reduceat((words & machine.known[content.tokens]).astype(np.int64), content.starts)
    scores = [machine.traverse(content.tokens, slice(a + 1, b)) for a, b in zip(content.starts.tolist(), content.ends.tolist())]
    return pd.DataFrame({"id": content.ids, "held_out": content.held, "n_tokens": content.ends - content.starts - 1,
                         "n_known": n_known, "train_tokens": train_tokens, "base_score": base, "score": scores})


def scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, mu: tuple[float, ...] = MU,
           modulus: int = MODULUS, held: int = HELD, tokens: int = TOKENS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score``, the log10 probability of the text under the model."""
    spark = docs.sparkSession
    blocks = blocks_of(docs, id_col, text, tokens, modulus, held)
    size = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket))
    width = key_bytes(size)
    totals = answered(asked(blocks, order, buckets, width), width)
    whole = totals.where("order = 1").agg(F.sum("mass"), F.sum("types")).first()
    train_tokens, train_types = int(whole[0] or 0), int(whole[1] or 0)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        content = Content(left.iloc[0], order, width)
        right = right.sort_values(["order", "bucket"])
        for n, level in enumerate(content.levels, 1):
            level.counts = np.zeros(len(level.keys), np.int64)
            mine = right["totals"][right["order"] == n]
            if len(mine):
                level.counts[np.argsort(level.keys)] = np.concatenate([from_planes(t) for t in mine])
        return score_block(content, train_tokens, train_types, mu)

    schema = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = (spread(blocks, "block").groupBy("block").cogroup(spread(totals.drop("types", "mass"), "block").groupBy("block"))
             .applyInPandas(run, schema))
    kind = docs.schema[id_col].dataType
    return found.select(F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                        "score")
