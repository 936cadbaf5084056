"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

Each word, its character n-grams and each pair of neighbouring words are hashed to one vector of a table; a document is
the average of its vectors, and a softmax layer gives the class.  A bounded, balanced sample of the labelled documents
is drawn by hash, ``sample`` per class, and trained in one task; the class shares of all labelled rows correct the bias.

Averaging and the output layer are linear, so for scoring each table row is folded to one number, its part in the
difference of the two classes' outputs.  A score is then the sigmoid of a mean, and every document is scored over its
whole text at the cost of one look-up per distinct word and pair.

Only the text is an input.  Rows whose id has crc32 mod 3 equal to 1 are held out and never trained on.

Defined results: a null or empty text has no vectors and gets the score of the bias.  Labels other than 0 and 1, null
labels and labels of unknown ids are ignored; repeated labels count each.  With labels of one class only, or none, every
score is that class's share, 0.5 without any.  Null ids are not held out and not trained on.  Repeated rows are scored
each, extra columns pass through ``with_scores``, an empty table gives an empty result.
"""

from __future__ import annotations

import collections
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize
from .base import text_of, with_known_size

SAMPLE = 3000  # documents per class, at most: the bound on what is trained on
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
EPOCHS = 6
STEPS = 800  # least number of steps of a round: few labels are passed over more often
ROUNDS = 4  # most rounds, each with the rate falling to zero
DONE = 0.05  # a round whose last epoch's mean loss is below this ends the training
FALL = 0.9  # and so does one that doesn't bring that loss below this part of the round's before
RATE = 2.0
BATCH = 16
CACHE_WORDS = 600_000
SEED = 77
SHARE_BOUND = 1e-3  # class shares stay this far from 0 and 1
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def word_features(words: list[bytes], buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """For distinct words: the number of the word, and a bucket of it, for the word itself and each of its n-grams."""
    text = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))  # places to the word's end
    owners, buckets_of = [np.arange(len(words))], [np.array([zlib.crc32(w) % buckets for w in words], np.int64)]
    for n in grams:
        h = np.full(max(0, len(text) - n + 1), n, np.uint64)
        for k in range(n):
            h = h * _PAIR + text[k:k + len(h)]
        inside = left[:len(h)] >= n
        owners.append(owner[:len(h)][inside])
        buckets_of.append(((h[inside] * _PAIR) >> np.uint64(40)).astype(np.int64) % buckets)
    return np.concatenate(owners), np.concatenate(buckets_of)


def word_hash(word: bytes) -> int:
    return zlib.crc32(word, SEED)


def pair_buckets(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of neighbours, from the difference of their hashes: a word next to itself always meets bucket 0."""
    return ((hashes[1:] - hashes[:-1]) * _PAIR >> np.uint64(40)).astype(np.int64) % buckets


def document_features(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and their shares; empty for a text without words."""
    tokens = text.encode("utf-8", "replace").split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    times = collections.Counter(tokens)
    owner, own = word_features(list(times), buckets)
    counts = np.fromiter(times.values(), np.float64, len(times))
    pairs = pair_buckets(np.array([word_hash(w) for w in tokens], np.uint64), buckets)
    found, at = np.unique(np.concatenate([own, pairs]), return_inverse=True)
    total = np.bincount(at, np.concatenate([counts[owner], np.ones(len(pairs))]), len(found))
    return found, (total / total.sum()).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, share: float, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS,
          rate: float = RATE, batch: int = BATCH, seed: int = SEED, least_steps: int = STEPS) -> np.ndarray:
    """The folded table: ``buckets`` numbers and, last, the bias.

    A round has ``epochs`` epochs or as many as ``least_steps`` takes; rounds follow until the loss is low or stops falling.
    """
    rng = np.random.default_rng(seed)
    features = [document_features(text, buckets) for text in texts]
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps = -(-len(texts) // batch)  # of an epoch
    epochs = max(epochs, -(-least_steps // steps))
    before = np.inf
    for _ in range(ROUNDS):
        step = 0
        for _ in range(epochs):
            loss = 0.0
            order = rng.permutation(len(texts))
            for start in range(0, len(order), batch):
                chosen = [k for k in order[start:start + batch] if len(features[k][0])]
                lr = rate * (1 - step / (epochs * steps))
                step += 1
                if not chosen:
                    continue
                ids = np.concatenate([features[k][0] for k in chosen])
                shares = np.concatenate([features[k][1] for k in chosen])
                starts = np.concatenate([[0], np.cumsum([len(features[k][0]) for k in chosen])[:-1]])
                hidden = np.add.reduceat(table[ids] * shares[:, None], starts)
                logits = hidden @ out + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                own = np.arange(len(chosen)), labels[chosen]
                loss -= float(np.log(np.maximum(p[own], 1e-12)).sum()) / len(texts)
                error = p
                error[own] -= 1
                back = lr * (error @ out.T)
                out -= lr / len(chosen) * hidden.T @ error
                bias -= lr / len(chosen) * error.sum(0)
                for b, k in zip(back, chosen):  # a document's buckets are distinct
                    table[features[k][0]] -= features[k][1][:, None] * b
        if loss < DONE or loss > FALL * before:
            break
        before = loss
    sampled = np.bincount(labels, minlength=2) / len(labels)
    shift = np.log(share / (1 - share)) - np.log(sampled[1] / sampled[0])
    return np.append(table @ (out[:, 1] - out[:, 0]), bias[1] - bias[0] + shift).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE) -> np.ndarray:
    """Train on at most ``sample`` documents per class.  ``labels``: ``id_col`` and ``label``."""
    known = labels.where(f"{id_col} IS NOT NULL AND {label} IN (0, 1)").where(~is_held_out(id_col))
    known = known.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    counts = {r._label: r["count"] for r in known.groupBy("_label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = np.clip(counts.get(1, 0) / total if total else 0.5, SHARE_BOUND, 1 - SHARE_BOUND)
        return np.array([*np.zeros(BUCKETS), np.log(share / (1 - share))], np.float32)
    # Drawn by hash at the rate that gives ``sample`` on average, then cut: no sort of all labels.
    u = F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = [known.where((F.col("_label") == k) & (u < 1.2 * sample / counts[k])).orderBy(u, "_id").limit(sample) for k in (0, 1)]
    chosen = materialize(drawn[0].union(drawn[1]).distinct())
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text).alias("_text")).join(with_known_size(chosen), "_id")
    share = counts[1] / total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in zip(b["_id"], b["_label"], b["_text"])]
        rows.sort()  # the same order whatever the partitions were
        if len({r[1] for r in rows}) == 2:
            model = train([r[2] for r in rows], np.array([r[1] for r in rows]), share)
        else:
            model = np.append(np.zeros(BUCKETS), np.log(share / (1 - share))).astype(np.float32)
        yield pd.DataFrame({"model": [model.tobytes()]})

    bounded = materialize(texts)  # at most two times ``sample`` documents
    return np.frombuffer(bounded.coalesce(1).mapInPandas(run, "model binary").first().model, np.float32)


class Scorer:
    """Scores texts with a folded table; the sums over each distinct word's features are kept until there are too many."""

    def __init__(self, model: np.ndarray):
        self.table, self.bias = model[:-1].astype(np.float64), float(model[-1])
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.sums, self.sizes, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def _learn(self, words: list[bytes]) -> None:
        first = len(self.numbers)
        self.numbers.update(zip(words, range(first, first + len(words))))
        owner, own = word_features(words, len(self.table))
        if first + len(words) > len(self.sums):
            self.sums, self.sizes, self.hashes = (np.concatenate([x, np.zeros(first + 2 * len(words), x.dtype)])
                                                  for x in (self.sums, self.sizes, self.hashes))
        place = slice(first, first + len(words))
        self.sums[place] = np.bincount(owner, self.table[own], len(words))
        self.sizes[place] = np.bincount(owner, minlength=len(words))
        self.hashes[place] = [word_hash(w) for w in words]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of some texts; what is done for several at once gives what it would give for each."""
        if len(self.numbers) > CACHE_WORDS:
            self.reset()
        split = [t.encode("utf-8", "replace").split() for t in texts]
        tokens = [w for words in split for w in words]
        doc = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        found = list(map(self.numbers.get, tokens))
        if None in found:
            gaps = [k for k, n in enumerate(found) if n is None]
            self._learn(list(dict.fromkeys([tokens[k] for k in gaps])))
            for k in gaps:
                found[k] = self.numbers[tokens[k]]
        numbers = np.array(found, np.int64)
        total, size = np.bincount(doc, self.sums[numbers], len(texts)), np.bincount(doc, self.sizes[numbers], len(texts))
        if len(tokens) > 1:
            same = doc[1:] == doc[:-1]
            pairs = pair_buckets(self.hashes[numbers], len(self.table))[same]
            total += np.bincount(doc[1:][same], self.table[pairs], len(texts))
            size += np.bincount(doc[1:][same], minlength=len(texts))
        mean = total / np.maximum(size, 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -500, 500)))


_scorers: dict[bytes, Scorer] = {}


def scorer_of(model: np.ndarray) -> Scorer:
    """The scorer of this Python worker, which serves several tasks; only the last model's is kept."""
    key = hashlib.sha1(model.tobytes()).digest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def score_column(docs: DataFrame, model: np.ndarray, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``BUCKETS`` numbers

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(shared.value)
        for batch in batches:
            out, group, held = [], [], 0
            for text in batch:
                group.append(text)
                held += len(text)
                if held > 1 << 20:
                    out.append(scorer.scores(group))
                    group, held = [], 0
            yield pd.Series(np.concatenate([*out, scorer.scores(group)]), dtype="float64")

    return score(text)


def with_scores(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``."""
    scored = docs.withColumn("score", score_column(docs, model, text_of(text)))
    return scored.withColumns({"held_out": is_held_out(id_col), "predicted": (F.col("score") >= 0.5).cast("int")})
