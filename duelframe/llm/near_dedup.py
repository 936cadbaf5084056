"""Near-duplicates: MinHash signatures joined through an inverted index on (coordinate, value), then exact checks.

A document's set holds its distinct 5-word shingles, A-Z lower-cased.  Documents with equal sets form one class, and
only one member of a class goes on.  Steps:

1. Post every class under each coordinate-value pair of its signature and count how many classes share the pair.
   A class with fewer shared pairs than ``least_matches`` can't reach the threshold with anyone and is skipped.
2. Prefix: with its shared pairs in order of frequency, a class keeps all but the last ``least_matches - 1``.  Two
   classes that agree on ``least_matches`` coordinates have a pair in common among those.
3. Merge: in every posting list each member is compared with one hub, the member whose coordinates are the most
   frequent (in a group of copies the one closest to all).  Members and hub that agree on ``least_matches`` coordinates
   are checked on full sets, and links join components.
4. Where a hub's lists still hold several components, all pairs of members from different components are compared,
   block by block: coordinates first, full sets where enough agree.  Only links leave a block.

So pairs are never emitted for a whole list, and none is left out: two classes that share a prefix pair share its hub.
Signatures can miss: a pair at similarity 0.75 agrees on fewer than 32 of 64 coordinates about once in 200,000.

Defined results: a null text or one without words has an empty set and links with nothing, not even its like.  A text
of fewer than five words has one shingle, the whole.  Rows that share a ``doc_id`` are one document, which has the links
of all of them.  Rows with null id take part and get the smallest id they are linked with, or null.  Extra columns pass
through ``keep_first``; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize
from .base import salted_join, text_of, with_known_size, written
from .components import connected

WORDS = 5
COORDINATES = 64
LEAST_MATCHES = 32
SIMILARITY = (75, 100)
BLOCK = 256
CACHE_WORDS = 200_000  # about 40 MB of a worker
SEED = 2024


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) < 64:
            self[word] = out
        return out


def shingles(text: str, words: WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    if len(words) > CACHE_WORDS:
        words.clear()
    tokens = text.encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = _mixed(out + h[k:k + n])
    return np.unique(out)


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def signature(sets: list[np.ndarray], multipliers: np.ndarray) -> np.ndarray:
    """Minima of 32-bit hashes, one column per coordinate; no set is empty."""
    all_hashes = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(multipliers)), np.uint32)
    for k, m in enumerate(multipliers):
        out[:, k] = np.minimum.reduceat(((all_hashes * m) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketches(docs: DataFrame, id_col: str, text: str, coordinates: int) -> DataFrame:
    """Written table, one row per document: ``id``, ``at`` (hash of the text), ``n``, the set's 128-bit digest ``d1``,
    ``d2``, and ``sig``."""
    multipliers = _multipliers(coordinates)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("at", "n", "d1", "d2")],
        T.StructField("sig", T.ArrayType(T.IntegerType()))])

    def rows_of(ids: list, places: list, sets: list[np.ndarray]) -> pd.DataFrame:
        full = [s for s in sets if len(s)]
        sigs = iter(signature(full, multipliers).view(np.int32) if full else ())
        rows = [(doc, at, len(s), *_digest(s), next(sigs) if len(s) else None) for doc, at, s in zip(ids, places, sets)]
        return _nullable(pd.DataFrame(rows, columns=schema.names), schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            ids, places, sets, held = [], [], [], 0
            for doc, at, content in zip(batch["id"], batch["at"], batch["text"]):
                ids.append(doc)
                places.append(at)
                sets.append(shingles(content, words))
                held += len(sets[-1])
                if held > 50_000:  # small enough for the processor's cache
                    yield rows_of(ids, places, sets)
                    ids, places, sets, held = [], [], [], 0
            if ids:
                yield rows_of(ids, places, sets)

    return written(_placed(docs, id_col, text).mapInPandas(run, schema), "sketch")


def _digest(s: np.ndarray) -> tuple[int, int]:
    d1, d2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(d1), int(d2)


def _nullable(frame: pd.DataFrame, schema: T.StructType) -> pd.DataFrame:
    """Integer ids stay integers beside nulls."""
    return frame.astype({"id": "Int64"}) if schema["id"].dataType.typeName() in ("long", "integer") else frame


def _placed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    content = text_of(text)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(content).alias("at"), content.alias("text"))


def classes_of(sketched: DataFrame) -> DataFrame:
    """Written table, one row per distinct non-empty set: ``node`` (a number of its own), a row that has it, and ``sig``."""
    row = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    found = sketched.where("n > 0").groupBy("d1", "d2").agg(F.min(row).alias("row"), F.first("n").alias("n"),
                                                            F.first("sig").alias("sig"))
    return written(found.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", F.col("row.id").alias("id"),
                                F.col("row.at").alias("at"), "n", "sig"), "classes")


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """Written table ``node``, ``n``, ``sig``, ``set`` for classes; the sets are made again from their texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            held, rows = 0, []
            for node, n, sig, content in zip(batch["node"], batch["n"], batch["sig"], batch["text"]):
                rows.append((node, n, sig, shingles(content, words).tobytes()))
                held += 8 * n
                if held > 4 << 20:
                    yield pd.DataFrame(rows, columns=["node", "n", "sig", "set"])
                    held, rows = 0, []
            if rows:
                yield pd.DataFrame(rows, columns=["node", "n", "sig", "set"])

    key = lambda df: df.withColumns({"none": F.col("id").isNull(), "key": F.coalesce("id", "at")}).drop("id")
    texts = key(_placed(docs, id_col, text))
    found = texts.join(with_known_size(key(wanted), 100_000), ["none", "key", "at"])
    sets = found.select("node", "n", "sig", "text").mapInPandas(run, "node long, n long, sig array<int>, set binary")
    # a repeated row gives its class a second time
    return written(sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "sig", "set")]), "sets")


def prefix_lists(classes: DataFrame, least_matches: int) -> DataFrame:
    """Posting lists of the prefixes: ``key`` (coordinate and value), ``node``, ``weight`` (how frequent its pairs are)."""
    posted = classes.select("node", F.posexplode("sig").alias("k", "v")).select(
        "node", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("key"))
    frequent = posted.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    pairs = posted.join(frequent, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("p"))
    pairs = pairs.where(F.size("p") >= least_matches)  # at most one entry per coordinate
    weight = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    prefix = F.slice("p", F.lit(1), F.size("p") - (least_matches - 1))
    return materialize(pairs.select("node", weight.alias("weight"), F.explode(prefix).alias("x"))
                       .select(F.col("x.key").alias("key"), "node", "weight"))


def hub_pairs(lists: DataFrame) -> DataFrame:
    """Distinct (``node``, ``hub``) over all lists."""
    hubs = materialize(lists.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("h"), F.count(F.lit(1)).alias("size"))
                       .where("size > 1").select("key", F.col("h.node").alias("hub")))
    return materialize(lists.join(hubs, "key").where("node <> hub").select("node", "hub").distinct())


def _similar(inter, n_a, n_b, similarity: tuple[int, int]):
    return similarity[1] * inter >= similarity[0] * (n_a + n_b - inter)


def star_links(pairs: DataFrame, sets: DataFrame, least_matches: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (``a``, ``b``) among the pairs of nodes with their hubs."""
    x = sets.select("node", F.col("n").alias("n_x"), F.col("sig").alias("sig_x"), F.col("set").alias("set_x"))
    y = sets.select(F.col("node").alias("hub"), F.col("n").alias("n_y"), F.col("sig").alias("sig_y"), F.col("set").alias("set_y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            same = (np.stack(b["sig_x"].to_list()) == np.stack(b["sig_y"].to_list())).sum(1) if len(b) else np.zeros(0, int)
            links = []
            for k in np.flatnonzero(same >= least_matches):
                r = b.iloc[k]
                u, v = np.frombuffer(r.set_x, np.uint64), np.frombuffer(r.set_y, np.uint64)
                if _similar(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v), similarity):
                    links.append((r.node, r.hub))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    low, high = similarity
    near = (low * F.col("n_x") <= high * F.col("n_y")) & (low * F.col("n_y") <= high * F.col("n_x"))
    return pairs.join(x, "node").join(y, "hub").where(near).mapInPandas(run, "a long, b long")


def block_links(pairs: DataFrame, roots: DataFrame, sets: DataFrame, least_matches: int, similarity: tuple[int, int],
                block: int) -> DataFrame:
    """Links between members of different components under one hub, compared in blocks."""
    family = pairs.join(roots, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("root"))
    open_hubs = family.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                          F.count(F.lit(1)).alias("size")).where("lo < hi")
    open_hubs = materialize(open_hubs.select("hub", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    members = family.join(open_hubs, "hub").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.join(sets, "node").withColumn("other", others).select(
        "hub", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root", "n", "sig", "set")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["mine", "node"], ignore_index=True)
        sig, roots_, n = np.stack(group["sig"].to_list()), group["root"].to_numpy(), group["n"].to_numpy()
        first = np.flatnonzero(group["mine"] == group["mine"].iloc[0])
        second = np.flatnonzero(group["mine"] != group["mine"].iloc[0])
        within = not len(second)
        if within:
            if group["i"].iloc[0] != group["j"].iloc[0]:
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
            second = first
        alike = np.stack([(sig[x] == sig[second]).sum(1) for x in first]) >= least_matches
        alike &= roots_[first][:, None] != roots_[second][None, :]
        a, b = n[first][:, None], n[second][None, :]
        alike &= (similarity[0] * a <= similarity[1] * b) & (similarity[0] * b <= similarity[1] * a)
        if not alike.any():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        used_a, used_b = np.flatnonzero(alike.any(1)), np.flatnonzero(alike.any(0))
        inter = overlaps([np.frombuffer(group["set"].iloc[first[k]], np.uint64) for k in used_a],
                         [np.frombuffer(group["set"].iloc[second[k]], np.uint64) for k in used_b])
        linked = alike[np.ix_(used_a, used_b)] & _similar(inter, a[used_a], b[:, used_b], similarity)
        out, parent = [], {}

        def top(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for x, y in zip(*np.nonzero(linked)):  # as many links as join components of this block, no more
            u, v = first[used_a[x]], second[used_b[y]]
            ru, rv = top(roots_[u]), top(roots_[v])
            if ru != rv:
                parent[ru] = rv
                out.append((group["node"].iloc[u], group["node"].iloc[v]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(4 * n, "hub", "i", "j").groupBy("hub", "i", "j").applyInPandas(compare, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, some thousand shingles at a time."""
    n = [len(left), len(right)]
    sizes = [len(s) for s in (*left, *right)]
    row = np.repeat(np.arange(sum(n)), sizes)
    _, column, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros(n, np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [start, start + columns])
        present = np.zeros((sum(n), columns), np.float32)
        present[row[lo:hi], column[lo:hi] - start] = 1
        out += present[:n[0]] @ present[n[0]:].T
    return np.rint(out).astype(np.int64)


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", coordinates: int = COORDINATES,
               least_matches: int = LEAST_MATCHES, similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, ``at`` (hash of the text), ``n_shingles``, ``component_id``, ``kept``."""
    sketched = sketches(docs, id_col, text, coordinates)
    classes = classes_of(sketched)
    pairs = hub_pairs(prefix_lists(classes.select("node", "sig"), least_matches))
    wanted = pairs.select("node").union(pairs.select("hub")).distinct()
    sets = _full_sets(docs, classes.select("node", "id", "at", "n", "sig").join(wanted, "node"), id_col, text)
    links = materialize(star_links(pairs, sets, least_matches, similarity).union(_same_id(sketched, classes)))
    more = block_links(pairs, connected(links), sets, least_matches, similarity, block)
    roots = connected(materialize(links.union(more)))
    owned = classes.select("d1", "d2", "node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = owned.groupBy("root").agg(F.min("id").alias("component_id"))
    named = owned.join(materialize(smallest), "root").select("d1", "d2", "component_id")
    out = salted_join(sketched.select("id", "at", "n", "d1", "d2"), named, ["d1", "d2"], ["id", "at"])
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "at", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def _same_id(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id; none where ids are unique."""
    rows = sketched.where("id IS NOT NULL AND n > 0").select("id", "d1", "d2")
    several = rows.groupBy("id").agg(F.min("d1").alias("lo1"), F.max("d1").alias("hi1"), F.min("d2").alias("lo2"),
                                     F.max("d2").alias("hi2")).where("lo1 < hi1 OR lo2 < hi2").select("id")
    nodes = rows.join(several, "id", "left_semi").distinct().join(classes.select("d1", "d2", "node"), ["d1", "d2"])
    nodes = materialize(nodes.select("id", "node"))
    first = nodes.groupBy("id").agg(F.min("node").alias("b"))
    return nodes.join(first, "id").where("node <> b").select(F.col("node").alias("a"), "b")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; columns unchanged."""
    dropped = components(docs, id_col, text, **more).where("NOT kept AND component_id IS NOT NULL")
    gone = materialize(dropped.select(F.coalesce(id_col, "at").alias("_key"), "at").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(text_of(text)).alias("at"),
                       F.coalesce(F.col(f"`{id_col}`"), F.xxhash64(text_of(text))).alias("_key"))
    return rows.join(with_known_size(gone), ["_key", "at"], "left_anti").select("_row.*")
