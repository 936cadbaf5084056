"""Packing by concatenating and cutting: two-pass prefix sums give global offsets, then fixed windows.

Pass one tokenises each partition in order, keeps the running token count, and writes the ids with their offset in the
partition to the shared folder.  The partitions' totals, one number each, are summed up to give every partition its
global start.  Pass two reads the written ids and cuts each document at multiples of the window; documents that cross a
boundary get a piece on either side.  No text or id is shuffled, and only the last sequence is padded.

Tokens of a text are those of its blank-separated words in order: the tokenizer drops white space and never joins across
it.  A task takes some megabytes of text at once as Arrow columns: their different words are found first, each is looked up
once in the worker's table, and the ids are gathered by the words' places.  Words not in the table are encoded together;
stems of small Latin letters are one unit to the tokenizer and go straight to its model, others through all of it.

Defined results: a null text is empty; every document ends with ``end_id``, so an empty one is that id alone.  Repeated
rows are packed each for itself; null ids pass through.  Other columns aren't read.  An empty table gives no piece.
"""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .base import text_of, written

WINDOW = 4096
END_ID = 2
CACHE_BYTES = 120 << 20  # of either table, about
MARK = "\x01"
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"  # Latin; U+0130 becomes two characters in lower case
BEHIND = ".,;:!?#$%&*|"
PLAIN = rf"^[{LETTERS}]+[{BEHIND}]*$"
STEM = rf"^[{LETTERS}]+$"
CHUNK_BYTES = 16 << 20  # of text worked on at once
BATCH_BYTES = 4 << 20  # of ids handed on at once
PROBES = ("a", "the", "internationalisation", "abcdefghijklmnopqrstuvwxyz", "qqxzzk", "don", "ll", "s", "xn")
NO_WORDS, NO_IDS = pa.array([], pa.string()), pa.array([], pa.binary())


def byte_letters() -> str:
    """What the models see for each byte of a text of Latin letters and blanks; not a character elsewhere."""
    from tokenizers.pre_tokenizers import ByteLevel

    level, seen = ByteLevel(add_prefix_space=False, use_regex=False), ["\ufffe"] * 256
    for n in (0x20, *range(ord("a"), ord("z") + 1)):
        seen[n] = chr(n)
    for n in range(0xC0, 0x250):
        for byte, letter in zip(chr(n).encode(), level.pre_tokenize_str(chr(n))[0][0]):
            seen[byte] = letter
    return "".join(seen)


def joined_every(flat: pa.BinaryArray, bounds: np.ndarray) -> pa.BinaryArray:
    """The values of ``flat`` between bounds run together, without a copy."""
    offsets = np.frombuffer(flat.buffers()[1], "<i4")[bounds]
    data = flat.buffers()[2] or pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), data])


class WordIds:
    """Ids of whole texts, little-endian unsigned 32 bit, from a table of the words met.

    Words not met yet are encoded together, stems and punctuation each once.  When the table is full it becomes the older
    one, from which words in use are taken over, and a new one begins.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._ids(MARK)
        self.letters = byte_letters()
        self.units = Tokenizer(self.tokenizer.model)
        self.units.pre_tokenizer = CharDelimiterSplit(" ")
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.last[[k for word, k in vocab.items() if suffix and word.endswith(suffix)]] = True
        self.direct = bool(suffix) and self._agrees()
        self.most: int | None = None  # bytes of either table, if not CACHE_BYTES
        self.forget()

    def forget(self) -> None:
        """Empty both tables."""
        self.known, self.older, self.known_ids, self.older_ids, self.held = NO_WORDS, NO_WORDS, NO_IDS, NO_IDS, 0
        pa.default_memory_pool().release_unused()

    def text(self, text: str) -> bytes:
        return self.texts(pa.array([text], pa.string()))[0].as_py()

    def texts(self, column: pa.StringArray, end: bytes = b"") -> pa.BinaryArray:
        """Ids of each text, ``end`` behind them."""
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        stops = split.offsets.to_numpy() - split.offsets[0].as_py()
        ids = pa.concat_arrays([self.words(coded.dictionary), pa.array([end], pa.binary())])
        order = np.insert(coded.indices.to_numpy(), stops[1:], len(ids) - 1)
        return joined_every(ids.take(pa.array(order)), stops + np.arange(len(stops)))

    def words(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of different words: of Latin letters in lower case and the punctuation behind them, which the tokenizer
        takes apart too; else of the word as it is."""
        plain = pc.match_substring_regex(words, PLAIN)
        stems = pc.if_else(plain, pc.utf8_rtrim(words, characters=BEHIND), words)
        offsets = np.frombuffer(words.buffers()[1], "<i4")[words.offset:words.offset + len(words) + 1]
        bounds = np.empty(2 * len(words) + 1, "<i4")
        bounds[::2] = offsets
        bounds[1::2] = offsets[:-1] + pc.binary_length(stems).to_numpy()
        data = words.buffers()[2] or pa.py_buffer(b"")
        parts = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds), data])
        twice = pa.array(np.repeat(plain.to_numpy(zero_copy_only=False), 2))
        coded = pc.if_else(twice, pc.utf8_lower(parts), parts).dictionary_encode()
        return joined_every(self._parts(coded.dictionary).take(coded.indices), np.arange(0, len(bounds), 2))

    def _parts(self, parts: pa.StringArray) -> pa.BinaryArray:
        """Ids of different parts, those not known yet learned."""
        if self.held > (self.most or CACHE_BYTES):
            self.older, self.older_ids, self.known, self.known_ids, self.held = self.known, self.known_ids, NO_WORDS, NO_IDS, 0
        place, known = pc.index_in(parts, value_set=self.known), len(self.known)
        gaps = place.is_null()
        new = parts.filter(gaps)
        if len(new):
            self.known = pa.concat_arrays([self.known, new])
            self.known_ids = pa.concat_arrays([self.known_ids, self._learned(new)])
            self.held += pc.sum(pc.binary_length(new)).as_py() + 200 * len(new)
            place = pc.replace_with_mask(place, gaps, pa.array(np.arange(known, known + len(new), dtype="<i4")))
        return self.known_ids.take(place)

    def _learned(self, new: pa.StringArray) -> pa.BinaryArray:
        """Ids of parts that aren't known: from the older table, the model alone, or the whole tokenizer."""
        place = pc.index_in(new, value_set=self.older)
        rest = new.filter(place.is_null())
        alone = pc.match_substring_regex(rest, STEM) if self.direct else pa.array(np.zeros(len(rest), bool))
        stems = self._units(rest.filter(alone))
        whole = pa.array(self._whole(rest.filter(pc.invert(alone)).to_pylist()), pa.binary())
        at, met = np.flatnonzero(place.is_null()), np.flatnonzero(place.is_valid())
        order = np.concatenate([met, at[np.flatnonzero(alone)], at[np.flatnonzero(pc.invert(alone))]])
        return pa.concat_arrays([self.older_ids.take(place.drop_null()), stems, whole]).take(pa.array(np.argsort(order)))

    def _agrees(self) -> bool:
        """Whether the model alone gives the tokenizer's ids: tried on every letter, pairs of letters, and words."""
        marks = [c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and c == c.lower()]
        tried = [*PROBES, *marks, *[a + b for a, b in zip(marks, marks[1:])], *[f"a{c}e{c}" for c in marks], "".join(marks)]
        return all(self._unit(self._letters(w.encode())) == np.array(self._ids(w), "<u4").tobytes() for w in tried)

    def _letters(self, words: bytes) -> str:
        """What the model sees of words of small Latin letters."""
        return codecs.charmap_decode(words, "strict", self.letters)[0]

    def _unit(self, letters: str) -> bytes:
        """Ids that the model alone gives for units between blanks."""
        return np.array(self.units.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _units(self, stems: pa.StringArray) -> pa.BinaryArray:
        if not len(stems):
            return NO_IDS
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(stems)], stems), " ")[0].as_buffer().to_pybytes()
        data = self._unit(self._letters(text))
        ends = 1 + np.flatnonzero(self.last[np.frombuffer(data, "<u4")])
        if len(ends) != len(stems):
            raise ValueError(f"{len(stems)} words have {len(ends)} last ids")
        offsets = np.concatenate([[0], 4 * ends]).astype("<i4")
        return pa.Array.from_buffers(pa.binary(), len(stems), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def _whole(self, words: list[str]) -> list[bytes]:
        """All in one text, each followed by a mark that is one id and no part of them; those with the mark alone."""
        plain, found = [w for w in words if w and MARK not in w], {"": b""}
        if plain:
            ids = np.array(self._ids(f" {MARK} ".join([*plain, ""])), "<u4")
            ends = np.flatnonzero(ids == self.mark)
            data, starts = ids.tobytes(), [0, *(4 * (ends[:-1] + 1)).tolist()]
            found.update(zip(plain, (data[x:y] for x, y in zip(starts, (4 * ends).tolist()))))
        found.update((w, np.array(self._ids(w), "<u4").tobytes()) for w in words if MARK in w)
        return [found[w] for w in words]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


_tables: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The table of this Python worker, which serves several tasks."""
    if path not in _tables:
        _tables[path] = WordIds(path)
    return _tables[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text",
             end_id: int = END_ID, cache_bytes: int | None = None, keep_words: bool = True) -> DataFrame:
    """Written table: id, ``ids`` (little-endian unsigned 32 bit), ``n``, ``part`` and ``before`` in the partition.

    ``keep_words`` leaves a worker's table of words to its next task, which is faster; without it a waiting worker holds
    the tokenizer alone, and its memory is free for other work.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()),
                           T.StructField("n", T.LongType()), T.StructField("part", T.IntegerType()),
                           T.StructField("before", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = word_ids(path), TaskContext.get().partitionId(), 0
        words.most = cache_bytes
        try:
            for rows in _chunks(batches):
                ids = words.texts(rows.column("text").cast(pa.string()), end)
                n = pc.binary_length(ids).to_numpy().astype("<i8") // 4
                at = before + np.cumsum(n)
                out = [rows.column("id"), ids, pa.array(n), pa.array(np.full(len(n), part, "<i4")), pa.array(at - n)]
                yield from _slices(pa.RecordBatch.from_arrays(out, names=schema.names), "ids", BATCH_BYTES)
                before = int(at[-1])
        finally:
            if not keep_words:
                words.forget()

    return written(docs.select(F.col(id_col).alias("id"), text_of(text).alias("text")).mapInArrow(run, schema), "tokens")


def _slices(rows: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes in a column."""
    group = np.cumsum(pc.binary_length(rows.column(column)).to_numpy().astype("<i8")) // most
    bounds = [0, *(1 + np.flatnonzero(np.diff(group))).tolist(), len(group)]
    return (rows.slice(x, y - x) for x, y in zip(bounds, bounds[1:]) if y > x)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about ``CHUNK_BYTES`` of text at once, however long the batches are."""
    waiting, held = [], 0
    for batch in batches:
        for rows in _slices(batch, "text", CHUNK_BYTES):
            waiting.append(rows)
            held += pc.sum(pc.binary_length(rows.column("text"))).as_py()
            if held >= CHUNK_BYTES // 2:
                yield pa.concat_batches(waiting)
                waiting, held = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    """Columns as objects where a null could change an integer into a float."""
    out = pd.DataFrame(rows, columns=schema.names)
    if out["id"].isna().any() and schema["id"].dataType.typeName() in ("long", "integer"):
        out["id"] = out["id"].astype("Int64")
    return out


def cut(tokens: DataFrame, id_type: T.DataType, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of the written ids; ``with_ids`` also returns each piece's ids, as the trainer's input."""
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    fields = [T.StructField("id", id_type), *[T.StructField(c, T.LongType()) for c in
              ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]]
    fields += [T.StructField("piece_ids", T.BinaryType())] * with_ids
    schema = T.StructType(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for doc, ids, n, at in zip(batch["id"], batch["ids"], batch["n"], batch["at"]):
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = ids[4 * start:4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(piece), n, sequence, offset)
                    rows.append((*row, piece) if with_ids else row)
                    held += len(piece) * with_ids + 100
                    start += length
                    if held > BATCH_BYTES:
                        yield _frame(rows, schema)
                        rows, held = [], 0
            if rows:
                yield _frame(rows, schema)

    placed = tokens.join(F.broadcast(bases), "part")  # one row per partition
    return placed.select("id", "ids", "n", (F.col("base") + F.col("before")).alias("at")).mapInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text",
         window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, cache_bytes: int | None = None,
         keep_words: bool = True) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    tokens = tokenise(docs, tokenizer, id_col, text, end_id, cache_bytes, keep_words)
    pieces = cut(tokens, docs.schema[id_col].dataType, window, with_ids)
    return pieces.withColumnRenamed("id", id_col)
