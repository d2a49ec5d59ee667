"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Texts become token ids, followed by one closing id, cut into pieces of at most ``capacity``. Only the histogram of
piece lengths (at most ``capacity`` rows) reaches the driver, where lengths are placed from the longest to the shortest
into the pack with most room left and whole groups of equal packs move at once. The resulting pattern counts are joined
back to the pieces by the rank that a piece has among those of its length; ranks come from salted counts, so a length
that a third of all pieces share is dealt over many tasks.

A null or empty text is the closing id alone. Repeated rows are packed each. Pieces of equal length are ranked by salt,
doc_id (nulls first), start and checksum; rows equal in all of these are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrose.llm.common import map_arrow, text_chunks, written

CAPACITY = 4096
END_ID = 2
#: Words whose ids a worker learns before it forgets those that it has not seen since as many were learnt before, and the
#: bytes of the longest word that is remembered at all.
CACHED_WORDS, CACHED_BYTES = 400_000, 48
#: How tokens that close a word end; a word that stands between others in one call; symbols cut off the end of a word.
WORD_END, MARK, TAIL = "</w>", b"\x01", b"!#$%&*+,-./:;<=>?@|~"
#: What splitting leaves before leading and after trailing white space.
NO_WORD = b""
#: What opens a special token, whose letters and symbols stay together as they are until white space.
OPENS = b"<|"
#: By byte: white space; ASCII letters and digits; symbols that may be cut off behind them.
_BLANK, _PLAIN, _SYMBOL = (np.isin(np.arange(256), list(x)) for x in (b"\t\n\x0b\x0c\r ", b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", TAIL))
#: Bytes of text that are split into words at a time; a longer text is a call by itself.
CALL_BYTES = 4 << 20
#: Pieces of one length and salt.
RANKED_TOGETHER = 50_000
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut(ids: np.ndarray, ends: np.ndarray, gap: int) -> list[bytes]:
    """The bytes of the ids up to each end, each part beginning ``gap`` bytes after the end before."""
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip([0, *(ends[:-1] + gap).tolist()], ends.tolist(), strict=True)] if len(ends) else []


def _loose(data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the places that no opening of a special token stands before in their word."""
    opened = np.flatnonzero((data[:-1] == OPENS[0]) & (data[1:] == OPENS[1]))
    if not len(opened):
        return at
    begins = np.union1d(np.flatnonzero(_BLANK[data]), offsets[:-1])
    last = begins[np.searchsorted(begins, at, "right") - 1]
    return at[np.searchsorted(opened, last) == np.searchsorted(opened, at, "right")]


def unified(data: np.ndarray, offsets: np.ndarray, lowers: bool) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space between a letter or digit and symbols behind it, and with small letters if case is not kept.

    Neither changes the ids: such symbols are tokens of their own. Letters before anything but ASCII stay, as a mark may
    compose with them before case is folded.
    """
    if len(data) < 2:
        return data, offsets
    if lowers:
        capital = (data >= ord("A")) & (data <= ord("Z"))
        capital[:-1] &= data[1:] < 128
        data = data.copy()
        data[_loose(data, offsets, np.flatnonzero(capital))] += 32
    cut = _PLAIN[data[:-1]] & _SYMBOL[data[1:]]
    at = _loose(data, offsets, np.flatnonzero(cut) + 1)
    return np.insert(data, at, ord(" ")), offsets + np.searchsorted(at, offsets)


class WordEncoder:
    """Ids by a tokenizer that drops white space and so treats words one by one; ids of short words are remembered.

    Only ASCII white space splits words here, the rest is left to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before = Tokenizer.from_file(path), {NO_WORD: b""}, {}
        normal = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        self.lowers = {"type": "Lowercase"} in (normal.get("normalizers") or [normal])
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _ids(self, text: str) -> np.ndarray:
        #: The fast form leaves out the places of the tokens in the text.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode(self, parts: list[bytes]) -> None:
        """Learn words. Words of letters have one id that closes them, so many go through one call; others are told apart
        by a mark, or go one by one where the mark is part of them."""
        text = [p.decode() for p in parts]
        plain = [k for k, x in enumerate(text) if x.isalpha()]
        ids = self._ids(" ".join([text[k] for k in plain]))
        ends = np.flatnonzero(self.closes[ids]) * 4 + 4
        if len(ends) == len(plain):
            self.known.update(zip([parts[k] for k in plain], _cut(ids, ends, 0), strict=True))
            rest = [k for k, x in enumerate(text) if not x.isalpha()]
        else:
            rest = range(len(text))
        if self.mark is None or any(MARK in parts[k] for k in rest):
            self.known.update((parts[k], self._ids(text[k]).tobytes()) for k in rest)
        elif rest:
            ids = self._ids(f" {MARK.decode()} ".join([text[k] for k in rest]))
            self.known.update(zip([parts[k] for k in rest], _cut(ids, np.append(np.flatnonzero(ids == self.mark), len(ids)) * 4, 4), strict=True))

    def _recalled(self, words: set[bytes]) -> set[bytes]:
        """The words that are not known, after those known before are known again."""
        new = words.difference(self.known)
        again = new & self.before.keys()
        self.known.update([(w, self.before[w]) for w in again])
        return new - again

    def flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Little-endian ids of consecutive texts, and where each text's ids begin and end in them.

        Each distinct word of a call is looked up once; its ids go to its places by their numbers.
        """
        data, offsets = unified(data, offsets, self.lowers)
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        split = pc.ascii_split_whitespace(texts)
        place = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        parts = coded.dictionary.cast(pa.large_binary()).to_pylist()
        new = self._recalled(set(parts))
        if new:
            self._encode(list(new))
        found = list(map(self.known.__getitem__, parts))
        for w in new:
            if len(w) > CACHED_BYTES:
                del self.known[w]
        if len(self.known) > CACHED_WORDS:
            self.known, self.before = {NO_WORD: b""}, self.known
        lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        codes = coded.indices.to_numpy()
        each = lengths[codes]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
        source = np.repeat((np.cumsum(lengths) - lengths)[codes] - ends[:-1], each)
        source += np.arange(len(source))
        return np.frombuffer(b"".join(found), "<u4")[source], ends[place - place[0]]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Little-endian ids of each text."""
        offsets = np.cumsum([0, *map(len, texts)], dtype=np.int64)
        ids, bounds = self.flat(np.frombuffer(b"".join(texts), np.uint8), offsets)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[a:b]


@cache
def encoder(path: str) -> WordEncoder:
    """One per worker; a function of the module, so that tasks share it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves."""
    schema = PIECE_SCHEMA + (", ids array<bigint>" if with_ids else "")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in text_chunks(batch, "text", CALL_BYTES):
            names = batch.column("doc_id")[lo:hi].to_pylist()
            out: list[list] = [[] for _ in range(5 + with_ids)]
            flat, bounds = encoder(tokenizer_path).flat(data, offsets)
            for name, a, b in zip(names, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids = np.append(flat[a:b], np.array([end_id], "<u4"))
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    for column, value in zip(out, (name, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.tolist() if with_ids else None), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64()) if i == 5 else pa.int64()) for i, x in enumerate(out)], names=[x.split()[0] for x in schema.split(", ")])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, run, schema)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(copies, lengths) of the packs: lengths longest first, each into the packs with most room."""
    #: By room left: groups of equal packs, as [copies, chain of lengths].
    open_packs: dict[int, list[tuple[int, tuple]]] = {}

    def put(room: int, copies: int, chain: tuple) -> None:
        if copies:
            open_packs.setdefault(room, []).append((copies, chain))

    for length in sorted(histogram, reverse=True):
        left, rooms = histogram[length], sorted((r for r in open_packs if r >= length), reverse=True)
        while left and rooms:
            room = rooms[0]
            copies, chain = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                rooms.pop(0)
            used = min(left, copies)
            put(room, copies - used, chain)
            put(room - length, used, (length, chain))
            left -= used
            if room - length >= length and room - length not in rooms:
                rooms = sorted((*rooms, room - length), reverse=True)
        fit = capacity // length
        for copies, n in ((left // fit, fit), (1, left % fit)):
            chain: tuple = ()
            for _ in range(n):
                chain = (length, chain)
            put(capacity - n * length, copies if n else 0, chain)
    done = []
    for groups in open_packs.values():
        for copies, chain in groups:
            lengths = []
            while chain:
                lengths.append(chain[0])
                chain = chain[1]
            done.append((copies, lengths[::-1]))
    return done


def ranked(rows: DataFrame, salts: int) -> DataFrame:
    """``rows`` with their gapless rank among those of their length."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    return rows.withColumn("inside", inside).join(before, ["length", "salt"]).withColumn("rank", F.col("inside") - 1 + F.coalesce("before", F.lit(0))).drop("inside", "before", "salt")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence and their offset in it."""
    rows = written(pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = sorted(patterns(histogram, capacity), key=lambda p: (-p[0], p[1]))
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for copies, lengths in found:
        offset = 0
        for length in lengths:
            by_length.setdefault(length, []).append((copies, base, offset))
            offset += length
        base += copies
    slots = [(length << 40 | sum_before, first, offset, sum_before) for length in sorted(by_length) for sum_before, (_, first, offset) in zip(np.r_[0, np.cumsum([c for c, _, _ in by_length[length]])].tolist(), by_length[length], strict=False)]
    shared = docs.sparkSession.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 4).T)

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, first, offset, before = shared.value
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, batch.column("length").to_numpy(zero_copy_only=False) << 40 | rank, "right") - 1
        kept = [c for c in batch.schema.names if c != "rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(first[at] + rank - before[at]), pa.array(offset[at])], names=[*kept, "sequence_id", "offset"])

    schema = PIECE_SCHEMA + (", ids array<bigint>" if with_ids else "") + ", rank bigint"
    salts = max(64, -(-max(histogram.values(), default=0) // RANKED_TOGETHER))
    return map_arrow(ranked(rows, salts).select(*(c.split()[0] for c in schema.split(", "))), place, schema.replace("rank bigint", "sequence_id bigint, offset bigint"))
