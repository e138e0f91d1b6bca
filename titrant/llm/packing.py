"""Packing tokenised documents into sequences: dominance reduction, then best fit.

A document is its token ids and one closing id 0. Documents longer than a sequence are cut into whole sequences and a
rest; nothing else is cut. Lengths are whole numbers from 1 to ``capacity``, so however many pieces there are, the
instance is a histogram of at most ``capacity`` counts; only that histogram reaches the driver.

1. Dominance reduction (Martello and Toth): from the longest length down, a set that dominates every other set with that
   length is fixed for as many copies as there are: the length alone when nothing fits beside it, an exact complement,
   the longest companion when two cannot fit, or a pair (triple) that dominates when three cannot. Fixed sets leave the
   instance.
2. The remaining lengths are packed best-fit decreasing, bins of one filling being handled as one group.

The outcome is a list of patterns (a few lengths each) with repetition counts, at most a few for each length. Pieces get
a rank within their length from salted row numbers (of n pieces of one length, about the square root of n salts with as
many rows each, so one very common length is spread over many tasks) and find sequence and offset from the rank.

Ids are the tokenizer's own as it comes: strings of its special tokens in a text are those tokens.

Cases: null text counts as empty, an empty document is the single closing id; equal documents are packed one by one; an
empty table gives an empty result; a document of exactly k times ``capacity`` ids makes k pieces; other columns are
ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written

CAPACITY = 2048
MEMO = 500_000  # parts of words a worker remembers

Pattern = list[tuple[int, int]]


class WordIds:
    """Little-endian ids of texts by the tokenizers library, each different part of a word being encoded once.

    That holds for tokenizers that normalise and split as ``SPLITS`` says, into ``PARTS`` of the lower-cased text, as long as it
    holds no characters beyond Latin-1, none of the separators that only some splitters take for white space and none
    of the tokenizer's added tokens. Other texts, and all texts of other tokenizers, go to the library whole. Before the first text
    every pair of shapes is compared with the library's own ids; a difference means that all texts go to the library. The first text
    of each batch is compared too; should that ever differ, the batch is done anew and the worker goes on by the library."""

    PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\xff]")
    PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
    # The normaliser and splitter that PLAIN and PARTS follow.
    SPLITS = (
        [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
        {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    )

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        told = json.loads(self.library.to_str())
        steps = [(told[k] or {}).get(name, [{}]) for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.short = (steps[0], steps[1][0].get("pattern")) == self.SPLITS and told["model"].get("end_of_word_suffix") == "</w>"
        self.added = [t["content"].lower() for t in told["added_tokens"]]
        ends = np.zeros(self.library.get_vocab_size(), bool)
        ends[[i for piece, i in self.library.get_vocab().items() if piece.endswith("</w>")]] = True
        self.ends = ends
        self._forget()
        self.short = self.short and self._agrees()
        self._forget()

    def _agrees(self) -> bool:
        """Whether the short way gives the library's ids for every pair of shapes that can meet in a text, before any text is
        handed on: how a text is split at a place follows from the characters on both sides and the contractions."""
        shapes = [*map(chr, (*range(0x1C), *range(0x20, 0x85), *range(0x86, 0x100)))]
        kinds = [*" \t\n\x0b\r\xa0a\xaa\xdf\xe9zZ\xc90\xb2\xbd.,'-_\"\x00\x7f\x84\xad\xb7", "'s", "'S", "'t", "'re", "'ve", "'m", "'ll", "'d", "ab", "12", "..", "''", "  "]
        texts = [*shapes, *(a + b for a in kinds for b in kinds), *("b" + a + b + "c" for a in kinds for b in kinds), *("7" + c + "x" for c in shapes)]
        own = self.batch(texts)
        library = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return all(a == np.array(b.ids, "<u4").tobytes() for a, b in zip(own, library, strict=True))

    def ids(self, batch: list[str]) -> np.ndarray:
        return np.array(self.library.encode_batch_fast(batch, add_special_tokens=False)[0].ids, "<u4")

    def _forget(self) -> None:
        """Every part met has a slot: where its ids begin in ``flat``, and how many they are."""
        self.slots: dict[str, int] = {}
        self.flat, self.first, self.count = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, parts: list[str], raws: list[bytes]) -> None:
        self.slots.update(zip(parts, range(len(self.slots), len(self.slots) + len(parts)), strict=True))
        count = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        self.first = np.r_[self.first, len(self.flat) + np.cumsum(count) - count]
        self.count, self.flat = np.r_[self.count, count], np.r_[self.flat, np.frombuffer(b"".join(raws), "<u4")]

    def learn(self, new: list[str]) -> None:
        """Slots for parts not met before."""
        ids = self.ids([" ".join(new)])
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(stops) == len(new):
            self._add(new, list(map(ids.tobytes().__getitem__, map(slice, [0, *stops[:-1]], stops))))
        else:  # a part that the library cuts in two
            self._add(new, [self.ids([p]).tobytes() for p in new])

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.slots) > MEMO:
            self._forget()
        low = [t.lower() for t in texts]
        whole = [not self.short or bool(self.PLAIN.search(t)) or any(a in w for a in self.added) for t, w in zip(texts, low, strict=True)]
        split = [[] if w else self.PARTS.findall(t) for t, w in zip(low, whole, strict=True)]
        parts = list(chain.from_iterable(split))
        slots = np.fromiter(map(self.slots.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(slots < 0).tolist()
        if new:
            strange = list(map(parts.__getitem__, new))
            self.learn(list(dict.fromkeys(strange)))
            slots[new] = list(map(self.slots.__getitem__, strange))
        count = self.count[slots]
        ends = np.cumsum(count)
        raw = self.flat[np.repeat(self.first[slots] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        stops = (4 * np.r_[0, ends][np.cumsum([len(w) for w in split])]).tolist() if texts else []
        out = [self.ids([t]).tobytes() if w else raw[a:b] for t, w, a, b in zip(texts, whole, [0, *stops[:-1]], stops, strict=True)]
        if self.short and texts and self.ids(texts[:1]).tobytes() != out[0]:
            self.short = False
            return self.batch(texts)
        return out


_loaded: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, WordIds(tokenizer))
        for batch in batches:
            rows = []
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                for doc, raw in zip(part["doc_id"].to_pylist(), encoder.batch(part["text"].to_pylist()), strict=True):
                    raw += b"\0\0\0\0"
                    for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                        some = raw[at : at + 4 * capacity]
                        rows.append((doc, i, at // 4, len(some) // 4, zlib.crc32(some)))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(names))

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_by_dominance(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Fix dominating sets; ``counts[w]`` (pieces of length w, w from 0 to the capacity) is left with the remainder."""
    capacity, fixed = len(counts) - 1, []
    for j in range(capacity, 0, -1):
        while counts[j]:
            chosen = _dominating(counts, j, capacity - j)
            if chosen is None:
                break
            pattern = sorted(Counter([j, *chosen]).items(), reverse=True)
            times = min(int(counts[w]) // m for w, m in pattern)
            for w, m in pattern:
                counts[w] -= m * times
            fixed.append((pattern, times))
    return fixed


def _dominating(counts: np.ndarray, j: int, rest: int) -> list[int] | None:
    """Companions of one piece of length j in a set that dominates all sets with j, or None if this test finds none."""
    counts[j] -= 1
    try:
        fit = np.flatnonzero(counts[: rest + 1])
        if not len(fit):
            return []
        if counts[rest]:
            return [rest]
        small = np.repeat(fit[:3], np.minimum(counts[fit[:3]], 3))[:3]
        longest = int(fit[-1])
        if len(small) < 2 or small[0] + small[1] > rest:
            return [longest]
        if len(small) > 2 and small.sum() <= rest:
            return None
        at_most = np.full(rest + 1, -1, np.int64)  # the longest present length up to each
        at_most[fit] = fit
        at_most = np.maximum.accumulate(at_most)
        first = fit[(fit >= small[0]) & (rest - fit >= 0)]
        second = at_most[np.minimum(first, rest - first)]
        alone = (second == first) & (counts[first] < 2)
        second = np.where(alone, np.where(first > 0, at_most[np.maximum(first - 1, 0)], -1), second)
        ok = second > 0
        if not ok.any() or longest >= (first + second)[ok].max():
            return [longest]
        with_longest = int(second[first == longest][0])
        if with_longest > 0 and with_longest >= second[ok].max():
            return [longest, with_longest]
        return None
    finally:
        counts[j] += 1


def best_fit(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing; bins with the same filling are one group."""
    capacity = len(counts) - 1
    room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for w in range(capacity, 0, -1):
        left = int(counts[w])
        while left:
            r = next((r for r in range(w, capacity) if room.get(r)), capacity)
            pattern, bins = room[r].pop() if r < capacity else ([], left)
            each = r // w
            full = min(bins, left // each)
            if full:
                room[r - each * w].append(([*pattern, (w, each)], full))
                left -= full * each
            if full < bins and left:  # fewer than a bin takes
                room[r - left * w].append(([*pattern, (w, left)], 1))
                left, full = 0, full + 1
            if full < bins and r < capacity:
                room[r].append((pattern, bins - full))
    return [x for groups in room.values() for x in groups]


def plan(counts: np.ndarray) -> np.ndarray:
    """Rows (length, first rank, pieces to a sequence, first sequence, first offset), by length and rank."""
    counts = counts.copy()
    rows, next_rank, sequence = [], defaultdict(int), 0
    for pattern, times in [*reduce_by_dominance(counts), *best_fit(counts)]:
        offset = 0
        for w, m in pattern:
            rows.append((w, next_rank[w], m, sequence, offset))
            next_rank[w] += m * times
            offset += m * w
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(cut: DataFrame, counts: np.ndarray) -> DataFrame:
    """``cut`` with the rank (from 0) of each piece among the pieces of its length."""
    spark = cut.sparkSession
    salts = spark.createDataFrame([(int(w), math.isqrt(int(counts[w]) - 1) + 1) for w in np.flatnonzero(counts)], "length long, salts long")
    keyed = cut.join(F.broadcast(salts), "length")  # at most one row for each possible length
    keyed = keyed.withColumn("salt", F.expr("pmod(xxhash64(doc_id, piece), salts)")).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    base = base.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start"))
    return keyed.withColumn("within", within).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within") - 1).drop("salt", "within", "base")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, tokenizer, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for w, n in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[w] = n
    rows = plan(counts)
    key = rows[:, 0] << 44 | rows[:, 1] if len(rows) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            _, first, each, sequence, offset = rows[np.searchsorted(key, length << 44 | rank, "right") - 1].T
            k = rank - first
            out = {c: batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": sequence + k // each, "offset": offset + k % each * length})

    return ranked(cut, counts).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
