"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Tokens are white-space separated words. The most frequent words of the whole corpus have ids of their own, all others share
``RARE`` ids by a hash of the whole word, and one id stands beyond both ends of a document. For each position the network
sees the ``SIDE`` tokens before and the ``SIDE`` after it, never the token itself:

    hidden = tanh(sum over places of scale[place] * embed[token there] + shift)

and gives a distribution over all ids as a softmax factored into three levels of ``base`` choices each (ids are numbered by
frequency, so the first level tells frequent words from rare ones). A rare word costs its id and its spelling: the
probability of its bytes under a byte bigram model of all different words, as a share of its id's words.

Training covers every position of every document. ``ROUNDS`` times each task starts from the same weights, masks each
position of its documents once and takes an Adagrad step on ``STEP`` of them at a time; the changes are averaged, row by row,
over the tasks that touched a row, and are the next start. Sums stream through two levels of tasks, so the number of tasks
isn't bounded.

Memory: what occurs in the corpus more than once is known from both sides, too, but no weights of a fixed size hold that, so
the network has one cell for each context of two tokens before and two after, at the contexts whose hash is the least of
``2 * NEAR + 1`` neighbours (one in as many positions; the same contexts wherever a passage stands). Cells live in a table as
large as the corpus demands. A position whose cell occurs m times elsewhere, c times with this token, has the probability

    (network + c) / (1 + m)

that is, the network counts as one more occurrence; its own occurrence is left out, so a text that occurs once gains
nothing. A document's score is the sum over all its positions of the log-probabilities.

Cases: null, empty and blank texts have no tokens and score 0 with mean null; copies count as often as they occur, and each
remembers the others; words of one frequency have ids of their own all or none; words of over ``LONGEST`` bytes are rare however frequent;
documents of any length are handled whole; repeated rows have a row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, texts, written

BASE, RARE = 32, 4096  # BASE ** 3 ids
SIDE, HIDDEN = 3, 16
ROUNDS, STEP, RATE, SEED = 1, 1 << 17, 0.12, 5
NEAR = 7
LONGEST = 64
FLUSH = 200_000  # words that a task remembers at once
COUNTED = 2_000_000  # words, repeats included, that a task counts at once, unless one batch has more
POSITIONS = 1 << 17  # positions scored at once
CACHED = 1 << 11  # of them, whose layers are made at once: they stay in a core's cache
SCANNED = 1 << 15  # positions whose contexts are made at once, unless one text has more
BLOCK = 8192  # weights that are averaged at once
SALTS = 1024  # sums of a block's changes, before they are added up
OFFSETS = np.r_[-SIDE:0, 1 : SIDE + 1]


class Words:
    """Word to id. ``known``: words with ids of their own, the most frequent first; ``bigrams``: counts of byte pairs.

    Every word met has a slot; slots have an id and the cost of the spelling, log P(word among the words of its rare id)."""

    def __init__(self, known: list[bytes], bigrams: np.ndarray, base: int = BASE, rare: int = RARE):
        self.size, self.rare = base**3, rare
        self.end, self.first_rare = self.size - 1, self.size - 1 - rare
        self.known = known[: self.first_rare]
        self.cost = np.log((bigrams + 0.05) / (bigrams + 0.05).sum(axis=1, keepdims=True)).ravel()
        self._forget()

    def _forget(self) -> None:
        self.slots = {w: k for k, w in enumerate(self.known)}
        self.ids, self.spelled = np.arange(len(self.known)), np.zeros(len(self.known))

    def learn(self, new: list[bytes]) -> None:
        """Slots for rare words not met before."""
        raw = np.frombuffer(b"\0" + b"\0".join(new) + b"\0", np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
        spelled = np.add.reduceat(self.cost[raw[:-1] * 256 + raw[1:]], np.r_[0, ends[:-1]]) + np.log(self.rare)
        ids = self.first_rare + np.fromiter(map(zlib.crc32, new), np.int64, len(new)) % self.rare
        self.slots.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        self.ids, self.spelled = np.r_[self.ids, ids], np.r_[self.spelled, np.minimum(spelled, 0)]

    def code(self, batch: pa.Array | list[str]) -> list[tuple[np.ndarray, float]]:
        """For each text the id of each word, and the log-probability of the spelling of the rare ones."""
        if len(self.slots) > len(self.known) + FLUSH:
            self._forget()
        words, sizes = split_words(batch if isinstance(batch, pa.Array) else pa.array(batch, pa.string()))
        words = words.dictionary_encode()
        one = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary.cast(pa.binary()))
        every = pc.binary_join(one, b" ")[0].as_py().split()  # the different words
        slots = np.fromiter(map(self.slots.get, every, repeat(-1)), np.int64, len(every))
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = len(self.ids)
            self.learn(list(map(every.__getitem__, new.tolist())))
            slots[new] = np.arange(first, len(self.ids))
        slots = slots[words.indices.to_numpy()]
        ids, spelled = self.ids[slots], np.r_[0.0, np.cumsum(self.spelled[slots])]
        ends = np.cumsum(sizes)
        return [(ids[e - n : e], float(spelled[e] - spelled[e - n])) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def split_words(batch: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each text has."""
    parts = pc.ascii_split_whitespace(batch)
    words, counts = parts.flatten(), pc.list_value_length(parts).to_numpy()
    there = pc.binary_length(words).to_numpy() > 0  # empty: before white space at the beginning, after it at the end
    if not there.all():
        words, counts = words.filter(pa.array(there)), np.diff(np.r_[0, np.cumsum(there)][np.r_[0, np.cumsum(counts)]])
    return words, counts.astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), n over all documents."""

    def tally(held: list[pa.Array]) -> pa.RecordBatch:
        words = pa.concat_arrays(held).dictionary_encode()
        n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        return pa.RecordBatch.from_pydict({"word": words.dictionary.cast(pa.binary()), "n": pa.array(n, pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0
        for batch in batches:
            held.append(split_words(batch["text"])[0])
            size += len(held[-1])
            if size >= COUNTED:
                yield tally(held)
                held, size = [], 0
        if held:
            yield tally(held)

    return texts(docs).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, base: int = BASE, rare: int = RARE) -> tuple[Words, np.ndarray]:
    """The words and how often each id occurs. ``counts``: a written table of word, n."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(65536, np.int64)
        for batch in batches:
            raw = np.frombuffer(b"\0" + b"\0".join(batch["word"].to_pylist()) + b"\0", np.uint8).astype(np.int64)
            seen += np.bincount(raw[:-1] * 256 + raw[1:], minlength=65536)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"pair": there, "n": seen[there]})

    bigrams = np.zeros(65536, np.int64)
    for pair, n in counts.select("word").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        bigrams[pair] = n
    short, room, least = counts.where(F.length("word") <= LONGEST), base**3 - 1 - rare, None
    for n, words_ in sorted(short.groupBy("n").count().collect(), reverse=True):  # different frequencies: a root of the words' number
        room -= words_
        if room < 0:
            break
        least = n
    known = short.where(F.col("n") >= least).collect() if least else []  # an id each, LONGEST bytes
    known.sort(key=lambda r: (-r["n"], r["word"]))
    words = Words([bytes(r["word"]) for r in known], bigrams.reshape(256, 256), base, rare)
    total = np.zeros(words.size)
    total[: len(known)] = [r["n"] for r in known]
    every = counts.agg(F.sum("n")).first()[0] or 0
    total[words.first_rare : words.end] = (every - total.sum()) / rare
    return words, total


class Network:
    """embed: ids x HIDDEN; scale: places x HIDDEN; shift: HIDDEN; out k: rows of one choice among ``base``, with biases."""

    def __init__(self, total: np.ndarray, base: int = BASE, seed: int = SEED):
        rng, self.base = np.random.default_rng(seed), base
        mass = total + 0.5
        levels = [np.log(mass.reshape(base**k, base, -1).sum(axis=2)) for k in range(3)]
        w = {"embed": rng.normal(0, 0.3, (base**3, HIDDEN)), "scale": np.tile([[1.0]], (2 * SIDE, HIDDEN)) * np.repeat(1 / np.abs(OFFSETS), HIDDEN).reshape(-1, HIDDEN), "shift": np.zeros((1, HIDDEN))}
        for k, level in enumerate(levels):
            w[f"out{k}"] = rng.normal(0, 0.05, (base**k, HIDDEN * base))
            w[f"bias{k}"] = level - level.max(axis=1, keepdims=True)
        self.w = {k: v.astype(np.float32) for k, v in w.items()}

    def hidden(self, flat: np.ndarray) -> np.ndarray:
        """For each place of ``flat`` but the first and last ``SIDE``."""
        # A logit is at most the sum of its absolute weights: only where that is large can exp() overflow.
        self.steep = any(np.abs(self.w[f"out{k}"].reshape(-1, HIDDEN, self.base)).sum(axis=1).max() + np.abs(self.w[f"bias{k}"]).max() > 60 for k in range(3))
        out = np.empty((len(flat) - 2 * SIDE, HIDDEN), np.float32)
        embed, scale = self.w["embed"], self.w["scale"]
        room, more = (np.empty((CACHED + 2 * SIDE, HIDDEN), embed.dtype) for _ in range(2))  # memory that stays: what is allocated anew costs more than the sums
        for s in range(0, len(out), CACHED):
            z = out[s : s + CACHED]
            n = len(z)
            there = embed.take(flat[s : s + n + 2 * SIDE], axis=0, out=room[: n + 2 * SIDE], mode="clip")  # once for all places beside it
            z[:] = self.w["shift"]
            for k, o in enumerate(OFFSETS.tolist()):
                z += np.multiply(there[SIDE + o : SIDE + o + n], scale[k], out=more[:n])
            np.tanh(z, out=z)
        return out

    def _levels(self, h: np.ndarray, target: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
        """For sorted ``target``, ``CACHED`` at once, and each level: where they begin, level, runs' rows, runs (row, start, end)
        that share one, logits (overwritten by the next), choices."""
        bits, room, more = self.base.bit_length() - 1, np.empty((CACHED, self.base), np.float32), np.empty((CACHED, self.base), self.w["bias0"].dtype)
        for at in range(0, len(h), CACHED):
            own, some = h[at : at + CACHED], target[at : at + CACHED]
            for k in range(3):
                row, choice = some >> bits * (3 - k), some >> bits * (2 - k) & self.base - 1
                cuts = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1, len(row)].tolist()
                rows, logits, weights = row[cuts[:-1]], room[: len(own)], self.w[f"out{k}"]
                runs = list(zip(rows.tolist(), cuts[:-1], cuts[1:], strict=True))
                for r, s, e in runs:
                    np.matmul(own[s:e], weights[r].reshape(HIDDEN, self.base), out=logits[s:e])
                logits += self.w[f"bias{k}"].take(row, axis=0, out=more[: len(own)], mode="clip")
                if self.steep:
                    logits -= logits.max(axis=1, keepdims=True)
                yield at, k, rows, runs, logits, choice

    def log_p(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The log-probability of each token given the tokens around it."""
        return self.log_p_in(*laid(around, target))

    def log_p_in(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The same of the tokens at the ascending places ``at`` of ``flat``."""
        flat, at = _part(flat, at)
        order, target = _by_id(flat[at])
        h = self.hidden(flat).take(at[order] - SIDE, axis=0)
        found, each, ones = np.zeros(len(target), np.float32), np.arange(CACHED), np.ones(self.base, np.float32)
        for at, _, _, _, logits, choice in self._levels(h, target):
            n = len(logits)
            found[at : at + n] += logits[each[:n], choice]
            found[at : at + n] -= np.log(np.exp(logits, out=logits) @ ones)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradient(self, around: np.ndarray, target: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Of minus the summed log-probability: for each weight the rows touched and their gradients."""
        return self.gradient_in(*laid(around, target))

    def gradient_in(self, flat: np.ndarray, at: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """The same of the tokens at the ascending places ``at`` of ``flat``."""
        flat, at = _part(flat, at)
        order, target = _by_id(flat[at])
        places = at[order] - SIDE
        h, each, ones = self.hidden(flat).take(places, axis=0), np.arange(CACHED), np.ones(self.base, np.float32)
        back, room, one = np.zeros_like(h), np.empty((CACHED, HIDDEN), np.float32), np.empty((HIDDEN, self.base), np.float32)
        own = {k: np.zeros(self.w[k].shape, np.float32) for k in self.w if k[:3] in ("out", "bia")}
        for s0, k, rows, runs, p, choice in self._levels(h, target):
            n, weights, to_out = len(p), self.w[f"out{k}"], own[f"out{k}"].reshape(-1, HIDDEN, self.base)
            np.exp(p, out=p)
            p /= (p @ ones)[:, None]
            p[each[:n], choice] -= 1
            for r, s, e in runs:
                to_out[r] += np.matmul(h[s0 + s : s0 + e].T, p[s:e], out=one)
                np.matmul(p[s:e], weights[r].reshape(HIDDEN, self.base).T, out=room[s:e])
            back[s0 : s0 + n] += room[:n]
            own[f"bias{k}"][rows] += np.add.reduceat(p, [s for _, s, _ in runs], axis=0)
        bits, grad = self.base.bit_length() - 1, {}
        for k in range(3):
            rows = np.unique(target >> bits * (3 - k))
            grad[f"out{k}"], grad[f"bias{k}"] = (rows, own[f"out{k}"][rows]), (rows, own[f"bias{k}"][rows])
        h *= h
        np.subtract(1, h, out=h)
        back *= h
        grad["shift"] = (np.zeros(1, np.int64), back.sum(axis=0, keepdims=True))
        # What comes back to a place of the text is added up over the positions beside it, and summed by id once.
        embed, scale = self.w["embed"], self.w["scale"]
        to_scale, to_place, beside = np.zeros((2 * SIDE, HIDDEN)), np.zeros((len(flat), HIDDEN), np.float32), np.zeros(len(flat), bool)
        spread, masked = np.zeros((len(flat) - 2 * SIDE, HIDDEN), np.float32), np.zeros(len(flat) - 2 * SIDE, bool)
        spread[places], masked[places] = back, True
        room, more = (np.empty((CACHED + 2 * SIDE, HIDDEN), embed.dtype) for _ in range(2))
        for s in range(0, len(spread), CACHED):
            part = spread[s : s + CACHED]
            n = len(part)
            there = embed.take(flat[s : s + n + 2 * SIDE], axis=0, out=room[: n + 2 * SIDE], mode="clip")
            for k, o in enumerate(OFFSETS.tolist()):
                to_scale[k] += np.einsum("ij,ij->j", part, there[SIDE + o : SIDE + o + n])
                to_place[s + SIDE + o : s + SIDE + o + n] += np.multiply(part, scale[k], out=more[:n])
        for o in OFFSETS.tolist():
            beside[SIDE + o : SIDE + o + len(masked)] |= masked
        there = np.flatnonzero(np.bincount(flat[beside], minlength=len(embed)))
        by_unit = np.ascontiguousarray(to_place.T, np.float64)
        to_embed = np.array([np.bincount(flat, unit, len(embed)) for unit in by_unit])
        grad["scale"] = (np.arange(2 * SIDE), to_scale.astype(np.float32))
        grad["embed"] = (there, to_embed.T[there].astype(np.float32))
        return grad


def laid(around: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in which the ``around`` of each ``target`` are beside it, and the places of the targets."""
    flat = np.concatenate([around[:, :SIDE], target[:, None], around[:, SIDE:]], axis=1)
    return flat.ravel(), np.arange(len(target)) * flat.shape[1] + SIDE


def _part(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As much of ``flat`` as the places ``at`` reach, and their places there."""
    return (flat[at[0] - SIDE : at[-1] + SIDE + 1], at - at[0] + SIDE) if len(at) else (np.zeros(2 * SIDE, np.int64), at)


def _by_id(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(target.astype(np.uint16), kind="stable")  # ids have 16 bits, by which numpy sorts fastest
    return order, target[order]


class Learner:
    """Adagrad on a copy of a network; remembers which rows it touched."""

    def __init__(self, network: Network, rate: float = RATE):
        self.network, self.start, self.rate, self.trained = network, {k: v.copy() for k, v in network.w.items()}, rate, 0
        self.seen = {k: np.zeros((len(v), 1), np.float32) for k, v in network.w.items()}  # mean square of a row's gradients so far

    def learn(self, around: np.ndarray, target: np.ndarray) -> None:
        self.learn_in(*laid(around, target))

    def learn_in(self, flat: np.ndarray, at: np.ndarray) -> None:
        for name, (rows, g) in self.network.gradient_in(flat, at).items():
            self.seen[name][rows] += (g * g).mean(axis=1, keepdims=True)
            self.network.w[name][rows] -= self.rate * g / np.sqrt(self.seen[name][rows] + 1e-6)
        self.trained += len(at)

    def changes(self) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """(weight, first row, touched, change) in blocks of about ``BLOCK`` weights."""
        for name, w in self.network.w.items():
            rows = max(1, BLOCK // w.shape[1])
            for at in range(0, len(w), rows):
                touched = (self.seen[name][at : at + rows, 0] > 0).astype(np.float32)
                if touched.any():
                    yield name, at, touched, w[at : at + rows] - self.start[name][at : at + rows]


def padded(documents: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids with ``SIDE`` ids ``end`` before, between and after the documents, and the places of the tokens."""
    sizes = np.array([len(d) for d in documents], np.int64)
    flat = np.full(int(sizes.sum()) + SIDE * (len(documents) + 1), end, np.int64)
    at = np.arange(int(sizes.sum())) + SIDE * (np.repeat(np.arange(len(documents)), sizes) + 1)
    flat[at] = np.concatenate(documents) if documents else np.zeros(0, np.int64)
    return flat, at


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def contexts(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a document's cells, and the hash of the context at each."""
    _, at, key, _ = _contexts([ids], end)
    return at, key


def _contexts(documents: list[np.ndarray], end: int) -> tuple[np.ndarray, ...]:
    """Of the cells of all documents: document, place, hash of the context, token."""
    sizes = np.array([len(d) for d in documents], np.int64)
    n, text = int(sizes.sum()), np.repeat(np.arange(len(documents)), sizes)
    token = np.concatenate(documents) if documents else np.zeros(0, np.int64)
    at = np.arange(n) + NEAR * (text + 1)  # NEAR places between documents, so no two of them are neighbours
    flat = np.full(n + NEAR * (len(documents) + 1), end, np.uint64)
    flat[at] = token
    flat += np.uint64(1)
    key = np.zeros(len(flat) - 4, np.uint64)
    for k in (0, 1, 3, 4):
        key = _mixed(key + flat[k : k + len(key)])
    key = key[at - 2]
    least, width = np.full(len(flat), np.uint64(2**64 - 1)), 1
    least[at] = key
    while width < 2 * NEAR + 1:  # minima of twice as many neighbours, as far as there are so many
        step = min(width, 2 * NEAR + 1 - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    cell = np.flatnonzero(key == least[at - NEAR])
    return text[cell], (np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes))[cell], key[cell], token[cell]


def _documents(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u2").astype(np.int64) for x in batch["ids"]]


def _cells(documents: list[np.ndarray], end: int) -> pa.ListArray:
    """For each document its cells: place, context, token."""
    found, first, held = [], 0, 0
    for k, d in enumerate(documents):
        held += len(d)
        if held >= SCANNED or k == len(documents) - 1:
            of, *rest = _contexts(documents[first : k + 1], end)
            found.append((of + first, *rest))
            first, held = k + 1, 0
    of, at, key, token = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4))
    each = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(token.astype(np.int32))], ["place", "context", "token"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(documents)))].astype(np.int32)), each)


def coded(docs: DataFrame, words: Words) -> DataFrame:
    """uid, doc_id, ids (16 bits each), spelled and cells of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for k in range(0, batch.num_rows, 500) for f in words.code(batch["text"].slice(k, 500))]
            yield pa.RecordBatch.from_pydict({
                "uid": batch["uid"], "doc_id": batch["doc_id"], "ids": pa.array([f[0].astype("<u2").tobytes() for f in found], pa.binary()),
                "spelled": pa.array([f[1] for f in found], pa.float64()), "cells": _cells([f[0] for f in found], words.end),
            })

    kind = "uid long, doc_id long, ids binary, spelled double, cells array<struct<place: int, context: long, token: int>>"
    return texts(docs, F.monotonically_increasing_id().alias("uid")).mapInArrow(each, kind)


def train_round(ids: DataFrame, network: Network, end: int) -> Network:
    """The network after one round over all positions of all documents of a written table (uid, ids)."""
    start = ids.sparkSession.sparkContext.broadcast((network.w, network.base))  # fixed by BASE and HIDDEN: 5 MB

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        w, own.base = start.value
        own.w = {k: v.copy() for k, v in w.items()}
        learner = Learner(own)
        task = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                task = task or part["uid"][0].as_py() + 1
                flat, at = padded(_documents(part), end)
                for s in range(0, len(at), STEP):
                    learner.learn_in(flat, at[s : s + STEP])
        for name, row, touched, change in learner.changes():
            yield pa.RecordBatch.from_pydict({"name": [name], "row": pa.array([row], pa.int32()), "salt": pa.array([zlib.crc32(b"%d" % task) % SALTS], pa.int32()), "touched": [touched.tobytes()], "change": [change.astype(np.float16).tobytes()]})

    def add(kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, touched, change, salt = None, None, None, 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({"name": [at[0]], "row": pa.array([at[1]], pa.int32()), "salt": pa.array([salt], pa.int32()), "touched": [touched.tobytes()], "change": [change.tobytes()]})

            for batch in batches:
                for r in batch.to_pylist():
                    t, c = np.frombuffer(r["touched"], np.float32), np.frombuffer(r["change"], kind).astype(np.float32)
                    if at != (r["name"], r["row"], r["salt"]):
                        if at:
                            yield out()
                        at, touched, change, salt = (r["name"], r["row"], r["salt"]), np.zeros(len(t), np.float32), np.zeros(len(c), np.float32), r["salt"]
                    touched += t
                    change += c
            if at:
                yield out()

        return stream

    kinds = "name string, row int, salt int, touched binary, change binary"
    first = ids.select("uid", "ids").mapInArrow(learn, kinds).repartition("name", "row", "salt").sortWithinPartitions("name", "row", "salt").mapInArrow(add(np.float16), kinds)
    total = first.withColumn("salt", F.lit(0)).repartition("name", "row").sortWithinPartitions("name", "row").mapInArrow(add(np.float32), kinds)
    new = Network.__new__(Network)
    new.base, new.w = network.base, {k: v.copy() for k, v in network.w.items()}
    for r in total.collect():  # as much as the weights: 5 MB
        touched = np.frombuffer(r["touched"], np.float32)
        change = np.frombuffer(r["change"], np.float32).reshape(len(touched), -1)
        new.w[r["name"]][r["row"] : r["row"] + len(touched)] += change / np.maximum(touched, 1)[:, None]
    start.destroy()
    return new


def memory(ids: DataFrame) -> DataFrame:
    """uid, known (place, c, m): how often the context at a place occurs elsewhere, and with the same token."""
    cells = ids.select("uid", F.explode("cells").alias("x")).select("uid", "x.place", "x.context", "x.token")
    both = cells.groupBy("context", "token").agg(F.count(F.lit(1)).alias("c"))
    every = both.groupBy("context").agg(F.sum("c").alias("m")).where("m > 1").withColumnRenamed("context", "_context")
    known = written(both.join(every, F.col("context") == F.col("_context")).where("c > 1 or m > c").select(F.expr("xxhash64(context, token)").alias("cell"), "c", "m"), "known_cells")
    many = cells.select("uid", "place", F.expr("xxhash64(context, token)").alias("cell"))
    hits = spread_join(many, known, "cell", "uid, place", counts=known.select("cell", F.col("c").alias("n")))
    out = hits.groupBy("uid").agg(F.collect_list(F.struct("place", (F.col("c") - 1).alias("c"), (F.col("m") - 1).alias("m"))).alias("known"))  # one at most for a token of the text
    return written(out, "remembered", known)


def score(ids: DataFrame, network: Network, end: int, remembered: DataFrame) -> DataFrame:
    """doc_id, n_tokens, pll (natural logarithm), mean_pll, remembered (what the memory adds for each token)."""
    start = ids.sparkSession.sparkContext.broadcast((network.w, network.base))  # fixed by BASE and HIDDEN: 5 MB

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.w, own.base = start.value
        for batch in batches:
            own_ids = _documents(batch)
            sizes = np.array([len(d) for d in own_ids], np.int64)
            starts = np.r_[0, np.cumsum(sizes)]
            flat, at = padded(own_ids, end)
            log_p = np.concatenate([own.log_p_in(flat, at[s : s + POSITIONS]) for s in range(0, len(at), POSITIONS)] or [np.zeros(0, np.float32)]).astype(np.float64)
            cells = batch["known"]
            lengths = np.array([len(c) if c.is_valid else 0 for c in cells], np.int64)
            place, c, m = (x.to_numpy(zero_copy_only=False) for x in cells.flatten().flatten())
            where = np.repeat(starts[:-1], lengths) + place
            better = log_p.copy()
            better[where] = np.log((np.exp(log_p[where]) + c) / (1 + m))
            sums = [float(better[s:e].sum()) for s, e in zip(starts[:-1], starts[1:], strict=True)]
            plain = [float(log_p[s:e].sum()) for s, e in zip(starts[:-1], starts[1:], strict=True)]
            pll = [s + x for s, x in zip(sums, batch["spelled"].to_pylist(), strict=True)]
            n = sizes.tolist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "n_tokens": pa.array(n, pa.int64()), "pll": pa.array(pll, pa.float64()),
                "mean_pll": pa.array([p / k if k else None for p, k in zip(pll, n, strict=True)], pa.float64()),
                "remembered": pa.array([(s - p) / k if k else 0.0 for s, p, k in zip(sums, plain, n, strict=True)], pa.float64()),
            })

    rows = ids.join(remembered.withColumnRenamed("uid", "_uid"), F.col("uid") == F.col("_uid"), "left").select("doc_id", "ids", "spelled", "known")
    return rows.mapInArrow(each, "doc_id long, n_tokens long, pll double, mean_pll double, remembered double")


def train(docs: DataFrame, base: int = BASE, rare: int = RARE, rounds: int = ROUNDS) -> tuple[Words, Network, DataFrame]:
    """The words, the network, and the written table of all documents as ids."""
    counts = written(word_counts(docs), "word_counts")
    words, total = vocabulary(counts, base, rare)
    ids = written(coded(docs, words), "coded", counts)
    network = Network(total, base)
    for _ in range(rounds):
        network = train_round(ids, network, words.end)
    return words, network, ids


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    words, network, ids = train(docs)
    return score(ids, network, words.end, memory(ids))
