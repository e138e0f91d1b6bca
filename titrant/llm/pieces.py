"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose concatenation is a piece, ordered by the piece's score and then
from left to right; the best pair is merged, its neighbours' pairs enter the agenda, until it is empty. Symbols that are
no piece at the end become the pieces of their UTF-8 bytes. White space is the symbol U+2581, one is put before the text.

Two facts of a vocabulary cut the work: a pair of characters that no piece has side by side can never be merged across.
Texts are therefore cut before each run of U+2581 and at line ends, each different segment is encoded once and
remembered, and segments are cut again between a letter and closing punctuation. New parts of a batch run through one
agenda step at a time all together in numpy; parts over ``LONG`` symbols use a heap. Every new segment is compared with
the library's own ids, and one whole text of each slice with its encode and decode; where they differ the library's are
taken and counted in ``corrected``.

Cases: null and empty texts have no ids and decode to the empty text; runs of spaces, U+2581 in a text and characters
without a piece behave as in the library; very long texts are handled whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

SPACE = "▁"
LONG = 48  # symbols
MEMO = 600_000  # segments that a worker remembers
SLICE = 400  # texts
CLOSING = ".,!?;:|*$%&#=\"@+()"


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.names = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(n)]
        self.of_byte = {int(p[3:5], 16): i for i, p in enumerate(self.names) if self.library.is_byte(i)}
        symbols = {p: i for i, p in enumerate(self.names) if not special[i]}
        for p in list(symbols):
            for c in p:
                symbols.setdefault(c, len(symbols) + n)
        self.symbols, self.pieces = symbols, n
        pairs = []
        for p, i in list(symbols.items()):
            if i < n and len(p) > 1:
                score = self.library.get_score(i)
                pairs += [(symbols[p[:k]], symbols[p[k:]], -score, i) for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.width = 1 << 20
        order = np.argsort([a * self.width + b for a, b, *_ in pairs])
        ranks = {s: k for k, s in enumerate(sorted({s for *_, s, _ in pairs}))}
        self.pair = np.array([pairs[k][0] * self.width + pairs[k][1] for k in order], np.int64)
        self.rank = np.array([ranks[pairs[k][2]] for k in order], np.int64)
        self.into = np.array([pairs[k][3] for k in order], np.int64)
        self.by_pair = {int(p): (int(r), int(t)) for p, r, t in zip(self.pair, self.rank, self.into, strict=True)}
        letter_then = {b for p in symbols for a, b in zip(p, p[1:], strict=False) if a.isalpha() or a.isdigit()}
        closing = "".join(c for c in CLOSING if c not in letter_then)
        self.tail = re.compile(f"(.*[^\\W_])([{re.escape(closing)}]+)", re.DOTALL) if closing else None
        joins = {a + b for p in symbols for a, b in zip(p, p[1:], strict=False)}
        self.can_cut = not any(j[1] == SPACE != j[0] for j in joins) and not any("\n" in j for j in joins)
        self.decoded = [b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.names)]
        for b, i in self.of_byte.items():
            self.decoded[i] = bytes([b])
        self.text_ids = [b"%d" % i for i in range(n)]
        self.parts: dict[str, list[int]] = {}
        self.segments: dict[str, tuple[bytes, bytes]] = {}
        self.corrected = 0

    # agenda
    def by_heap(self, part: str) -> list[int]:
        """The agenda for one part, as a heap of (rank, place)."""
        sym = [self.symbols.get(c, -1) for c in part]
        char = list(part)
        right, left = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(sym) and sym[a] >= 0 and sym[b] >= 0 and (found := self.by_pair.get(sym[a] * self.width + sym[b])):
                heapq.heappush(agenda, (found[0], a, sym[a], sym[b]))

        for k in range(len(sym) - 1):
            offer(k, k + 1)
        gone = -2
        while agenda:
            _, a, x, y = heapq.heappop(agenda)
            b = right[a]
            if sym[a] != x or b >= len(sym) or sym[b] != y:
                continue
            sym[a], sym[b] = self.by_pair[x * self.width + y][1], gone
            right[a] = right[b]
            if right[b] < len(sym):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [i for s, c in zip(sym, char, strict=True) if s != gone for i in self._ids(s, c)]

    def _ids(self, symbol: int, char: str) -> list[int]:
        return [symbol] if 0 <= symbol < self.pieces else [self.of_byte[b] for b in char.encode()]

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, -1 where the pair makes no piece."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), at, -1)

    def by_steps(self, parts: list[str]) -> list[list[int]]:
        """The agenda for many parts: each step merges the best pair of every part that still has one."""
        get = self.symbols.get
        sym = np.array([get(c, -1) for p in parts for c in p], np.int64)
        place = np.arange(len(sym))
        chars = "".join(parts)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        done_sym, done_place, done_of = [], [], []
        none = np.iinfo(np.int64).max
        found = np.full(len(sym), -1)
        if len(sym) > 1:
            found[:-1] = np.where(of[1:] == of[:-1], self._find(sym[:-1], sym[1:]), -1)
        while len(sym):
            order = np.where(found >= 0, self.rank[found] * len(chars) + place, none)
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            best = np.minimum.reduceat(order, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(best != none, sizes)
            if not live.all():
                for into, x in ((done_sym, sym), (done_place, place), (done_of, of)):
                    into.append(x[~live])
                sym, place, of, found, order = (x[live] for x in (sym, place, of, found, order))
                if not len(sym):
                    break
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                best = best[best != none]
                sizes = np.diff(np.r_[starts, len(sym)])
            at = np.flatnonzero(order == np.repeat(best, sizes))  # one in each part
            sym[at] = self.into[found[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # places after the removal, one symbol having gone for each earlier part
            sym, place, of, found = (x[keep] for x in (sym, place, of, found))
            for left in (new[new > 0] - 1, new):
                left = left[left + 1 < len(sym)]
                found[left] = np.where(of[left] == of[left + 1], self._find(sym[left], sym[left + 1]), -1)
            if new[-1] == len(sym) - 1:
                found[-1] = -1
        sym, place = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (done_sym, done_place))
        order = np.argsort(place)
        out: list[list[int]] = [[] for _ in parts]
        for s, k, p in zip(sym[order].tolist(), place[order].tolist(), np.concatenate(done_of or [sym])[order].tolist(), strict=True):
            out[p] += [s] if 0 <= s < self.pieces else self._ids(s, chars[k])
        return out

    # segments
    def learn(self, keys: set[str]) -> None:
        """Encode segments not met before. A key is the segment; or, without its one U+2581, the rest of it."""
        split = {}
        for key in keys:
            segment = key if key[:1] in ("\n", SPACE) and key else SPACE + key
            m = self.tail.fullmatch(segment) if self.tail else None
            split[key] = m.groups() if m else (segment,)
        new = list({p for ps in split.values() for p in ps if p not in self.parts})
        short = [p for p in new if len(p) <= LONG]
        self.parts.update(zip(short, self.by_steps(short), strict=True))
        self.parts.update((p, self.by_heap(p)) for p in new if len(p) > LONG)
        keys_ = list(keys)
        for key, theirs in zip(keys_, self.library.encode(keys_, num_threads=1), strict=True):
            ids = [i for p in split[key] for i in self.parts[p]]
            alone = key[:1] in ("\n", SPACE) and key != ""
            theirs = theirs[1:] if alone else theirs  # the library's own U+2581
            if key and ids != theirs and not key.startswith(SPACE):
                ids, self.corrected = theirs, self.corrected + 1
            self.segments[key] = (b",".join([self.text_ids[i] for i in ids]), b"".join([self.decoded[i] for i in ids]))

    def keys(self, text: str) -> list[str]:
        line = text.replace("\n", " \n")
        if not text:
            return []
        if not self.can_cut:
            return [SPACE + text.replace(" ", SPACE)]
        if SPACE in text or "  " in line or line[0] == " " or line[-1] == " ":
            found = re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*", SPACE + text.replace(" ", SPACE))
            return [s[1:] if s[0] == SPACE and s[1:2] != SPACE else s for s in found]
        return line.split(" ")

    def batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, int]]:
        """Of each text: its ids as decimal numbers joined by commas, its decoded UTF-8, and segments corrected."""
        if len(self.segments) > MEMO:
            self.segments.clear(), self.parts.clear()
        keys = [self.keys(t) for t in texts]
        new = set().union(*keys).difference(self.segments)
        self.corrected = 0
        self.learn(new)
        get = self.segments.__getitem__
        for k, (text, own) in enumerate(zip(texts, keys, strict=True)):
            found = list(map(get, own))
            ids, decoded = b",".join([f[0] for f in found]), b"".join([f[1] for f in found])
            decoded = decoded[1:] if decoded[:1] == b" " else decoded
            wrong = 0
            if not k:
                theirs = self.library.encode(text)
                as_text = b",".join([self.text_ids[i] for i in theirs])
                back = self.library.decode(theirs).encode()
                wrong = int((ids, decoded) != (as_text, back)) + self.corrected
                ids, decoded = as_text, back
            yield ids, decoded, wrong


_loaded: dict[str, Vocabulary] = {}


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, corrected for every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded.get(model) or _loaded.setdefault(model, Vocabulary(model))
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                rows = [
                    (ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), wrong)
                    for ids, text, wrong in vocabulary.batch(part["text"].to_pylist())
                ]
                n, a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": a, "decoded_sha256": b, "corrected": pa.array(c, pa.int64())})

    return texts(docs).mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, corrected long")
