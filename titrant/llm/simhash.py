"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprint: texts lower-cased in A-Z only, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with repeats joined by a
space (the whole sequence if there are fewer words), XXH64 with seed 42 of each; a bit is set when more than half of the
hashes have it. Fingerprints link at two or fewer differing bits; a component is everything reachable over links.

Index: a fingerprint is eight positional bytes. Two differing bits touch two bytes at most, so linked fingerprints share
at least six positional bytes: the guaranteed minimum that the count filter asks for. One list for each position and byte
would hold n/256 fingerprints, so the index is cut into shards: of the four pairs of neighbouring positions two at least
are whole in both of any linked two, so each of the six choices of two pairs, with their four bytes, is a shard, and
linked fingerprints meet in one. Inside a shard the other four positions have their lists of single bytes; the positional
bytes that a pair shares are tallied over these lists, pairs that reach the minimum are verified (bits that differ).

Heavy lists are split, at two levels, always by more positional bytes, which no qualifying pair loses: a list of more
than ``HEAVY`` members is replaced by the lists of its members that share a second free position; and a shard of more than
``MEMBERS`` fingerprints (found by counting them before anything is gathered) by the shards of six positions inside it.
Fingerprints are distinct, so those that share six positions differ in two bytes and are 65,536 at most; they have the
minimum already and are verified against the 136 masks of one or two bits. So no group of near copies, however large,
is held by a task as a whole. A shard hands on one link to the smallest member of each of its local components, so links
stay linear in the rows.

Cases: null and blank texts have fingerprint zero and link like any other; equal texts are one fingerprint, handled once;
a component of null doc_ids only has a null component_id; rows that share a doc_id each have a row; ``keep_one`` keeps, by
its place, the row with the smallest doc_id that isn't null, of equal ones the first; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep_rows, place, spread_join, stored, texts, written
from .components import star_labels

WORDS, SEED, MOST_BITS = 3, 42, 2
SHARED = 6  # positional bytes that two linked fingerprints share at least
HEAVY = 512  # members from which a list is split by a second position
MEMBERS = 1 << 16  # fingerprints from which a shard is split by two more positions
PAIRS = 1 << 20  # pairs tallied at once

BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
BYTE = np.arange(8, dtype=np.int64) * 256
SHARDS = [tuple(2 * h + k for h in halves for k in (0, 1)) for halves in combinations(range(4), 2)]  # positions that a shard fixes
MASKS = np.array([1 << i for i in range(64)], np.uint64)


def fingerprint(text: str) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(stops[: n - 1] + 1).tolist()]
    shingles = map(line.__getitem__, map(slice, starts, stops[WORDS - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    tally = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + BYTE).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits(tally @ BITS * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, bits: the fingerprint of each row of a ``stored`` table as a signed 64-bit number; and its file and row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "bits": bits.view(np.int64), "file": batch["file"], "row": batch["row"]})

    return texts(docs, *place(docs)).mapInArrow(each, "doc_id long, bits long, file long, row long")


def _lists(members: np.ndarray, position: int) -> list[np.ndarray]:
    """The inverted index of one position: for each byte that two members or more have there, those members."""
    byte = members.view(np.uint8).reshape(-1, 8)[:, position]
    order = np.argsort(byte, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1) if len(x) > 1]


def _tally(members: np.ndarray, free: list[int], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of ``members`` that share ``least`` of the ``free`` positions or more, by counting over the lists. A pair
    may come more than once. Pairs of a heavy list come from the lists that a second position cuts it into."""
    lists, heavy = [], []
    for p in free:
        for own in _lists(members, p):
            (heavy if len(own) > HEAVY else lists).append((p, own))
    for p, own in heavy:
        rest = [q for q in free if q != p]
        if least <= 1:
            yield _within_bits(members, own)
        else:
            for q in rest:
                for both in _lists(members[own], q):
                    if least == 2:
                        yield _within_bits(members, own[both])
                    else:
                        for i, j in _tally(members[own[both]], [r for r in rest if r != q], least - 2):
                            yield own[both][i], own[both][j]
    # Members are taken in runs so that a run's pairs (with any later member of its lists) fit in memory.
    follow = np.zeros(len(members), np.int64)
    for _, own in lists:
        follow[own] += np.arange(len(own))[::-1]
    run = np.cumsum(follow) // PAIRS
    for r in np.unique(run):
        first, last = np.searchsorted(run, [r, r + 1])
        keys = []
        for _, own in lists:
            a = own[(own >= first) & (own < last)]
            at = np.searchsorted(own, a)
            n = len(own) - 1 - at
            if n.sum():
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                keys.append(np.repeat(a, n) * len(members) + own[np.repeat(at, n) + 1 + step])
        if keys:
            pair, shared = np.unique(np.concatenate(keys), return_counts=True)
            i, j = np.divmod(pair[shared >= least], len(members))
            near = np.bitwise_count(members[i] ^ members[j]) <= MOST_BITS
            yield i[near], j[near]


def _within_bits(members: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``own`` (places in the sorted ``members``) that differ in ``MOST_BITS`` bits or fewer, by trying the masks of
    the bits that differ at all."""
    bits = members[own]
    free = int(np.bitwise_or.reduce(bits ^ bits[0]))
    ones = [m for m in MASKS if free & int(m)]
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for mask in [*ones, *(a | b for a, b in combinations(ones, 2))]:
        other = bits ^ mask
        at = np.minimum(np.searchsorted(bits, other), len(bits) - 1)
        hit = np.flatnonzero(bits[at] == other)
        i.append(own[hit]), j.append(own[at[hit]])
    return np.concatenate(i), np.concatenate(j)


def _local_links(bits: np.ndarray, fixed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Members of one shard (distinct) hung on the smallest member of their local component."""
    bits = np.sort(bits)
    free = [p for p in range(8) if p not in fixed]
    least = SHARED - len(fixed)
    pairs = list(_tally(bits, free, least)) if least > 0 else [_within_bits(bits, np.arange(len(bits)))]
    i, j = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
    i, j = np.r_[i, j], np.r_[j, i]
    label = np.arange(len(bits))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(bits)))
    return bits[rest], bits[label[rest]]


def _postings(bits: DataFrame, shards: list[tuple[int, ...]]) -> DataFrame:
    """bits, shard (its fixed positions as a mask of eight bits), key (the bytes there)."""
    masks = [sum(0xFF << 8 * p for p in fixed) for fixed in shards]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    numbers = [sum(1 << p for p in fixed) for fixed in shards]
    each = F.array(*(F.struct(F.lit(n).cast("long").alias("shard"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for n, m in zip(numbers, signed, strict=True)))
    return bits.select("bits", F.explode(each).alias("p")).select("bits", "p.shard", "p.key")


def near_links(distinct: DataFrame, members: int = MEMBERS) -> DataFrame:
    """Links a, b between the distinct fingerprints in column ``bits``; their components are those of all links."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64),) * 3

        def done(shard: np.ndarray, key: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (key[1:] != key[:-1]), True]) if len(bits) else np.zeros(1, np.int64)
            fixed = [tuple(p for p in range(8) if int(x) >> p & 1) for x in shard[cuts[:-1]]]
            found = [_local_links(bits[s:e].view(np.uint64), f) for s, e, f in zip(cuts[:-1], cuts[1:], fixed, strict=True) if e - s > 1]
            a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_pydict({"a": a, "b": b})

        for batch in batches:
            rows = tuple(np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("shard", "key", "bits"), strict=True))
            if not len(rows[0]):
                continue
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = tuple(r[cut:] for r in rows)
            yield done(*(r[:cut] for r in rows))
        yield done(*held)

    postings = _postings(distinct, SHARDS)
    heavy = postings.groupBy("shard", "key").count().where(F.col("count") > members).select(F.col("shard").alias("_s"), F.col("key").alias("_k"))
    heavy = written(heavy, "heavy_shards")
    of_heavy = F.expr("shard = _s and key = _k")
    small = postings.join(heavy, of_heavy, "left_anti")
    split = []
    for fixed in SHARDS:  # the shards of six positions inside each heavy one
        inside = [fixed + more for more in combinations([p for p in range(8) if p not in fixed], 2)]
        number = sum(1 << p for p in fixed)
        own = postings.where(F.col("shard") == number).join(heavy, of_heavy, "left_semi").select("bits")
        split.append(_postings(own, inside))
    every = reduce(DataFrame.unionByName, split, small).distinct() if not heavy.isEmpty() else small
    return every.repartition("shard", "key").sortWithinPartitions("shard", "key").mapInArrow(links, "a long, b long")


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written fingerprints of a ``stored`` table, and for each distinct one: bits, root (one for a component) and best:
    the row with the smallest doc_id (none is the largest), of equal ones the first by place."""
    prints = written(fingerprints(docs), "simhash")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")).alias("best")
    first = written(prints.groupBy("bits").agg(best, F.count(F.lit(1)).alias("n")), "simhash_distinct")
    labels = star_labels(near_links(first.select("bits")))
    rooted = first.join(labels.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "best", "n", F.coalesce("root", "bits").alias("root"))
    return prints, written(rooted, "simhash_rooted", first)


def near_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable)."""
    prints, rooted = _rooted(stored(docs))
    least = written(rooted.groupBy("root").agg(F.min("best.doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash_components")
    groups = spread_join(rooted, least.drop("n"), "root", "bits", counts=least.select("root", "n")).select("bits", "n", "component_id")
    groups = written(groups, "simhash_groups", rooted, least)
    out = spread_join(prints, groups.drop("n"), "bits", "doc_id, file, row", counts=groups.select("bits", "n"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component with all its columns, chosen by its place. Texts are read twice, never shuffled."""
    docs = stored(docs)
    prints, rooted = _rooted(docs)
    forget(prints)
    return keep_rows(docs, rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.file", "best.row"))
