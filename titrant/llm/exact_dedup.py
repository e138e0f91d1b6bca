"""Exact dedup against a history held in minimal perfect hashes.

Texts are equal when they agree after every character of ``[\\x20\\x09-\\x0D]`` is deleted; their SHA-256 stands for them.
History: the distinct digests of one share of the rows, dealt into buckets by digest. Each bucket gets a minimal perfect
hash (levels of bit arrays; a key that is alone at its place of a level is settled there, the others go to the next
level; the rank of the place is the slot). A slot holds the whole 32-byte digest and the locator of the winner: its doc_id
and its place (file and row).
Arrivals, pre-aggregated to one row per digest, are looked up in their bucket's hash; the slot's digest is compared byte
by byte. Members join the slot's group, nonmembers form groups of their own.

Every shuffle carries digests and places, never texts, and is pre-aggregated, so a group of copies of any size meets a task
as one row per upstream task. Digests are uniform, so buckets have near equal size whatever the skew of the texts.

Cases: null text counts as empty and all empty texts are one group; of equal texts the one with most code points in the
original text, then the smallest doc_id, stays, a null doc_id being the smallest; rows that repeat both doc_id and text
are all marked kept, and ``drop_copies`` leaves the first by place of them (different texts that share a doc_id, or have
none, all stay); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, place, spread_join, stored, texts, written

BUCKET_KEYS = 1024  # digests to a bucket, on average
GAMMA = 1.7  # places of a level to a key
NO_ID = -(1 << 63)  # stands for a null doc_id
WINNER = ("n", "keep_id", "size", "file", "row")
HISTORY = "pmod(xxhash64(doc_id), 2) = 0"


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _digest() -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", ""), 256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes) of the text without white space, n (code points of the original text), file, row."""
    return texts(docs, *place(docs)).select(_id().alias("doc_id"), _digest().alias("digest"), F.char_length("text").cast("long").alias("n"), "file", "row")


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each row of two 64-bit words, another one for each level."""
    with np.errstate(over="ignore"):
        x = words[:, 0] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) * (words[:, 1] | np.uint64(1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def build_mph(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels (bit arrays) of a minimal perfect hash over distinct rows of ``words``, and each row's slot."""
    left, levels, slot, settled = np.arange(len(words)), [], np.zeros(len(words), np.int64), 0
    while len(left):
        size = max(2, int(GAMMA * len(left)))
        place = (_mix(words[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        ok = alone[place]
        slot[left[ok]] = settled + np.cumsum(alone)[place[ok]] - 1
        settled += int(alone.sum())
        levels.append(alone)
        left = left[~ok]
    return levels, slot


def look_up(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot each row would have if it were a member; -1 where no level has it."""
    slot, left, before = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for k, alone in enumerate(levels):
        place = (_mix(words[left], k) % np.uint64(len(alone))).astype(np.int64)
        ok = alone[place]
        slot[left[ok]] = before + np.cumsum(alone)[place[ok]] - 1
        before += int(alone.sum())
        left = left[~ok]
    return slot


def _digests(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, 8:24]).view("<u8").reshape(-1, 2)


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket of the history as one row: levels of its hash, slots with whole digests, and locators by slot."""
    digests = _digests(pdf["digest"])
    levels, slot = build_mph(_words(digests))
    by_slot = np.argsort(slot)
    return pd.DataFrame({
        "bucket": [int(pdf["bucket"].iloc[0])],
        "sizes": [np.array([len(x) for x in levels], np.int64)],
        "bits": [np.packbits(np.concatenate(levels)).tobytes()],
        "slots": [digests[by_slot].tobytes()],
        **{c: [pdf[c].to_numpy(np.int64)[by_slot]] for c in WINNER},
    })


def _merge(arrivals: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """All groups of a bucket: each slot of the history with the arrivals that hit it, then the nonmembers."""
    if not len(index):
        return arrivals[["digest", *WINNER]].assign(member=False)
    row = index.iloc[0]
    slots = np.frombuffer(row["slots"], np.uint8).reshape(-1, 32)
    held = {c: np.array(row[c], np.int64) for c in WINNER}
    digests = _digests(arrivals["digest"])
    sizes = np.array(row["sizes"], np.int64)
    levels = np.split(np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool), np.cumsum(sizes)[:-1])
    slot = look_up(levels, _words(digests)) if len(digests) else np.zeros(0, np.int64)
    member = slot >= 0
    member[member] = (slots[slot[member]] == digests[member]).all(axis=1)
    to, new = slot[member], {c: arrivals[c].to_numpy(np.int64)[member] for c in WINNER}  # one arrival to a slot at most
    better, tied = np.zeros(len(to), bool), np.ones(len(to), bool)
    for a, b in ((-new["n"], -held["n"][to]), *((new[c], held[c][to]) for c in ("keep_id", "file", "row"))):
        better |= tied & (a < b)
        tied &= a == b
    for c in ("n", "keep_id", "file", "row"):
        held[c][to] = np.where(better, new[c], held[c][to])
    held["size"][to] += new["size"]
    known = pd.DataFrame({"digest": [x.tobytes() for x in slots], **held, "member": True})
    return pd.concat([known, arrivals.loc[~member, ["digest", *WINNER]].assign(member=False)])


def _groups(docs: DataFrame, history: str) -> tuple[DataFrame, DataFrame]:
    """The written prints of all rows of a ``stored`` table, and one row per digest: digest, the columns of ``WINNER``, member."""
    prints = written(fingerprints(docs).withColumn("old", F.expr(history)), "exact_prints")
    best = F.min(F.struct((-F.col("n")).alias("less"), "doc_id", "file", "row")).alias("best")
    groups = prints.groupBy("digest", "old").agg(best, F.count(F.lit(1)).alias("size"))
    groups = groups.select("digest", "old", (-F.col("best.less")).alias("n"), F.col("best.doc_id").alias("keep_id"), "size", "best.file", "best.row")
    groups = written(groups, "exact_groups")
    rows = {r["old"]: r["count"] for r in groups.groupBy("old").count().collect()}  # two rows
    buckets = max(1, -(-max(rows.values(), default=0) // BUCKET_KEYS))  # by the larger side: neither meets in few groups
    groups = groups.withColumn("bucket", F.expr(f"pmod(conv(hex(substring(digest, 1, 7)), 16, 10) :: long, {buckets})"))
    arrays, longs = (", ".join(f"{c} {kind}" for c in WINNER) for kind in ("array<long>", "long"))
    index = groups.where("old").groupBy("bucket").applyInPandas(_index, f"bucket long, sizes array<long>, bits binary, slots binary, {arrays}")
    arrivals = groups.where("not old")
    return prints, arrivals.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_merge, f"digest binary, {longs}, member boolean")


def group_copies(docs: DataFrame, history: str = HISTORY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. ``history``: which rows count as historical;
    the result is the same for any choice."""
    prints, merged = _groups(stored(docs), history)
    merged = written(merged.select("digest", "keep_id", "size"), "exact_merged")
    out = spread_join(prints, merged, "digest", "doc_id, file, row", counts=merged.select("digest", F.col("size").alias("n")))
    shown = [F.expr(f"nullif({c}, {NO_ID + 1}L - 1L)").alias(c) for c in ("doc_id", "keep_id")]
    return out.select(*shown, F.col("size").alias("group_size"), (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, history: str = HISTORY) -> DataFrame:
    """One document of each group of equal texts, the best one, with all its columns, chosen by its place: neither a null
    doc_id nor one that different texts share loses a text. Texts are read twice and never shuffled."""
    docs = stored(docs)
    return keep_rows(docs, _groups(docs, history)[1].select("file", "row"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
