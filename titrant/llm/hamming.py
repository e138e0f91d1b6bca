"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's code has bit i set where the sum of its components i, i + 64, ... is positive (up to 64 components: one bit for
each). Codes are cut into segments of about log2(n) bits. The index has a row for each distinct code and segment, dealt into
shards by segment and by the first bits of the value there, so that a shard holds ``SHARD`` codes on average; a shard that a
crowded value makes larger is dealt into pieces by a hash of the code.

In round r = 0, 1, 2, ... a query goes, in every segment, to the shards whose first bits differ from its own in j <= r
places, and meets there the codes whose other bits of the segment differ in r - j places. Each meeting is verified, and
counts only in the segment in which code and query differ least (the first of such), so a code is found once over all
rounds. After round r every code within ``segments * (r + 1) - 1`` bits has been met; a query whose kth verified distance is
at most that is done and goes nowhere any more. The kth distance so far travels with the query and bounds what a shard hands
on, k rows at most for a query. So a query's work follows the values within its radius, not the number of blocks of codes,
and the queries of a shard are dealt into runs of ``QUERIES`` with a copy of the shard for each.

Of equal codes only the k smallest ids can be results: these are picked in two steps, first in each of ``SALTS`` parts of the
rows of a code, so a vector that a third of all rows share is no task's alone.

Cases: rows with a null id or a null or empty vector have no code, are never found and find nothing; equal distances are
ordered by id; repeated rows are found once each; with fewer than k rows all are returned; a row finds itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, spread_join, written

SHARD = 4096  # codes to a shard, on average
CROWDED = 4 * SHARD  # codes of a piece of a shard
QUERIES = 4096  # queries that a task takes to a piece at once
MEETINGS = 1 << 20  # pairs verified at once
SALTS = 32
K = 10


def codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, code: 64 sign bits of each vector."""
    sums = f"transform(sequence(0, least(size({vector}), 64) - 1), i -> aggregate(sequence(i, size({vector}) - 1, 64), 0D, (s, j) -> s + {vector}[j]))"
    code = f"aggregate({sums}, struct(0L as c, 0 as i), (a, x) -> struct(a.c | case when x > 0 then shiftleft(1L, a.i) else 0L end as c, a.i + 1 as i), a -> a.c)"
    known = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0))
    return known.select(F.col(key).cast("long").alias("id"), F.expr(code).alias("code"))


def segments(n: int) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, first bits that name a shard) of each segment for ``n`` distinct codes."""
    size = math.log2(max(2, n))
    parts = min(8, max(2, round(64 / max(8, size))))
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    named = max(0, math.ceil(size - math.log2(SHARD)))
    return [(a, b - a, min(named, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _prefix(code: str, segment: tuple[int, int, int]) -> str:
    """SQL for the first bits of the segment's value."""
    low, width, named = segment
    return f"(shiftrightunsigned({code}, {low + width - named}) & {(1 << named) - 1}L)" if named else "0L"


def _bits(x: np.ndarray, low: int, width: int) -> np.ndarray:
    return x >> np.uint64(low) & np.uint64((1 << width) - 1)


def meet(query: np.ndarray, bound: np.ndarray, code: np.ndarray, parts: list[tuple[int, int, int]], s: int, radius: int, named: int = 0, away: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance), as places, of the pairs that differ in ``radius`` bits of segment ``s``, in as many or more in
    each segment after it and in more in each before it, and in ``bound`` bits at most in all. All codes have the same first
    ``named`` bits there, ``away`` bits from those of each query, and are in the order of the others. These are looked up by
    masks, or all tried where there are more masks than codes."""
    low, width = parts[s][0], parts[s][1] - named
    values = _bits(code, low, width)
    masks, found = math.comb(width, radius - away), []
    step = max(1, MEETINGS // max(1, min(masks, len(code))))
    if masks <= len(code):
        mask = np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius - away)], np.uint64)
    for k in range(0, len(query) if masks else 0, step):
        own = _bits(query[k : k + step], low, width)[:, None]
        if masks <= len(code):
            want = (own ^ mask).ravel()
            first = np.searchsorted(values, want)
            n = np.searchsorted(values, want, "right") - first
            q = np.repeat(np.arange(len(want)) // len(mask), n)
            at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        else:
            q, at = np.nonzero(np.bitwise_count(own ^ values) == radius - away)
        found.append(_verified(q + k, at, query, code, parts, s, radius, bound))
    return tuple(np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]) for c in range(3))


def _verified(q, at, query, code, parts, s, radius, bound) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    differ = query[q] ^ code[at]
    distance = np.bitwise_count(differ).astype(np.int64)
    new = distance <= bound[q]
    for j, (low, width, _) in enumerate(parts):
        if j != s:
            new &= np.bitwise_count(_bits(differ, low, width)) >= radius + (j < s)
    return q[new], at[new], distance[new]


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _index(coded: DataFrame, k: int) -> DataFrame:
    """code, ids: each distinct code with its k smallest ids."""
    parted = Window.partitionBy("code", F.expr(f"pmod(xxhash64(id), {SALTS})")).orderBy("id")
    some = coded.withColumn("n", F.row_number().over(parted)).where(F.col("n") <= k)
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    return some.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k at most


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbour_id, distance: the k nearest rows of ``vectors`` to each row of ``queries``."""
    coded = written(codes(vectors, key, vector), "codes")
    asked = written(codes(queries, key, vector), "query_codes")
    distinct = written(_index(coded, k), "distinct_codes", coded)
    parts = segments(distinct.count())
    each = F.array(*(F.struct(F.lit(s).alias("segment"), F.expr(_prefix("code", p)).alias("prefix")) for s, p in enumerate(parts)))
    index = distinct.select("code", "ids", F.explode(each).alias("at")).select("code", "ids", "at.segment", "at.prefix")
    pieces = index.groupBy("segment", "prefix").agg(F.expr(f"cast(count(1) div {CROWDED} as int) + 1").alias("pieces"))
    pieces = written(pieces, "shards")  # one row for SHARD codes
    index = index.join(pieces, ["segment", "prefix"]).withColumn("piece", F.expr("cast(pmod(xxhash64(code), pieces) as int)")).drop("pieces")

    def search(ids: tuple, own: pd.DataFrame, them: pd.DataFrame) -> pd.DataFrame:
        """What the queries of one run find in one piece of a shard: the k nearest of each."""
        if not len(own) or not len(them):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "distance": np.zeros(0, np.int32)})
        s, prefix, radius = int(ids[0]), int(ids[1]), int(own["radius"].iloc[0])
        low, width, named = parts[s]
        code = them["code"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(_bits(code, low, width), kind="stable")
        code, held = code[order], [np.asarray(x, np.int64) for x in them["ids"].to_numpy()[order]]
        query, bound = own["query"].to_numpy(np.int64).view(np.uint64), own["bound"].to_numpy(np.int64)
        away = np.bitwise_count(_bits(query, low + width - named, named) ^ np.uint64(prefix)).astype(np.int64)
        met = []
        for a in np.unique(away).tolist():
            mine = np.flatnonzero(away == a)
            q, at, distance = meet(query[mine], bound[mine], code, parts, s, radius, named, a)
            met.append((mine[q], at, distance))
        q, at, distance = (np.concatenate([m[c] for m in met]) for c in range(3))
        by = np.lexsort((distance, q))
        q, at, distance = q[by], at[by], distance[by]
        n = np.array([len(held[x]) for x in at], np.int64)
        before = np.cumsum(n) - n  # ids of nearer codes, of the query's own codes alone
        before -= before[np.searchsorted(q, q)] if len(q) else 0
        far = np.full(len(query), 65)
        full = before + n >= k
        np.minimum.at(far, q[full], distance[full])
        near = distance <= far[q]  # what is as far as the kth may win by its id
        q, at, distance, n = q[near], at[near], distance[near], n[near]
        out = pd.DataFrame({"query": np.repeat(query[q].view(np.int64), n), "id": np.concatenate([held[x] for x in at] or [np.zeros(0, np.int64)]), "distance": np.repeat(distance, n).astype(np.int32)})
        out = out.sort_values(["query", "distance", "id"])
        return out[out.groupby("query").cumcount() < k]

    active = written(asked.select(F.col("code").alias("query"), F.lit(64).alias("bound")).distinct(), "active_queries")
    enough = min(k, distinct.agg(F.sum(F.size("ids"))).first()[0] or 0)  # a query is full with these
    index = written(index, "code_index", distinct)
    best, radius = None, 0
    while not active.isEmpty():
        went = []
        for s, (_, width, named) in enumerate(parts):
            masks = [sum(1 << b for b in bits) for j in range(min(radius, named) + 1) if radius - j <= width - named for bits in combinations(range(named), j)]
            if masks:  # shards of this segment within the radius; at most one for SHARD codes
                went.append(active.select("query", "bound", F.lit(s).alias("segment"), F.expr(f"explode(transform(array({', '.join(f'{m}L' for m in masks)}), m -> m ^ {_prefix('query', parts[s])}))").alias("prefix")))
        if not went:
            break
        routed = went[0]
        for more in went[1:]:
            routed = routed.unionByName(more)
        routed = written(routed.join(pieces, ["segment", "prefix"]).withColumn("piece", F.expr("explode(sequence(0, pieces - 1))")).drop("pieces"), "routed_queries")
        group = ["segment", "prefix", "piece"]
        runs = written(routed.groupBy(*group).agg(F.expr(f"cast(count(1) div {QUERIES} as int) + 1").alias("runs")), "query_runs")
        sent = routed.join(runs, group).withColumn("run", F.expr("cast(pmod(xxhash64(query), runs) as int)")).drop("runs").withColumn("radius", F.lit(radius))
        shards = index.join(runs, group).withColumn("run", F.expr("explode(sequence(0, runs - 1))")).drop("runs")
        found = sent.groupBy(*group, "run").cogroup(shards.groupBy(*group, "run")).applyInPandas(search, "query long, id long, distance int")
        old = best
        best = written(_nearest(found if old is None else found.unionByName(old.drop("rank")), k), "nearest", routed, runs)
        kth = best.where(F.col("rank") == enough).select(F.col("query").alias("_query"), F.col("distance").alias("kth"))
        left = active.join(kth, F.col("query") == F.col("_query"), "left").select("query", F.coalesce("kth", F.lit(64)).alias("bound"))
        active = written(left.where(F.col("bound") >= len(parts) * (radius + 1)), "active_queries", active, *([old] if old is not None else []))
        radius += 1
    for used in (index, pieces, active):
        forget(used)
    if best is None:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0).alias("distance")).where("false")
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("neighbour_id"), "distance"))).alias("found"))  # k at most
    out = spread_join(asked, lists.withColumnRenamed("query", "code"), "code", "id")
    return out.select(F.col("id").alias("query_id"), F.explode("found").alias("f")).select("query_id", "f.*")


ORACLE_SQL = """
WITH e AS (SELECT vec_id, [x > 0 FOR x IN embedding] AS s FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id AS neighbour_id,
         len(list_filter(list_zip(q.s, d.s), lambda z: z[1] <> z[2])) AS distance
  FROM e q, e d WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM p)
SELECT query_id, rank, neighbour_id, distance::INTEGER AS distance FROM r WHERE rank <= 10
"""
