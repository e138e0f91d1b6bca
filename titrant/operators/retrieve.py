"""Vector, tag and lexical retrieval over chunk tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchor_tokens
from ..sources.kept import kept

FLOOR, BONUS, K = 0.55, 0.15, 3
DIMENSIONS = 256
QUERIES, PART = 4096, 16384  # vectors of both sides that a task has at once
PIVOTS = 4096
ASKED, ROWS = 512, 2048  # vectors of both sides that are multiplied at once


def fetch_size(k: int) -> int:
    return max(5 * k, 15)


def embed(rows: DataFrame, text: str, out: str = "embedding", model: Callable[[pd.Series], list] | None = None) -> DataFrame:
    """A unit vector for each text: by ``model`` (texts to lists of floats), else term frequencies hashed to ``DIMENSIONS``."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        if model:
            raw = np.array(list(model(texts)), np.float32)
        else:
            import re
            import zlib

            raw = np.zeros((len(texts), DIMENSIONS), np.float32)
            for k, t in enumerate(texts):
                for w in re.findall("[a-z0-9]+", (t or "").lower()):
                    raw[k, zlib.crc32(w.encode()) % DIMENSIONS] += 1
        return pd.Series(list(raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)))

    return rows.withColumn(out, vectors(text))


def _best(score: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, equal scores by the smaller id; all ties of the kth are looked at."""
    if score.shape[1] <= k:
        return score, names
    limit = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    order = np.lexsort((np.where(score >= limit, names, np.iinfo(np.int64).max), np.where(score >= limit, -score, np.inf)), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)


def _matrix(rows: pa.Table) -> np.ndarray:
    return np.array(rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows.num_rows, -1)


def _search(own: pa.Table, them: pa.Table, k: int) -> pa.Table:
    """The k best of ``them`` for each of ``own``."""
    out = {"q": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "similarity": np.zeros(0)}
    if own.num_rows and them.num_rows:
        left, right, ids, names = _matrix(own), _matrix(them).T, own["q"].to_numpy(), them["id"].to_numpy()
        found = []
        for q in range(0, len(ids), ASKED):
            best = None
            for at in range(0, len(names), ROWS):
                score = np.round(left[q : q + ASKED] @ right[:, at : at + ROWS], 12)
                some = (score, np.broadcast_to(names[at : at + ROWS], score.shape))
                best = _best(*(some if best is None else (np.hstack(x) for x in zip(best, some, strict=True))), k)
            found.append((np.repeat(ids[q : q + ASKED], best[0].shape[1]), best[1].ravel(), best[0].ravel()))
        out = {name: np.concatenate([f[c] for f in found]) for c, name in enumerate(out)}
    return pa.table(out)


FOUND = "q long, id long, similarity double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Parts:
    """Chunks dealt to their nearest pivots, with the radius of each part.

    No chunk of a part has a greater inner product with q than q . pivot + |q| radius, so a part whose bound is under the kth
    similarity that a query has so far is left out. Pivots are the chunks of the smallest hashes, ``PIVOTS`` at most; they, and
    the radius and size of each part, are what reaches the driver."""

    def __init__(self, chunks: DataFrame, parts: int) -> None:
        spark, kind = chunks.sparkSession, chunks.schema["v"].dataType.simpleString()
        rows = chunks.orderBy(F.xxhash64("id"), "id").limit(min(parts, PIVOTS)).collect()
        pivots = np.array([r["v"] for r in rows], np.float64)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = _matrix(pa.table(batch))
                for s in range(0, len(own), ROWS):
                    some = own[s : s + ROWS]
                    near = ((pivots**2).sum(axis=1) - 2 * some @ pivots.T).argmin(axis=1)
                    r = np.sqrt(((some - pivots[near]) ** 2).sum(axis=1))
                    piece = batch.slice(s, ROWS)
                    yield pa.RecordBatch.from_arrays([piece["id"], piece["v"], pa.array(near.astype(np.int32)), pa.array(r)], ["id", "v", "part", "r"])

        self.chunks = kept(chunks.mapInArrow(deal, f"id long, v {kind}, part int, r double"))
        told = self.chunks.groupBy("part").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # PIVOTS at most
        self.pivots, self.radius, self.size = pivots, np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
        for row in told:
            self.radius[row["part"]], self.size[row["part"]] = row["r"] * (1 + 1e-9) + 1e-9, row["n"]
        self.sizes = spark.createDataFrame([(r["part"], r["n"] // PART + 1) for r in told], "part int, pieces long")

    def asked(self, queries: DataFrame, k: int, later: bool) -> DataFrame:
        """q, v, part: first the parts of the best bounds that hold k chunks; ``later`` the others whose bound reaches the query's
        column ``kth``."""
        pivots, radius, size = self.pivots, self.radius, self.size

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, ASKED):
                    piece = batch.slice(s, ASKED)
                    own = _matrix(pa.table(piece))
                    bound = own @ pivots.T + np.sqrt((own**2).sum(axis=1))[:, None] * radius
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(size[order], axis=1) - size[order]
                    go = np.zeros(bound.shape, bool)
                    np.put_along_axis(go, order, before < k, axis=1)
                    if later:
                        kth = piece["kth"].to_numpy(zero_copy_only=False)
                        go = ~go & (bound >= kth[:, None] - 1e-9) & (size > 0)
                    at, part = np.nonzero(go & (size > 0))
                    yield pa.RecordBatch.from_arrays([piece["q"].take(pa.array(at)), piece["v"].take(pa.array(at)), pa.array(part.astype(np.int32))], ["q", "v", "part"])

        kind = queries.schema["v"].dataType.simpleString()
        return queries.mapInArrow(route, f"q long, v {kind}, part int")

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """What routed queries find; a part with many chunks is met in pieces, one with many queries in runs of these."""
        runs = asked.groupBy("part").agg(F.expr(f"count(1) div {QUERIES} + 1").alias("runs")).join(F.broadcast(self.sizes), "part")
        runs = F.broadcast(kept(runs))  # PIVOTS at most
        own = asked.join(runs, "part").withColumns({"run": F.expr("pmod(xxhash64(q), runs)"), "piece": F.expr("explode(sequence(0L, pieces - 1))")}).select("part", "piece", "run", "q", "v")
        them = self.chunks.join(runs, "part").withColumns({"piece": F.expr("pmod(xxhash64(id), pieces)"), "run": F.expr("explode(sequence(0L, runs - 1))")}).select("part", "piece", "run", "id", "v")
        group = ["part", "piece", "run"]
        return own.groupBy(*group).cogroup(them.groupBy(*group)).applyInArrow(lambda a, b: _search(a, b, k), FOUND)


def top_k(chunks: DataFrame, queries: DataFrame, k: int, chunk_id: str = "id", query_id: str = "query_id", vector: str = "embedding", visits: list[DataFrame] | None = None) -> DataFrame:
    """query_id, id, similarity (inner product in double, 12 decimals), rank: exact search, ties by the smaller id.

    Up to ``PART`` chunks are one part, which blocks of ``QUERIES`` queries meet. More are dealt to pivots (``Parts``): a query
    visits the parts of the best bounds first, then, with the kth similarity found there, only those that may hold better
    ones. ``visits`` gets a table q, parts of how many parts each query visited.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v")).where("v is not null")
    held = chunks.select(F.col(chunk_id).cast("long").alias("id"), F.col(vector).alias("v")).where("v is not null")
    parts = -(-held.count() // PART)
    if parts <= 1:
        blocks = max(1, -(-asked.count() // QUERIES))
        asked = asked.withColumn("block", F.expr(f"cast(pmod(xxhash64(q), {blocks}) as int)"))
        held = held.withColumn("block", F.expr(f"explode(sequence(0, {blocks - 1}))"))
        found = asked.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(lambda a, b: _search(a, b, k), FOUND)
        return _ranked(found, k).withColumnRenamed("q", query_id)
    index = Parts(held, parts)
    first = kept(index.asked(asked, k, False))
    best = kept(_ranked(index.search(first, k), k))
    kth = best.where(F.col("rank") == k).select("q", F.col("similarity").alias("kth"))
    more = asked.join(kth, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    later = kept(index.asked(more, k, True))
    if visits is not None:
        visits.append(first.unionByName(later).groupBy("q").agg(F.count_distinct("part").alias("parts")))
    found = best.drop("rank").unionByName(index.search(later, k))
    return _ranked(found, k).withColumnRenamed("q", query_id)


def tag_index(rows: DataFrame, tags: Column | str, item: str) -> DataFrame:
    """tag, item: each pair once. A row for each posting, so that a tag with very many items is no one task's list."""
    return rows.select(F.explode(tags).alias("tag"), F.col(item).alias("item")).distinct()


def has_anchor(name: Column | str, title: Column | str, text: Column | str) -> Column:
    """Whether a name shares a word with a page's title and section, or with its text; a name without words does not."""
    own = anchor_tokens(name)
    return (F.size(own) > 0) & (F.arrays_overlap(own, anchor_tokens(title)) | F.arrays_overlap(own, anchor_tokens(text)))


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = K, floor: float = FLOOR, bonus: float = BONUS, lexical: bool = True) -> DataFrame:
    """The k best chunks for each query: vector search, all chunks tagged with its id added, a bonus for the tag, a floor
    for untagged ones, a lexical anchor, and one chunk of each topic and section.

    queries: query_id, name, test_id, embedding; chunks: id, test_ids, topic, section, text, embedding. Equal scores keep
    the vector rank, then the chunk's order.
    """
    near = top_k(chunks, queries, fetch_size(k))
    found = near.select("query_id", "id", "similarity", F.col("rank").cast("long").alias("at"))
    dot = F.expr("aggregate(zip_with(qv, cv, (a, b) -> cast(a as double) * cast(b as double)), 0D, (s, x) -> s + x)")
    tagged = chunks.select("id", F.explode("test_ids").alias("tag"), F.col("embedding").alias("cv"))
    extra = queries.select("query_id", "test_id", F.col("embedding").alias("qv")).join(tagged, F.col("test_id") == F.col("tag"))
    extra = extra.select("query_id", "id", dot.alias("similarity"), (F.col("id") + (1 << 40)).alias("at"))
    extra = extra.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    rows = found.unionByName(extra).join(queries.select("query_id", "name", "test_id"), "query_id")
    rows = rows.join(chunks.drop("embedding"), "id").withColumn("tagged", F.coalesce(F.array_contains("test_ids", F.col("test_id")), F.lit(False)))
    rows = rows.withColumn("score", F.col("similarity") + F.when(F.col("tagged"), bonus).otherwise(0.0)).where((F.col("score") >= floor) | F.col("tagged"))
    if lexical:
        rows = rows.where(F.col("tagged") | has_anchor("name", F.concat_ws(" ", "topic", "section"), "text"))
    order = [F.desc("score"), F.col("at")]
    rows = rows.withColumn("_one", F.row_number().over(Window.partitionBy("query_id", "topic", "section").orderBy(*order))).where("_one = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return rows.withColumns({"similarity": F.round("similarity", 4), "score": F.round("score", 4)}).drop("_one", "at")


def query_text(name: Column | str, test_id: Column | str) -> Column:
    name, test_id = (F.col(c) if isinstance(c, str) else c for c in (name, test_id))
    return F.when(test_id.isNull() | (test_id == ""), name).otherwise(F.concat(name, F.lit(" ("), test_id, F.lit(") blood test result meaning")))


def covered_ids(chunks: DataFrame, tags: str = "test_ids") -> DataFrame:
    """test_id: each id that a chunk is tagged with, in order."""
    return chunks.select(F.explode(tags).alias("test_id")).distinct().orderBy("test_id")


def index_health(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: chunks, vectors, dimensions, whether each chunk has a vector and all have the same size."""
    d = F.size(vector)
    out = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count(vector).alias("vectors"), F.max(d).alias("dimensions"), F.min(d).alias("_least"))
    return out.withColumn("healthy", (F.col("chunks") == F.col("vectors")) & (F.col("dimensions") == F.col("_least"))).drop("_least")
