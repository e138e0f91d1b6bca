"""Centroid clustering by dual-tree Lloyd rounds over integer vectors.

Vectors become integers, floor(``SCALE`` * component). Each block of up to ``BLOCK`` of them gets a cover tree once: points
enter farthest first, so that those which entered by the time the farthest distance fell below 2**i are a net of that radius;
a point hangs on the net point that was nearest when it entered. Equal vectors of a block are one point with a weight. A tree
is one row of a written table: its points in tree order and, for each node, its centre, radius, run of points and children.

In each round the centroids, ``k`` of them, get a cover tree too, and every block walks its own tree against it. A pair of
nodes is dropped when no point of the one can be nearest to a centroid of the other: the distance of the centres less both
radii is over the least distance of a centre to a centroid plus the radius. A node left with one centroid goes there whole,
none of its points compared; what is left of a leaf is compared with the centroids that are left, exactly in integers, the smaller number first on
ties. Bounds are rounded outwards, so that floating point drops no pair that may win.

A task hands on one row of sums for each cluster and component, in limbs of 32 bits; new centroids are exact floors of
sums over counts. The driver gets k times the number of components numbers a round, whatever the number of vectors.

Cases: null, short, long, null-holding and non-finite vectors are left out; repeated rows are vectors of their own, in the
choice of the first centroids too; equal hashes are ordered by id and components; a null id hashes as the text ``null``; with
fewer vectors than ``k`` each is a centroid; a cluster that becomes empty keeps its centroid; components of any size are exact
(those over 2**24 are compared without trees), distances and sums of distances of 2**63 and more are given as 2**63 - 1;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, forget, written

DIMENSIONS, SCALE, K, ROUNDS = 64, 64, 16, 3
BLOCK = 1024  # vectors to a cover tree
LEAF = 8  # points of a node that is not split
WIDE = 1 << 24  # components from which distances of 4,096 components may pass 63 bits
MOST = (1 << 63) - 1
PAIRS = 1 << 18  # point-centroid pairs compared at once


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as int64 where all are below ``WIDE``, else as Python integers."""
    if not len(x) or np.abs(x).max() < WIDE / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        above, below = float(v).as_integer_ratio()
        out[at] = above * SCALE // below
    return out


def _to(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distances of points to one centre, or to one each."""
    d = (points - centre).astype(np.float64, copy=False)
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class CoverTree:
    """Nodes of a cover tree over distinct ``points`` (int64). Node 0 is the root; ``order`` lists points so that node n holds
    those from first[n] to last[n]; a node with children has them from child[n] to child[n] + children[n]."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        n, points = len(points), points.astype(np.float64)  # exact below WIDE
        far, owner = _to(points, points[0]), np.zeros(n, np.int64)
        hung: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # by net point: (level, point), in order of entry
        entered = []
        for _ in range(n - 1):
            new = int(far.argmax())
            level = int(np.ceil(np.log2(far[new]))) - 1
            hung[owner[new]].append((level, new))
            entered.append((int(owner[new]), new))
            d = _to(points, points[new])
            nearer = d < far
            owner[nearer], far[nearer] = new, d[nearer]
            far[new] = 0
        self.centre, self.radius, self.first, self.last, self.child, self.children = [], [], [], [], [], []
        size = np.ones(n, np.int64)
        for parent, p in reversed(entered):
            size[parent] += size[p]
        self.order = np.zeros(n, np.int64)
        # Nodes by breadth, so that children of a node follow each other. A node is (point, how many of its hung points are above).
        queue, self.centre = [(0, 0, 0, n)], [0]
        for fields in (self.radius, self.child, self.children):
            fields.append(0)
        self.first, self.last = [0], [n]
        at = 0
        while at < len(queue):
            p, seen, lo, hi = queue[at]
            below = hung[p]
            if hi - lo > leaf:
                level = below[seen][0]
                stop = seen
                while stop < len(below) and below[stop][0] == level:
                    stop += 1
                kids = [(q, 0, int(size[q])) for _, q in below[seen:stop]]
                kids.insert(0, (p, stop, hi - lo - sum(k[2] for k in kids)))
                self.child[at], self.children[at] = len(queue), len(kids)
                for q, skip, count in kids:
                    queue.append((q, skip, lo, lo + count))
                    self.centre.append(q), self.first.append(lo), self.last.append(lo + count)
                    self.radius.append(0), self.child.append(0), self.children.append(0)
                    lo += count
            else:
                stack, k = [(p, seen)], lo
                while stack:
                    q, skip = stack.pop()
                    self.order[k] = q
                    k += 1
                    stack += [(r, 0) for _, r in hung[q][skip:]]
            at += 1
        self.centre, self.first, self.last, self.child, self.children = (np.array(x, np.int64) for x in (self.centre, self.first, self.last, self.child, self.children))
        self.radius = np.array([_to(points[self.order[a:b]], points[c]).max() for c, a, b in zip(self.centre, self.first, self.last, strict=True)])


def nearest(points: np.ndarray, tree: dict | None, centroids: list[list[int]], above: CoverTree | None, distinct: np.ndarray) -> tuple[list, list]:
    """Nodes that go to one centroid whole, as (node, centroid) arrays, and pairs (point in tree order, centroid) that are left
    to compare. ``distinct``: the smallest number of each different centroid, which ``above`` is the tree of."""
    if tree is None or above is None:
        n = np.arange(len(points))
        return [], [(np.repeat(n, len(distinct)), np.tile(distinct, len(n)))]
    c = np.array(centroids, np.int64)
    v, u = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole, left = [], []
    while len(v):
        apart = _to(points[tree["centre"][v]], c[distinct[above.centre[u]]])
        slack = apart * 1e-9 + 1e-6
        at, group = np.unique(v, return_inverse=True)
        upper = np.full(len(at), np.inf)
        np.minimum.at(upper, group, apart + slack + tree["radius"][v])
        stay = apart - slack - tree["radius"][v] - above.radius[u] <= upper[group]
        v, u, group = v[stay], u[stay], group[stay]
        pairs = np.bincount(group, minlength=len(at))
        single = (pairs[group] == 1) & (above.children[u] == 0) & (above.last[u] - above.first[u] == 1)
        whole.append((v[single], distinct[above.centre[u[single]]]))
        v, u, group = v[~single], u[~single], group[~single]
        # A node of vectors whose centroid nodes are all wider, or that is a leaf, waits until those are split.
        widest = np.zeros(len(at))
        np.maximum.at(widest, group, np.where(above.children[u] > 0, above.radius[u], -1.0))
        splits = np.zeros(len(at), bool)
        np.logical_or.at(splits, group, above.children[u] > 0)
        down = (tree["children"][v] > 0) & ((tree["radius"][v] >= widest[group]) | ~splits[group])
        done = (tree["children"][v] == 0) & ~splits[group]
        left.append(_leaf_pairs(tree, above, v[done], u[done], distinct))
        more_v, more_u = [], []
        for split, mine, other, nodes in ((down, v, u, tree), (~down & ~done & (above.children[u] > 0), u, v, above)):
            first, n = _at(nodes, "child")[mine[split]], _at(nodes, "children")[mine[split]]
            kids = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]] if len(n) else first, n) + np.arange(n.sum())
            twin = np.repeat(other[split], n)
            more_v.append(kids if nodes is tree else twin)
            more_u.append(twin if nodes is tree else kids)
        rest = ~down & ~done & (above.children[u] == 0)
        v, u = np.concatenate([*more_v, v[rest]]), np.concatenate([*more_u, u[rest]])
    return whole, left


def _at(nodes: dict | CoverTree, name: str) -> np.ndarray:
    return nodes[name] if isinstance(nodes, dict) else getattr(nodes, name)


def _leaf_pairs(tree: dict, above: CoverTree, v: np.ndarray, u: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All points of the leaves v with all centroids of the leaves u."""
    p = [np.repeat(np.arange(tree["first"][a], tree["last"][a]), above.last[b] - above.first[b]) for a, b in zip(v, u, strict=True)]
    c = [np.tile(distinct[above.order[above.first[b] : above.last[b]]], tree["last"][a] - tree["first"][a]) for a, b in zip(v, u, strict=True)]
    none = np.zeros(0, np.int64)
    return np.concatenate(p or [none]), np.concatenate(c or [none])


def assign(points: np.ndarray, tree: dict | None, centroids: list[list[int]]) -> np.ndarray:
    """The nearest centroid of each point, by both trees; ties go to the smaller number."""
    wide = points.dtype == object or any(abs(x) >= WIDE for c in centroids for x in c)
    c = np.array(centroids, object if wide else np.int64)
    seen: dict[tuple, int] = {}
    for k, x in enumerate(centroids):
        seen.setdefault(tuple(x), k)
    distinct = np.array(sorted(seen.values()), np.int64)
    above = None if wide else CoverTree(c[distinct], 1)
    whole, left = nearest(points, None if wide else tree, centroids, above, distinct)
    out = np.full(len(points), -1, np.int64)
    for nodes, k in whole:
        n = tree["last"][nodes] - tree["first"][nodes]
        at = np.repeat(tree["first"][nodes] - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n) + np.arange(n.sum())
        out[at] = np.repeat(k, n)
    p, k = (np.concatenate([x[j] for x in left] or [np.zeros(0, np.int64)]) for j in (0, 1))
    best = np.full(len(points), MOST if not wide else None, object if wide else np.int64)
    order = np.lexsort((k, p))
    p, k = p[order], k[order]
    for s in range(0, len(p), PAIRS):
        d = points[p[s : s + PAIRS]] - c[k[s : s + PAIRS]]
        d = (d * d).sum(axis=1)
        if wide:
            for i, j, x in zip(p[s : s + PAIRS], k[s : s + PAIRS], d, strict=True):
                if best[i] is None or x < best[i]:
                    best[i], out[i] = x, j
            continue
        i = p[s : s + PAIRS]
        before = best[i]
        np.minimum.at(best, i, d)
        win = np.flatnonzero((d == best[i]) & (d < before))[::-1]  # of equal ones the first, smaller number is put last and stays
        out[i[win]] = k[s : s + PAIRS][win]
    return out


def _limbs(cluster: int, component: int, total: int) -> Iterator[tuple[int, int, int, int]]:
    """A number as 32-bit limbs, the last one signed, so that limbs of many tasks can be added as longs."""
    limb = 0
    while not -(1 << 31) <= total < 1 << 31:
        yield cluster, component, limb, total & 0xFFFFFFFF
        total, limb = total >> 32, limb + 1
    yield cluster, component, limb, total


FIELDS = (("centre", np.int64), ("radius", np.float64), ("first", np.int64), ("last", np.int64), ("child", np.int64), ("children", np.int64))
TREE = "ids array<long>, weights array<int>, points binary, wide array<string>, " + ", ".join(f"{name} binary" for name, _ in FIELDS)


def _plant(ids: list, x: np.ndarray) -> dict:
    """The row of a block: distinct points in tree order, their ids (those of a point follow each other) and its tree."""
    points = integers(x)
    if points.dtype == object:
        return {"ids": ids, "weights": [1] * len(ids), "points": b"", "wide": [str(v) for v in points.ravel()], **{name: b"" for name, _ in FIELDS}}
    own, back, n = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    tree = CoverTree(own)
    place = np.zeros(len(own), np.int64)
    place[tree.order] = np.arange(len(own))
    by = np.argsort(place[back.ravel()], kind="stable")
    return {
        "ids": [ids[i] for i in by], "weights": n[tree.order].astype(np.int32).tolist(), "points": own[tree.order].astype(np.int32).tobytes(), "wide": None,
        **{name: (place[tree.centre] if name == "centre" else getattr(tree, name)).astype(kind).tobytes() for name, kind in FIELDS},
    }


def _grown(row: dict) -> tuple[np.ndarray, np.ndarray, dict | None]:
    weights = np.array(row["weights"], np.int64)
    if row["wide"] is not None:
        return np.array([int(v) for v in row["wide"]], object).reshape(len(weights), -1), weights, None
    points = np.frombuffer(row["points"], np.int32).astype(np.int64).reshape(len(weights), -1)
    return points, weights, {name: np.frombuffer(row[name], kind) for name, kind in FIELDS}


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, x (doubles) of the vectors that count."""
    whole = f"size(embedding) = {dimensions} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))


def first_centroids(vectors: DataFrame, k: int = K) -> list[list[int]]:
    """The k kept vectors of the smallest hashes; k rows reach the driver."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.orderBy(hashed, "vec_id", "x").limit(k).collect()
    return [[int(v) for v in integers(np.array([r["x"]], np.float64))[0]] for r in rows]


def plant(vectors: DataFrame) -> DataFrame:
    """A row for each block of kept vectors: its cover tree."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.int32())), ("points", pa.binary()), ("wide", pa.list_(pa.string())), *((name, pa.binary()) for name, _ in FIELDS)])
        ids, held = [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_plant(ids, np.concatenate(held))], schema)

        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for s in range(0, len(x), BLOCK):
                if ids and len(ids) + len(x[s : s + BLOCK]) > BLOCK:
                    yield row()
                    ids, held = [], []
                ids += batch["vec_id"][s : s + BLOCK].to_pylist()
                held.append(x[s : s + BLOCK])
        if ids:
            yield row()

    with arrow_rows(vectors.sparkSession):
        return written(vectors.mapInArrow(each, TREE), "cover_trees")


def lloyd(trees: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """The centroids after ``rounds`` rounds over the blocks of ``plant``."""
    for _ in range(rounds if centroids else 0):

        def sums(batches: Iterator[pa.RecordBatch], now: list[list[int]] = centroids) -> Iterator[pa.RecordBatch]:
            d = len(now[0])
            n, total = [0] * len(now), np.zeros((len(now), d), object)
            for batch in batches:
                for row in batch.to_pylist():
                    points, weights, tree = _grown(row)
                    to = assign(points, tree, now)
                    for k in np.unique(to).tolist():
                        mine = to == k
                        n[k] += int(weights[mine].sum())
                        total[k] += (points[mine] * weights[mine, None]).sum(axis=0).astype(object)
            rows = [limb for k in range(len(now)) if n[k] for j, x in enumerate([*total[k], n[k]]) for limb in _limbs(k, j, int(x))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["cluster", "component", "limb", "part"]).astype({"cluster": "int32", "component": "int32", "limb": "int32", "part": "int64"}), preserve_index=False)

        with arrow_rows(trees.sparkSession, 16):
            limbs = trees.mapInArrow(sums, "cluster int, component int, limb int, part long").groupBy("cluster", "component", "limb").agg(F.sum("part").alias("part")).collect()
        d = len(centroids[0])
        total = [[0] * (d + 1) for _ in centroids]
        for r in limbs:
            total[r["cluster"]][r["component"]] += r["part"] << 32 * r["limb"]
        centroids = [[x // t[d] for x in t[:d]] if t[d] else c for t, c in zip(total, centroids, strict=True)]
    return centroids


def _placed(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                points, weights, tree = _grown(row)
                to = assign(points, tree, centroids)
                near = points - np.array(centroids, object if points.dtype == object or any(abs(x) >= WIDE for c in centroids for x in c) else np.int64)[to]
                distance = [min(MOST, int(x)) for x in (near * near).sum(axis=1)]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(np.repeat(to, weights).astype(np.int32)),
                    "distance": pa.array(np.repeat(np.array(distance, np.int64), weights)),
                })

    with arrow_rows(trees.sparkSession, 16):
        return written(trees.mapInArrow(each, "vec_id long, cluster int, distance long"), "clusters")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, dimensions)
    centroids = first_centroids(rows, k)
    trees = plant(rows)
    centroids = lloyd(trees, centroids, rounds)
    placed = _placed(trees, centroids)
    forget(trees)
    inertia = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    whole = min(MOST, sum(inertia.values()))
    known = [(c, min(MOST, inertia.get(c, 0)), whole, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    told = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _round(k: int) -> str:
    """SQL for assignment ``a{k}`` to the centroids ``c{k}``."""
    return f"""
d{k} AS (SELECT r, c, sum((v - x) * (v - x))::BIGINT AS d FROM p JOIN c{k} USING (j) GROUP BY r, c),
a{k} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{k} GROUP BY r)"""


def _moved(k: int) -> str:
    return f"""
m{k} AS (SELECT c, j, sum(v) AS s, count(*) AS n FROM p JOIN a{k} USING (r) GROUP BY c, j),
c{k + 1} AS (SELECT c, j, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{k} LEFT JOIN m{k} USING (c, j))"""


ORACLE_SQL = f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, unnest(range(1, {DIMENSIONS} + 1)) AS j, unnest(list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT)) AS v FROM e),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), vec_id) - 1 AS c FROM e QUALIFY c < {K}),
c0 AS (SELECT c, j, v AS x FROM f JOIN p USING (r)),{",".join(_round(k) + "," + _moved(k) for k in range(ROUNDS))},{_round(ROUNDS)},
t AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY j)) AS s FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, t.s AS centroid_sha256
FROM a{ROUNDS} a JOIN e USING (r) JOIN t ON t.c = a.c
"""
