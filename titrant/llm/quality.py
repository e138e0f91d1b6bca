"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Learned filters look at chunks of ``WIDTH`` bytes that overlap by half and cover the whole
document; each filter keeps its largest response over all chunks (max-pooling); the pooled responses are rectified and
combined into one probability. Memory for a text is bounded: long texts pass in blocks, the maxima of blocks are merged.

Training is on the driver over a bounded sample: ``SAMPLE`` labelled rows in the order of a hash of doc_id, fewer if their
texts come to more than ``SAMPLE_BYTES``; lengths are looked at first, texts are fetched by their place. Rows whose crc32 of
doc_id has remainder 0 modulo 5 are held out. Only bytes of the text are inputs. Max-pooling sends a gradient to one chunk
for each filter, so learning costs little more than scoring, and takes blocks of a text as scoring does.

Cases: null and empty texts are scored as one chunk of padding; without any labelled row the score is 0.5 for all;
a null label is no label; of a document labelled twice the highest label counts; rows that repeat a labelled doc_id are rows
of the sample each, within its bounds; a text that alone exceeds what is left of the bytes is passed over; a null doc_id
has no label and is not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import place, small_batches, stored, texts

WIDTH, DEPTH, FILTERS = 12, 8, 48
STEP = WIDTH // 2
BLOCK = WIDTH * 16384  # bytes of a long text handled at once
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
EPOCHS, BATCH, RATE, SEED = 6, 32, 4e-3, 7
ACCEPT = 0.3


class Network:
    """embed: 256 x DEPTH; filters: WIDTH * DEPTH x FILTERS; out: FILTERS; bias: FILTERS and 1."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = {
            "embed": rng.normal(0, 0.5, (256, DEPTH)),
            "filters": rng.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)),
            "shift": np.zeros(FILTERS),
            "out": rng.normal(0, FILTERS**-0.5, FILTERS),
            "bias": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    @staticmethod
    def bytes_of(text: str) -> np.ndarray:
        """The bytes, padded with zeros to whole chunks that overlap by half."""
        raw = np.frombuffer(text.encode(), np.uint8)
        n = max(WIDTH, -(-len(raw) // STEP) * STEP)
        return np.concatenate([raw, np.zeros(n - len(raw), np.uint8)])

    def pooled(self, raw: np.ndarray) -> np.ndarray:
        """The largest response of each filter."""
        return self._largest(raw)[0]

    def _largest(self, raw: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter and, if asked for, the first byte of the chunk that has it."""
        best, at = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        for start in range(0, len(raw) - STEP, BLOCK):
            vectors = self.w["embed"][raw[start : start + BLOCK + STEP]]
            for lag in (0, STEP):
                some = vectors[lag : lag + (len(vectors) - lag) // WIDTH * WIDTH]
                if not len(some):
                    continue
                response = some.reshape(-1, WIDTH * DEPTH) @ self.w["filters"]
                if where:
                    top = response.argmax(axis=0)
                    value = response[top, np.arange(FILTERS)]
                    at = np.where(value > best, start + lag + top * WIDTH, at)
                else:
                    value = response.max(axis=0)
                best = np.maximum(best, value)
        return best, at

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.w["shift"], 0) @ self.w["out"] + self.w["bias"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, raws: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> None:
        rng = np.random.default_rng(SEED)
        labels = labels.astype(np.float32)
        share = float(np.clip(labels.mean(), 0.02, 0.98))
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))  # both classes weigh the same
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        t, steps = 0, epochs * -(-len(raws) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(raws))
            for k in range(0, len(order), BATCH):
                grad = self._gradient([raws[i] for i in order[k : k + BATCH]], labels[order[k : k + BATCH]], weight[order[k : k + BATCH]])
                t += 1
                rate = RATE * (1 - 0.9 * t / steps)
                for name, g in grad.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.99 * s[name] + 0.01 * g * g
                    self.w[name] -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)

    def _gradient(self, raws: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        pooled, chunks = [], []
        for raw in raws:
            value, at = self._largest(raw, where=True)
            pooled.append(value)
            chunks.append(raw[at[:, None] + np.arange(WIDTH)])  # FILTERS x WIDTH
        pooled, chunks = np.array(pooled), np.array(chunks)
        active = np.maximum(pooled + self.w["shift"], 0)
        error = ((self.scores(pooled) - labels) * weight / len(raws)).astype(np.float32)
        grad["out"], grad["bias"][0] = active.T @ error, error.sum()
        back = error[:, None] * self.w["out"] * (active > 0)  # documents x FILTERS
        grad["shift"] = back.sum(axis=0)
        vectors = self.w["embed"][chunks].reshape(len(raws), FILTERS, -1)
        grad["filters"] = np.einsum("df,dfk->kf", back, vectors)
        to_vectors = (back[:, :, None] * self.w["filters"].T[None]).reshape(-1, DEPTH)
        np.add.at(grad["embed"], chunks.reshape(-1), to_vectors)
        grad["out"] += 1e-4 * self.w["out"]
        return grad


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    """A network for ``label`` from at most ``sample`` labelled rows that are not held out and ``sample_bytes`` of text; None
    without any."""
    docs = stored(docs)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # ``sample`` rows at most
    sizes = texts(docs, *place(docs)).join(chosen, "doc_id").select("file", "row", "label", F.xxhash64("doc_id").alias("order"), F.octet_length("text").alias("bytes"))
    left, taken = sample_bytes, []
    for r in sizes.orderBy("order", "file", "row").limit(sample).collect():
        if r["bytes"] <= left:
            left -= r["bytes"]
            taken.append((r["file"], r["row"], r["label"]))
    if not taken:
        return None
    taken = F.broadcast(docs.sparkSession.createDataFrame(taken, "file long, row long, label long"))  # ``sample`` rows at most
    rows = texts(docs, *place(docs)).join(taken, ["file", "row"]).select("doc_id", "text", "label").collect()  # ``sample_bytes`` at most
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    network = Network()
    network.fit([network.bytes_of(r["text"]) for r in rows], np.array([int(r["label"] > 0) for r in rows]))
    return network


def score(docs: DataFrame, network: Network | None, *more: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns named in ``more``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if network:
                pooled = [network.pooled(network.bytes_of(t.as_py())) for t in batch["text"]]
                s = network.scores(np.array(pooled).reshape(-1, FILTERS))
            else:
                s = np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64()), *(batch[c] for c in more)], ["doc_id", "score", *more])

    source = texts(docs, *more)
    kinds = ", ".join(["doc_id long", "score double", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more)])
    scored = source.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(each, kinds)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"), *more)


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; each row is judged by its own text."""
    names = docs.columns
    network = train(docs, labels)
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if network:
                own = batch["text"].to_pylist()
                s = network.scores(np.array([network.pooled(network.bytes_of(t or "")) for t in own]).reshape(-1, FILTERS))
                batch = batch.filter(pa.array(s >= ACCEPT))
            yield batch

    return docs.mapInArrow(each, docs.schema).select(*names)
