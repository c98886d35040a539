"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP and
cover all of it.  Byte embeddings, learned filters over 8 bytes at every fourth
byte, ReLU and a maximum over each chunk give chunk vectors.  One channel more
tells how far a chunk repeats itself: the largest share, over LAGS and quarters
of the chunk, of bytes that equal the byte a lag before.  The maximum and the
mean of the chunk vectors over the document meet in one logistic unit.

Fitting (Adam, fixed number of steps, fixed seed) runs in one task on at most
SAMPLE labelled documents, in the order of their ids' hash as far as SAMPLE_BYTES
reach, and all their chunks; gradients are summed over slices of chunks, so a
long text costs time, not memory.  Some texts of label 1 are cut short in a
step, so that short texts are not taken for bad ones.  Scoring reads every byte
of every text.

Nulls and empty texts are one chunk of padding and get its score.  Equal texts
have equal scores to six digits.  Without labelled rows of both kinds the score is the share
of label 1 (0.5 without any).  Extra input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from stratawell.llm import labelled
from stratawell.llm.arrow_map import map_batches
from stratawell.llm.bytes_np import slices, utf8

CHUNK, OVERLAP, STEP, FILTERS, WIDTH = 512, 64, 4, 32, 8
STRIDE = CHUNK - OVERLAP
SAMPLE, SAMPLE_BYTES, STEPS, DOCS = 4000, 24 << 20, 500, 64
CROPS = 0.12
PAD = 256
LAGS, QUARTER, ECHO = range(2, 21), 128, 4.0
VECTOR = FILTERS + 1


def echo(x: np.ndarray) -> np.ndarray:
    """Per chunk the largest share of bytes equal to the byte a lag before, over lags and quarters, times ECHO."""
    part = x[:, : CHUNK - CHUNK % QUARTER].reshape(-1, QUARTER)
    size = np.maximum((part != PAD).sum(axis=1), 48)
    best = np.zeros(len(part), np.int64)
    for lag in LAGS:
        same = (part[:, lag:] == part[:, :-lag]) & (part[:, lag:] != PAD)
        np.maximum(best, np.count_nonzero(same, axis=1), out=best)
    return (best / size).reshape(len(x), -1).max(axis=1).astype(np.float32) * ECHO


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks (n, CHUNK) of all rows, padded at their ends, and the chunks of each row."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-np.maximum(size - OVERLAP, 0) // STRIDE))
    row = np.repeat(np.arange(len(size)), count)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE + offsets[row]
    at = start[:, None] + np.arange(CHUNK)
    out = np.append(data, 0)[np.minimum(at, len(data))].astype(np.int16)
    out[at >= offsets[row + 1][:, None]] = PAD
    return out, count


def all_chunks(text: bytes) -> np.ndarray:
    return chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


class Net:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (257, WIDTH)), "w": r.normal(0, 0.25, (STEP * WIDTH, 2 * FILTERS)), "b": np.zeros(FILTERS),
            "top": r.normal(0, 0.1, VECTOR), "mean": r.normal(0, 0.1, VECTOR), "bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["emb"][PAD] = 0
        self.constant: float | None = None

    def convolve(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded chunks (n, CHUNK/4, 32) and filter responses (n, CHUNK/4 - 1, FILTERS)."""
        e = self.p["emb"][x].reshape(len(x), CHUNK // STEP, STEP * WIDTH)
        y = e.reshape(-1, STEP * WIDTH) @ self.p["w"]
        y = y.reshape(len(x), CHUNK // STEP, 2 * FILTERS)
        return e, y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]

    def chunk_vectors(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        out = np.empty((len(x), VECTOR), self.p["b"].dtype)
        for a in range(0, len(x), step):
            part = x[a : a + step]
            out[a : a + step, :FILTERS] = np.maximum(self.convolve(part)[1].max(axis=1) + self.p["b"], 0)
            out[a : a + step, FILTERS] = echo(part)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row, to six digits: the last ones of float32 products depend on the slice."""
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        x, count = chunks(data, offsets)
        v, first = self.chunk_vectors(x), np.cumsum(count) - count
        top = np.maximum.reduceat(v, first)
        mean = np.add.reduceat(v.astype(np.float64), first) / count[:, None]
        z = top.astype(np.float64) @ self.p["top"].astype(np.float64) + mean @ self.p["mean"].astype(np.float64) + float(self.p["bias"][0])
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, step: int = 512) -> dict[str, np.ndarray]:
        """Gradients of the mean loss of documents of count chunks each, over slices of step chunks."""
        p, first = self.p, np.cumsum(count) - count
        doc = np.repeat(np.arange(len(count)), count)
        at, v = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), VECTOR), np.float32)
        for a in range(0, len(x), step):
            part = slice(a, a + step)
            r = self.convolve(x[part])[1]
            at[part] = r.argmax(axis=1)
            v[part, :FILTERS] = np.maximum(np.take_along_axis(r, at[part][:, None], 1)[:, 0] + p["b"], 0)
            v[part, FILTERS] = echo(x[part])
        top, mean = np.maximum.reduceat(v, first), np.add.reduceat(v, first) / count[:, None]
        z = top @ p["top"] + mean @ p["mean"] + p["bias"][0]
        d = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        g = {"top": top.T @ d, "mean": mean.T @ d, "bias": d.sum(keepdims=True), "b": 0, "w": 0, "emb": 0}
        for a in range(0, len(x), step):
            part = slice(a, a + step)
            own, n = doc[part], np.arange(len(x[part]))[:, None]
            dv = d[own][:, None] * (p["mean"] / count[own][:, None] + p["top"] * (v[part] == top[own]))
            dv = np.where(v[part] > 0, dv, 0)[:, :FILTERS].astype(np.float32)
            g["b"] = g["b"] + dv.sum(axis=0)
            e, here = p["emb"][x[part]].reshape(len(n), CHUNK // STEP, STEP * WIDTH), at[part]
            left, right = e[n, here], e[n, here + 1]
            g["w"] = g["w"] + np.concatenate([np.einsum("nfk,nf->kf", left, dv), np.einsum("nfk,nf->kf", right, dv)], axis=1)
            de = np.concatenate([dv[:, :, None] * p["w"].T[:FILTERS], dv[:, :, None] * p["w"].T[FILTERS:]], axis=1).reshape(-1, WIDTH)
            spot = np.concatenate([here, here + 1], axis=1)[:, :, None] * STEP + np.arange(STEP)
            code = x[part][n[:, :, None], spot].reshape(-1)
            g["emb"] = g["emb"] + np.stack([np.bincount(code, de[:, k], minlength=257) for k in range(WIDTH)], axis=1)
        g["emb"][PAD] = 0
        return g


def cropped(x: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """A short piece of a document's first chunk, from a word's start to a word's end where it has some."""
    n = int((x[0] != PAD).sum())
    cuts = np.flatnonzero(x[0, :n] == 32)
    a = int(r.choice(cuts)) + 1 if len(cuts) and r.random() < 0.5 else 0
    z = min(n, a + int(r.integers(15, 160)))
    ends = cuts[(cuts > a + 4) & (cuts <= z)]
    out = np.full((1, CHUNK), PAD, np.int16)
    z = int(ends[-1]) if len(ends) else z
    out[0, : z - a] = x[0, a:z]
    return out


def fit_rows(rows: list[tuple[bytes, int]], seed: int = 1) -> Net:
    """A network of (text bytes, label) rows; a text's chunks are made when a step takes it."""
    net, y = Net(seed), np.array([label for _, label in rows], np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    r = np.random.default_rng(seed)
    m, s = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    order: list[int] = []
    for t in range(1, STEPS + 1):
        if len(order) < DOCS:
            order += r.permutation(len(rows)).tolist()
        take, order = order[:DOCS], order[DOCS:]
        parts = [all_chunks(rows[i][0]) for i in take]
        parts = [cropped(x, r) if y[i] == 1 and r.random() < CROPS else x for i, x in zip(take, parts)]
        g = net.gradients(np.concatenate(parts), np.array([len(x) for x in parts]), y[take])
        rate = 0.01 * min(1, t / 20) * (1 - 0.9 * t / STEPS)
        for k, v in net.p.items():
            q = g[k] + 1e-4 * v
            m[k] += 0.1 * (q - m[k])
            s[k] += 0.01 * (q * q - s[k])
            v -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, excluded: int = 1) -> Net:
    """The network of a bounded sample of docs(doc_id, text) with labels(doc_id, label)."""

    chosen = labelled.sample(docs, labels, label, modulus, excluded, SAMPLE)
    # At most SAMPLE rows: their running size can be had in one task.
    rows = chosen.select("doc_id", "label", F.coalesce("text", F.lit("")).cast("binary").alias("x"))
    place = W.orderBy(F.xxhash64("doc_id"), "doc_id", "size", "label").rowsBetween(W.unboundedPreceding, W.currentRow)
    # The running size counts from the row before, so the first one is always in.
    near = rows.withColumn("size", F.length("x")).withColumn("before", F.sum("size").over(place) - F.col("size"))
    rows = near.filter(F.col("before") < SAMPLE_BYTES).select("doc_id", "label", "x")

    def train(table):
        if table is None:
            return fit_rows([])
        got = sorted(zip(table["doc_id"].to_pylist(), table["x"].to_pylist(), table["label"].to_pylist()))
        return fit_rows([(x, y) for _, x, y in got])

    return labelled.fit_in_task(rows, train)


def score_frame(docs: DataFrame, net: Net, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score of each row of docs; the network (20 KB) goes with the tasks."""
    sent, types = docs.sparkSession.sparkContext.broadcast(net), dict(docs.dtypes)

    def make():
        fitted = sent.value

        def work(batch):
            data, offsets = utf8(batch.column(len(keep)))
            for a, b in slices(offsets, 1 << 19):
                score = fitted.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield {k: batch.column(i).slice(a, b - a) for i, k in enumerate(keep)} | {"__score": score}

        return work

    scored = map_batches(docs.select(*keep, F.col("text").alias("__text")), make, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", __score double")
    return scored.withColumnRenamed("__score", "score")


def op8_byte_cnn(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_frame(docs, net).select("doc_id", (labelled.remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
