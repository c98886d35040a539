"""Toxicity: a counterfactually regularised linear classifier.

Features are the distinct words (runs of letters, digits and bytes from 0x80) of
a whole text and their 4- and 6-byte prefixes, hashed to DIM.  Weights, none below
0, minimise logistic loss + L1 + L2 + LAMBDA times the squared score change between a labelled
text and its counterfactuals, in which the identity terms give way to the other
terms of their groups, one after another.  Neutral sentences that name each identity term join the
sample with label 0.  So neutral mentions of a group do not raise a score.

Fitting runs in one task on at most SAMPLE labelled documents and all their words;
scoring reads every word of every text.

Nulls, empty texts and texts without words have the intercept's score.  Equal
texts have equal scores.  Without labelled rows of both kinds the score is the
share of label 1 (0.5 without any).  Extra input columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratawell.llm import labelled
from stratawell.llm.arrow_map import map_batches
from stratawell.llm.bytes_np import Words, slices, utf8

BITS = 20
DIM = 1 << BITS
PREFIXES = (4, 6)
SAMPLE, LAMBDA, L1, L2, STEPS = 5000, 5.0, 0.02, 0.2, 150
THRESHOLD = 0.3

GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("american", "german", "french", "spanish", "mexican", "chinese", "indian", "russian", "turkish", "polish"),
    ("blind", "deaf", "disabled", "autistic"), ("old", "young"),
    ("christen", "muslime", "juden", "hindus"), ("frauen", "männer"),
    ("chrétiens", "musulmans", "juifs"), ("femmes", "hommes"),
    ("cristianos", "musulmanes", "judíos"), ("mujeres", "hombres"),
)
PLACE = {t: (g, i) for g in GROUPS for i, t in enumerate(g)}
TERM = re.compile(r"\b(" + "|".join(sorted(map(re.escape, PLACE), key=len, reverse=True)) + r")\b", re.I)
NEUTRAL = ("the {} people of the town opened a school", "my neighbour is {} and bakes bread", "a report about {} families was published")

#: Word separators: ASCII other than letters and digits.
BREAKS = np.array([b < 128 and not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123) for b in range(256)])


def counterfactuals(text: str) -> list[str]:
    """The text with each identity term replaced by the k-th after it in its group, for every k; none without terms."""
    groups = [PLACE[m.lower()][0] for m in TERM.findall(text)]

    def turned(k):
        def other(m):
            group, i = PLACE[m[0].lower()]
            return group[(i + k) % len(group)]

        return TERM.sub(other, text)

    return [turned(k) for k in range(1, max(map(len, groups)))] if groups else []


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of the rows, sorted."""
    w = Words(data, offsets, BREAKS, PREFIXES)
    row = [w.row, *(w.row[i] for i, _ in w.prefix)]
    code = [w.hash, *(h for _, h in w.prefix)]
    key = (np.concatenate(row).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(code) >> np.uint64(64 - BITS))
    key = np.unique(key)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64(DIM - 1)).astype(np.int64)


def features_of(texts: list[str]) -> list[np.ndarray]:
    if not texts:
        return []
    row, code = features(*utf8(pa.array(texts, pa.string())))
    return np.split(code, np.searchsorted(row, np.arange(1, len(texts))))


class Model:
    def __init__(self, weights: np.ndarray | None, bias: float):
        self.weights, self.bias = weights, bias

    def __getstate__(self):
        w = self.weights
        used = None if w is None else np.flatnonzero(w)
        return {"used": used, "values": None if w is None else w[used], "bias": self.bias}

    def __setstate__(self, state):
        self.weights, self.bias = None if state["used"] is None else np.zeros(DIM), state["bias"]
        if state["used"] is not None:
            self.weights[state["used"]] = state["values"]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        z = np.full(rows, self.bias)
        if self.weights is not None:
            row, code = features(data, offsets)
            z += np.bincount(row, self.weights[code], minlength=rows)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score_texts(self, texts: list[str]) -> np.ndarray:
        return self.scores(*utf8(pa.array(texts, pa.string())))


class Sparse:
    """Rows of feature lists (all ones, or signed), for products with a weight vector."""

    def __init__(self, rows: list[np.ndarray], signs: list[np.ndarray] | None = None):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in rows])
        self.code = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.sign = np.concatenate(signs).astype(np.float32) if signs else None

    def _signed(self, x: np.ndarray) -> np.ndarray:
        return x if self.sign is None else x * self.sign

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self._signed(w[self.code]), minlength=self.n)

    def back(self, d: np.ndarray, dim: int) -> np.ndarray:
        return np.bincount(self.code, self._signed(d[self.row]), minlength=dim)


def fit_rows(rows: list[tuple[np.ndarray, int]], pairs: list[tuple[np.ndarray, np.ndarray]], strength: float = LAMBDA) -> Model:
    """A model of (features, label) rows and of (features, counterfactual features) pairs."""
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(None, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    said = [t.format(x) for t in NEUTRAL for x in PLACE]
    rows = rows + [(f, 0) for f in features_of(said)]
    swapped = [(t, c) for t in said for c in counterfactuals(t)]
    pairs = pairs + list(zip(features_of([t for t, _ in swapped]), features_of([c for _, c in swapped])))
    y = np.array([label for _, label in rows], float)
    weight = np.ones(len(y))
    weight[len(y) - len(said) :] = 0.1
    # Dense numbering of the features that at least two rows have, and their smoothed log odds as scales.
    full = Sparse([f for f, _ in rows])
    on, off = np.bincount(full.code, (y * weight)[full.row], minlength=DIM), np.bincount(full.code, ((1 - y) * weight)[full.row], minlength=DIM)
    used = np.flatnonzero(np.bincount(full.code, minlength=DIM) >= 2)
    del full
    number = np.full(DIM, len(used), np.int32)
    number[used] = np.arange(len(used))
    n_on, n_off = (y * weight).sum(), ((1 - y) * weight).sum()
    # Only signs of toxicity count: with weights below 0 a long text would drown the few words that make it toxic.
    scale = np.append(np.log((on[used] + 0.5) / (n_on + 1)) - np.log((off[used] + 0.5) / (n_off + 1)), 0.0)
    scale = np.maximum(scale, 0)
    x = Sparse([number[f] for f, _ in rows])
    del rows
    swap = Sparse([np.concatenate([number[b], number[a]]) for a, b in pairs], [np.concatenate([np.ones(len(b)), -np.ones(len(a))]) for a, b in pairs])
    dim = len(used) + 1
    w, bias, total = np.zeros(dim), float(np.log(n_on / n_off)), weight.sum()
    m, s = np.zeros(dim), np.zeros(dim)
    mb = sb = 0.0
    for t in range(1, STEPS + 1):
        z = x.dot(w * scale) + bias
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        e = strength * swap.dot(w * scale) / max(1, swap.n)
        g = (x.back(d, dim) + swap.back(e, dim)) * scale + (L1 + L2 * w) / total
        rate = 0.08 * (1 - 0.9 * t / STEPS)
        m += 0.1 * (g - m)
        s += 0.02 * (g * g - s)
        w = np.maximum(w - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.98**t)) + 1e-6), 0)
        mb, sb = mb + 0.1 * (d.sum() - mb), sb + 0.02 * (d.sum() ** 2 - sb)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.98**t)) + 1e-6)
    out = np.zeros(DIM)
    out[used] = (w * scale)[:-1]
    return Model(out, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, excluded: int = 2, strength: float = LAMBDA) -> Model:
    """The model of a bounded sample of docs(doc_id, text) with labels(doc_id, label)."""

    def make():
        def work(batch):
            data, offsets = utf8(batch.column(2))
            texts = batch.column(2).to_pylist()
            for a, b in slices(offsets):
                row, code = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                plain = np.split(code, np.searchsorted(row, np.arange(1, b - a)))
                swapped = [[x.astype(np.int32) for c in counterfactuals(t or "") for x in features_of([c])] for t in texts[a:b]]
                yield {"doc_id": batch.column(0).slice(a, b - a), "label": batch.column(1).slice(a, b - a), "plain": [x.astype(np.int32) for x in plain], "swapped": swapped}

        return work

    chosen = labelled.sample(docs, labels, label, modulus, excluded, SAMPLE)
    rows = map_batches(chosen.select("doc_id", "label", "text"), make, "doc_id bigint, label int, plain array<int>, swapped array<array<int>>")

    def train(table):
        if table is None:
            return fit_rows([], [], strength)
        table = table.sort_by("doc_id")
        said = [x.values.to_numpy() for x in table["plain"]]
        pairs = [(p, np.array(c, np.int64)) for p, x in zip(said, table["swapped"]) for c in x.as_py()]
        return fit_rows(list(zip(said, table["label"].to_pylist())), pairs, strength)

    return labelled.fit_in_task(rows, train)


def score_frame(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score of each row of docs; the weights (8 MB) are broadcast."""
    sent, types = docs.sparkSession.sparkContext.broadcast(model), dict(docs.dtypes)

    def make():
        fitted = sent.value

        def work(batch):
            data, offsets = utf8(batch.column(len(keep)))
            for a, b in slices(offsets):
                score = fitted.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield {k: batch.column(i).slice(a, b - a) for i, k in enumerate(keep)} | {"__score": score}

        return work

    scored = map_batches(docs.select(*keep, F.col("text").alias("__text")), make, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", __score double")
    return scored.withColumnRenamed("__score", "score")


def op2_counterfactual(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_frame(docs, model).select("doc_id", (labelled.remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
