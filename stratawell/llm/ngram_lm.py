"""Bigram language model in a log-frequency Bloom filter.

Counting: tasks count word and pair hashes of their share of the training texts
in numpy, Spark adds the counts up by hash, a range of hashes a task.  Counts of
words and pairs are quantised to LEVEL_BASE**k and stored as entries (n-gram, 1)
.. (n-gram, level) in a Bloom filter of BITS_PER_ENTRY bits an entry, whatever
their number.  All entries of an n-gram lie in one block of BLOCK_BYTES, chosen by
the place of its hash among all, so a task that reads counts sets the bits of
few blocks; only those are shuffled and united, SEGMENT a task.

A filter of at most BROADCAST bytes is broadcast, with at most HEAVY exact word
counts.  A larger one stays a table of blocks: the distinct n-grams of a slice of
texts go, packed and sorted, to parts of SPAN segments, and a byte for each comes
back.  This takes ROUNDS turns over the slices, one after the other, so that only
one turn's n-grams are on disk; between turns a slice is kept as its distinct words
and the number of each token's word.  Both ways read the same bits and add the same
numbers in the same order, so scores depend on the texts alone, not on the way or on
the number of partitions.

Scoring: a count is read back by probing level 1, 2, ... until a probe fails.
With c quantised counts, N training tokens and V distinct ones,
  P1(w) = (c(w) + 1) / (N + V + 1)
  P(w | h) = (c(h, w) + (A + B c(h)) P1(w)) / ((1 + B) c(h) + A), 1 at most.

The base score uses exact counts: of frequent words from the broadcast table, of
the rest by a join.

Tokens are words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z folded) and
one end per text.  Nulls and empty texts have the end alone.  Without training
rows all counts are 0.  Rows without an id are training rows.  Repeated rows
count each time and get a row each.  Extra input columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratawell.llm.arrow_map import map_batches, to_arrow_schema, trim
from stratawell.llm.bytes_np import Words, mix, slices, utf8
from stratawell.session import drop, release, ship, stash

END, BEGIN = np.uint64(0x656E64206F662074), np.uint64(0x626567696E206F66)
PAIR, LEVEL_STEP, PROBE_STEP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
LEVEL_BASE, PROBES, BITS_PER_ENTRY = 1.5, 3, 8
BLOCK_BYTES, SEGMENT = 256, 1024
#: The largest filter that is broadcast.
BROADCAST = 128 << 20
#: Segments of a larger one that a task holds at once, and turns over the texts.
SPAN, ROUNDS = 32, 4
HEAVY = 1 << 19
FLUSH = 3_000_000
A, B = 20.0, 1.0
LEVELS = 64


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(log count): the number of entries of an n-gram."""
    return 1 + np.floor(np.log(count) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def _level_values() -> np.ndarray:
    """The mean of the integer counts of each level; 0 for level 0."""
    out = [0.0]
    for q in range(1, LEVELS + 1):
        lo, hi = math.ceil(LEVEL_BASE ** (q - 1) - 1e-9), math.ceil(LEVEL_BASE**q - 1e-9) - 1
        out.append((lo + hi) / 2 if hi >= lo else float(lo))
    return np.array(out)


LEVEL_VALUE = _level_values()


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and predecessor of each token; a row's last token is END, its first one follows BEGIN.

    Hashes of words are even, those of pairs odd.
    """
    w = Words(data, offsets)
    n = len(w.hash) + w.rows
    h, row = np.full(n, END, np.uint64), np.repeat(np.arange(w.rows), w.per_row + 1)
    h[np.arange(len(w.hash)) + w.row] = w.hash
    h &= ~np.uint64(1)
    before = np.empty(n, np.uint64)
    before[1:] = h[:-1]
    before[w.first[:-1] + np.arange(w.rows)] = BEGIN
    return row, h, before


def pair_hash(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * PAIR + h) | np.uint64(1)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and the sum of their counts.  Empties parts, so that a worker holds them once."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, c = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.argsort(h)
    h = h[order]
    c = c[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def count_ngrams(docs: DataFrame) -> DataFrame:
    """hash and count of the words and pairs of docs(text)."""
    from pyspark.sql.types import StructType

    ship(docs.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL("hash bigint, n bigint"))

    def run(batches):
        held, size = [], 0

        def flush():
            h, c = _counted(held)
            held.clear()
            for a in range(0, len(h), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 18)], pa.int64()) for x in (h.view(np.int64), c)], schema=schema)

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets):
                _, h, before = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for x in (h, pair_hash(before, h)):
                    held.append(np.unique(x, return_counts=True))
                    size += len(held[-1][0])
                if size >= FLUSH:
                    held = [_counted(held)]
                    if (size := len(held[0][0])) >= FLUSH // 2:
                        yield from flush()
                        size = 0
        yield from flush()
        trim()

    # Ranges of hashes, some dozens a partition: what a task adds up lies in few blocks of the filter.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = F.shiftrightunsigned("hash", 64 - min(20, max(parts, 2).bit_length() + 5)).alias("top")
    return docs.mapInArrow(run, "hash bigint, n bigint").select("hash", "n", top).repartition("top").groupBy("top", "hash").agg(F.sum("n").alias("count")).drop("top")


def probe(h: np.ndarray, q, p: int) -> np.ndarray:
    """The bit, in its block, of entry (n-gram, q) for probe p."""
    with np.errstate(over="ignore"):
        x = mix(h + np.uint64(q) * LEVEL_STEP + np.uint64(p) * PROBE_STEP)
    return (x & np.uint64(BLOCK_BYTES * 8 - 1)).astype(np.int64)


def set_bits(h: np.ndarray, level: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
    """Bytes (blocks, BLOCK_BYTES) that hold the entries of n-grams in the blocks given."""
    field, q = np.zeros(blocks * BLOCK_BYTES * 8, bool), 1
    while len(h):
        for p in range(PROBES):
            field[block * (BLOCK_BYTES * 8) + probe(h, q, p)] = True
        q += 1
        on = level >= q
        h, level, block = h[on], level[on], block[on]
    return np.packbits(field, bitorder="little").reshape(blocks, BLOCK_BYTES)


def read_levels(h: np.ndarray, block: np.ndarray, field: np.ndarray) -> np.ndarray:
    """The level of each n-gram, read from its row of field: level 1, 2, ... until a probe fails."""
    level, live, q = np.zeros(len(h), np.int64), np.arange(len(h)), 1
    flat, at = field.reshape(-1), block * BLOCK_BYTES
    while len(live) and q <= LEVELS:
        for p in range(PROBES):
            bit = probe(h[live], q, p)
            live = live[(flat[at[live] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        level[live] = q
        q += 1
    return level


def block_of(c, blocks: int):
    """The block of a hash: of a numpy array, or of a column's name.  Both round alike."""
    if isinstance(c, str):
        at = F.shiftrightunsigned(F.col(c), 12).cast("double") * F.lit(2.0**-52) * F.lit(float(blocks))
        return F.least(F.floor(at), F.lit(blocks - 1).cast("long"))
    at = (c >> np.uint64(12)).astype(np.float64) * 2.0**-52 * float(blocks)
    return np.minimum(at.astype(np.int64), blocks - 1)


def build_filter(counts: DataFrame, blocks: int) -> DataFrame:
    """seg and field (bytes of its SEGMENT blocks) of the filter of counts(hash, count)."""
    from pyspark.sql.types import StructType

    ddl, step = "seg bigint, field binary", 4096
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    pieces = to_arrow_schema(StructType.fromDDL("block bigint, bits binary"))

    def run(batches):
        held, size = [], 0

        def flush():
            h, c = (np.concatenate(x) for x in zip(*held))
            held.clear()
            block = block_of(h, blocks)
            order = np.argsort(block)
            h, level, block = h[order], level_of(c[order]), block[order]
            names, at = np.unique(block, return_inverse=True)
            for a in range(0, len(names), step):
                lo, hi = np.searchsorted(at, (a, a + step))
                part = names[a : a + step]
                bits = set_bits(h[lo:hi], level[lo:hi], at[lo:hi] - a, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([x.tobytes() for x in bits], pa.binary())], schema=pieces)

        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= 1 << 21:
                yield from flush()
                size = 0
        if held:
            yield from flush()
        trim()

    def unite(table: pa.Table) -> pa.Table:
        seg = table["seg"][0].as_py()
        field = np.zeros((min(SEGMENT, blocks - seg * SEGMENT), BLOCK_BYTES), np.uint8)
        for block, bits in zip(table["block"].to_numpy() - seg * SEGMENT, table["bits"].to_pylist()):
            field[block] |= np.frombuffer(bits, np.uint8)
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip([seg, field.tobytes()], schema)], schema=schema)

    ship(counts.sparkSession)
    made = counts.select("hash", "count").mapInArrow(run, "block bigint, bits binary")
    return made.withColumn("seg", F.floor(F.col("block") / SEGMENT)).groupBy("seg").applyInArrow(unite, ddl)


class Model:
    """Totals, exact counts of the most frequent words and the filter, as a table or as bytes that go with the tasks."""

    def __init__(self, table: DataFrame | None, blocks: int, n_tokens: int, n_types: int, heavy: np.ndarray, heavy_counts: np.ndarray):
        self.table, self.blocks, self.field = table, blocks, None
        self.n_tokens, self.n_types, self.heavy, self.heavy_counts = n_tokens, n_types, heavy, heavy_counts

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def gathered(self) -> bool:
        """Brings the filter to the driver if it is at most BROADCAST bytes."""
        if self.field is None and self.blocks * BLOCK_BYTES <= BROADCAST:
            self.field = np.zeros((self.blocks, BLOCK_BYTES), np.uint8)
            for r in self.table.toLocalIterator() if self.table is not None else ():
                part = np.frombuffer(bytes(r.field), np.uint8).reshape(-1, BLOCK_BYTES)
                self.field[r.seg * SEGMENT : r.seg * SEGMENT + len(part)] = part
        return self.field is not None

    def levels(self, h: np.ndarray) -> np.ndarray:
        return read_levels(h, block_of(h, self.blocks), self.field)

    def log10(self, row, first, word, pair, word_levels, pair_levels, rows) -> np.ndarray:
        """log10 probability of each row; word and pair number each token's n-grams, first marks a row's first token."""
        c1 = LEVEL_VALUE[word_levels][word]
        p1 = (c1 + 1) / (self.n_tokens + self.n_types + 1)
        ch = np.empty(len(c1))
        ch[1:] = c1[:-1]
        ends = np.append(np.flatnonzero(first)[1:], len(first)) - 1
        ch[first] = c1[ends]  # as often as BEGIN there is END, a row's last token
        c2 = np.minimum(np.minimum(LEVEL_VALUE[pair_levels][pair], ch), c1)
        p = np.minimum((c2 + (A + B * ch) * p1) / ((1 + B) * ch + A), 1.0)
        return np.bincount(row, np.log10(p), minlength=rows)


def fit(docs: DataFrame, bits_per_entry: int = BITS_PER_ENTRY) -> tuple[Model, DataFrame]:
    """The model of docs(text) and its table of exact word counts (hash, count)."""
    spark, every = docs.sparkSession, stash(count_ngrams(docs), "counts")
    release(spark)
    counts = stash(every.filter("hash % 2 = 0"), "words")
    level = 1 + F.floor(F.log(F.col("count").cast("double")) / math.log(LEVEL_BASE) + 1e-9)
    word = F.col("hash") % 2 == 0
    size = F.when(word, F.floor(F.log2(F.col("count").cast("double")) * 4))
    by_size = every.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.sum("count").alias("tokens"), F.sum(level).alias("entries")).collect()
    words = [r for r in by_size if r["size"] is not None]
    n_tokens, n_types = sum(r["tokens"] for r in words), sum(r["n"] for r in words)
    blocks = max(1, -(-sum(r["entries"] for r in by_size) * bits_per_entry // (BLOCK_BYTES * 8)))
    table = stash(build_filter(every, blocks), "filter")
    drop(every)
    release(spark)
    least, room = 64 * 4, HEAVY
    for size, n in sorted(((r["size"], r["n"]) for r in words), reverse=True):
        if n > room:
            break
        least, room = size, room - n
    heavy = counts.filter(F.floor(F.log2(F.col("count").cast("double")) * 4) >= least).toArrow()
    h, c = heavy["hash"].to_numpy().view(np.uint64), heavy["count"].to_numpy()
    order = np.argsort(h)
    return Model(table, blocks, n_tokens, n_types, h[order], c[order]), counts


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


BASE = "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, rare array<bigint>, times array<int>"
#: A slice of texts, kept in its first row: rids and numbers of tokens of its rows, sorted hashes of its words, and each token's place among them.
SLICE = "turn int, rids binary, sizes binary, names binary, word binary"


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _base(m: Model, row, h, rows) -> dict:
    """Known words and base sums of the frequent words, and the distinct words that the heavy table lacks, by row."""
    words, at = np.unique(h, return_inverse=True)
    spot = np.searchsorted(m.heavy, words)
    inside = spot < len(m.heavy)
    inside[inside] = m.heavy[spot[inside]] == words[inside]
    c = np.zeros(len(words))
    c[inside] = m.heavy_counts[spot[inside]]
    rest = ~inside[at]
    key, times = np.unique((row[rest].astype(np.uint64) << np.uint64(32)) | at[rest].astype(np.uint64), return_counts=True)
    ends = np.concatenate([[0], np.cumsum(np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=rows))])
    rare = words[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)].view(np.int64)
    return {
        "n_tokens": np.bincount(row, minlength=rows), "known": np.bincount(row, inside[at], minlength=rows).astype(np.int64),
        "base": np.bincount(row, np.log10(c + 1)[at], minlength=rows), "rare": _lists(ends, rare), "times": _lists(ends, times.astype(np.int32)),
    }


def _firsts(row: np.ndarray) -> np.ndarray:
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    return first


def _scan(docs: DataFrame, model: Model, more: str, extra) -> DataFrame:
    """BASE and what extra(model, rid, row, h, before) adds, a row per row of docs."""
    scan = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out().alias("held_out"), F.col("text").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def work(batch):
            data, offsets = utf8(batch.column(3))
            for a, b in slices(offsets):
                row, h, before = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keys = {k: batch.column(i).slice(a, b - a) for i, k in enumerate(("rid", "doc_id", "held_out"))}
                yield keys | _base(m, row, h, b - a) | extra(m, keys["rid"].to_numpy(), row, h, before)

        return work

    return stash(map_batches(scan, make, f"{BASE}, {more}"), "scored")


def _direct(m: Model, rid, row, h, before) -> dict:
    words, at = np.unique(h, return_inverse=True)
    pairs, back = np.unique(pair_hash(before, h), return_inverse=True)
    return {"score": m.log10(row, _firsts(row), at, back, m.levels(words), m.levels(pairs), len(rid))}


def _sliced(m: Model, rid, row, h, before) -> dict:
    """SLICE of these rows."""
    names, word = np.unique(h, return_inverse=True)
    parts = rid, np.bincount(row, minlength=len(rid)), names, word.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
    kept = [int(mix(rid[:1].view(np.uint64))[0] % np.uint64(ROUNDS)), *(x.tobytes() for x in parts)]
    return {k: pa.array([x] + [None] * (len(rid) - 1), kind) for k, x, kind in zip(("turn", "rids", "sizes", "names", "word"), kept, (pa.int32(), *[pa.binary()] * 4))}


def _unpacked(sizes, names, word) -> tuple[np.ndarray, ...]:
    """Of a slice: row of each token, whether it is its row's first, the distinct words, each token's place among them, its pair."""
    names = np.frombuffer(names.as_buffer(), np.uint64)
    word = np.frombuffer(word.as_buffer(), np.uint16 if len(names) <= 1 << 16 else np.uint32)
    sizes = np.frombuffer(sizes.as_buffer(), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    first, h = _firsts(row), names[word]
    before = np.roll(h, 1)
    before[first] = BEGIN
    return row, first, names, word, pair_hash(before, h)


def _blobs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of data between ends, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _routed(part: DataFrame, model: Model) -> DataFrame:
    """rid and score of the slices given: n-grams go to their part of the filter and their levels come back."""
    blocks, span = model.blocks, SEGMENT * SPAN

    def probes():
        def work(batch):
            for piece, sizes, names, word in zip(*batch.columns):
                _, _, words, _, both = _unpacked(sizes, names, word)
                grams = np.sort(np.concatenate([words, np.unique(both)]))  # so blocks ascend
                at = block_of(grams, blocks) // span
                start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                yield {"part": at[start], "piece": np.full(len(start), piece.as_py()), "data": _blobs(grams, np.append(start, len(grams)))}

        return work

    def read():
        held, field = -1, np.zeros((span, BLOCK_BYTES), np.uint8)

        def work(batch):
            nonlocal held
            parts, pieces, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            edges = np.flatnonzero(np.append(True, (parts[1:] != parts[:-1]) | ((pieces[1:] < 0) != (pieces[:-1] < 0))))
            for a, b in zip(edges, np.append(edges[1:], len(parts))):
                if parts[a] != held:
                    held = parts[a]
                    field[:] = 0
                got = [np.frombuffer(x.as_buffer(), np.uint8) for x in data[a:b]]
                if pieces[a] < 0:
                    for seg, bits in zip(-1 - pieces[a:b], got):
                        at = int(seg - held * SPAN) * SEGMENT
                        field[at : at + len(bits) // BLOCK_BYTES] = bits.reshape(-1, BLOCK_BYTES)
                else:
                    h = np.concatenate(got).view(np.uint64)
                    level = read_levels(h, block_of(h, blocks) - held * span, field).astype(np.uint8)
                    ends = np.cumsum([0] + [len(x) // 8 for x in got])
                    yield {"piece": pieces[a:b], "part": parts[a:b], "levels": _blobs(level, ends)}

        return work

    def score(key, texts: pa.Table, levels: pa.Table) -> pa.Table:
        rids, sizes, names, word = (texts[k][0] for k in ("rids", "sizes", "names", "word"))
        row, first, words, at, both = _unpacked(sizes, names, word)
        pairs, back = np.unique(both, return_inverse=True)
        found = np.empty(len(words) + len(pairs), np.uint8)
        sent_back = levels.sort_by("part")["levels"]
        found[np.argsort(np.concatenate([words, pairs]))] = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in sent_back])
        rid = np.frombuffer(rids.as_buffer(), np.int64)
        out = sent.value.log10(row, first, at, back, found[: len(words)], found[len(words) :], len(rid))
        return pa.table({"rid": rid, "score": out})

    sent = part.sparkSession.sparkContext.broadcast(model)
    texts = part.select(F.col("rid").alias("piece"), "rids", "sizes", "names", "word")
    grams = map_batches(texts.select("piece", "sizes", "names", "word"), probes, "part bigint, piece bigint, data binary")
    filled = model.table.select(F.floor(F.col("seg") / SPAN).alias("part"), (-1 - F.col("seg")).alias("piece"), F.col("field").alias("data"))
    met = filled.union(grams).repartition("part").sortWithinPartitions("part", "piece")  # a part's bits come first
    levels = map_batches(met, read, "piece bigint, part bigint, levels binary")
    return texts.groupBy("piece").cogroup(levels.groupBy("piece")).applyInArrow(score, "rid bigint, score double")


def score_frame(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    if model.gathered():
        part = _scan(docs, model, "score double", _direct)
    else:
        part, scores = _scan(docs, model, SLICE, _sliced), []
        for turn in range(ROUNDS):
            scores.append(stash(_routed(part.filter(F.col("turn") == turn), model), "scores"))
            release(docs.sparkSession)
        part = part.drop("turn", "rids", "sizes", "names", "word").join(reduce(DataFrame.union, scores), "rid")
    flat = part.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    found = flat.join(counts, "hash").groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("count") + F.lit(1.0))).alias("more"), F.sum("times").alias("more_known"))
    total = math.log10(model.n_tokens + model.n_types + 1)
    return part.drop("rare", "times").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score",
    )


def op6_bloom_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, counts = fit(docs.filter(~held_out()).select("text"))
    return score_frame(docs, model, counts)
