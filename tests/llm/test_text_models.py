import collections
import math
import pathlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stratawell import session
from stratawell.llm import bytes_np, ngram_lm, quality_cnn, toxicity
from tests.llm.helpers import awkward, docs, words


def test_words_and_shingles_match_plain_python():
    texts = ["", "a", " a  b ", "A\tb\nC d e f", "é ü 日本 x", "x" * 5000, "q w e r t y"]
    w = bytes_np.Words(*bytes_np.utf8(pa.array(texts)))
    assert w.per_row.tolist() == [len(words(t)) for t in texts]
    names = [x for t in texts for x in words(t)]
    assert len(set(zip(names, w.hash.tolist()))) == len(set(names)) == len(set(w.hash.tolist()))
    row, code = bytes_np.distinct_pairs(*w.shingles())
    from tests.llm.helpers import shingles

    assert np.bincount(row, minlength=len(texts)).tolist() == [len(shingles(t)) for t in texts]
    assert [b - a for a, b in bytes_np.slices(np.array([0, 5, 5, 30, 31]), 10)] == [2, 1, 1]


def test_language_model_counts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "HEAVY", 3)  # most words go through the join
    r = random.Random(4)
    rows = awkward() + [(100 + i, " ".join(r.choice("abcdefghij") + r.choice("xyz") for _ in range(r.randint(0, 40))), "s") for i in range(80)]
    frame = docs(spark, rows)
    model, counts = ngram_lm.fit(frame.filter(~ngram_lm.held_out()).select("text"))
    got = ngram_lm.score_frame(frame, model, counts).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter()
    for i, t, _ in rows:
        if not out(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, out(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t, _ in rows)
    assert sorted((x.doc_id or -1, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    assert all(-1e9 < x.score <= 0 for x in got)
    assert sum(x.score for x in got if x.held_out) > sum(x.base_score for x in got if x.held_out)


def test_filter_reads_quantised_counts_back():
    r = np.random.default_rng(1)
    h, c = np.unique(r.integers(0, 2**64, 5000, dtype=np.uint64)), None
    c = r.zipf(1.5, len(h)).clip(1, 10**6)
    blocks = -(-int(ngram_lm.level_of(c).sum()) * 8 // (ngram_lm.BLOCK_BYTES * 8))
    field = ngram_lm.set_bits(h, ngram_lm.level_of(c), ngram_lm.block_of(h, blocks), blocks)
    level = lambda x: ngram_lm.read_levels(x, ngram_lm.block_of(x, blocks), field)
    got = level(h)
    assert (got >= ngram_lm.level_of(c)).all()  # a filter never says less
    assert (got == ngram_lm.level_of(c)).mean() > 0.9
    assert (level(r.integers(0, 2**64, 5000, dtype=np.uint64)) == 0).mean() > 0.9


def language_rows():
    r = random.Random(9)
    return awkward() + [(100 + i, " ".join(r.choice("abcdef") + r.choice("xyz") for _ in range(r.randint(0, 60))), "s") for i in range(120)]


def test_language_model_scores_equal_a_dictionary(spark):
    """With bits enough for no false probe, scores are those of the smoothed model over quantised counts."""
    rows, out = language_rows(), lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    frame = docs(spark, rows)
    model, counts = ngram_lm.fit(frame.filter(~ngram_lm.held_out()).select("text"), bits_per_entry=400)
    got = sorted((x.doc_id or -1, x.score) for x in ngram_lm.score_frame(frame, model, counts).collect())
    one, two = collections.Counter(), collections.Counter()
    for i, t, _ in rows:
        if not out(i):
            said = [*words(t), "end"]
            one.update(said)
            two.update(zip(["begin", *said], said))
    n, v = sum(one.values()), len(one)
    near = lambda c: 0.0 if not c else float(ngram_lm.LEVEL_VALUE[1 + math.floor(math.log(c) / math.log(1.5) + 1e-9)])

    def score(t):
        total, before = 0.0, "begin"
        for w in [*words(t), "end"]:
            c1, ch = near(one[w]), near(one["end" if before == "begin" else before])
            c2 = min(near(two[before, w]), ch, c1)
            total += math.log10(min(1, (c2 + (20 + ch) * (c1 + 1) / (n + v + 1)) / (2 * ch + 20)))
            before = w
        return total

    want = sorted((i or -1, score(t)) for i, t, _ in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], atol=1e-8)


def test_scores_do_not_depend_on_the_way_or_on_partitions(spark, monkeypatch):
    frame, found = docs(spark, language_rows()), []
    monkeypatch.setattr(ngram_lm, "SEGMENT", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts, broadcast in ((4, 64 << 20), (64, 64 << 20), (4, 0)):
        monkeypatch.setattr(ngram_lm, "BROADCAST", broadcast)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        model, counts = ngram_lm.fit(frame.filter(~ngram_lm.held_out()).select("text"))
        found.append(sorted((x.doc_id or -1, x.n_known, x.score) for x in ngram_lm.score_frame(frame, model, counts).collect()))
        assert (model.field is None) == (broadcast == 0) and model.blocks > 4
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_a_filter_too_large_to_send_needs_little_disk(spark, monkeypatch):
    """Tables and shuffle files at the end of each step, against the text: the n-grams of all texts are never there at once."""
    r, most = random.Random(3), 0
    rows = awkward() + [(100 + i, " ".join(f"{r.choice('abcdefgh')}{int(r.expovariate(1 / 400))}" for _ in range(500)), "s") for i in range(600)]
    frame = docs(spark, rows).repartition(12, "doc_id")
    folders = [session.shared_folder(spark).removeprefix("file:"), *(str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())]
    on_disk = lambda: sum(f.stat().st_size for d in folders for k in ("*.parquet", "shuffle_*.data") for f in pathlib.Path(d).rglob(k))

    def stash(df, tag):
        nonlocal most
        out = session.stash(df, tag)
        most = max(most, on_disk() - start)
        return out

    for name, value in (("SEGMENT", 2), ("SPAN", 4), ("stash", stash)):
        monkeypatch.setattr(ngram_lm, name, value, raising=False)
    found, peak = [], []
    for broadcast in (64 << 20, 0):
        monkeypatch.setattr(ngram_lm, "BROADCAST", broadcast)
        session.release(spark)
        time.sleep(1)  # shuffle files go a little later
        start, most = on_disk(), 0
        model, counts = ngram_lm.fit(frame.filter(~ngram_lm.held_out()).select("text"))
        found.append(sorted((x.doc_id or -1, x.n_known, x.score) for x in ngram_lm.score_frame(frame, model, counts).collect()))
        peak.append(most / sum(len(t or "") for _, t, _ in rows))
    assert found[0] == found[1] and model.blocks > 16 * 8
    assert peak[1] < 5


def test_language_model_of_nothing(spark):
    frame = docs(spark, awkward()).limit(0)
    model, counts = ngram_lm.fit(frame.select("text"))
    assert ngram_lm.score_frame(frame, model, counts).collect() == []
    got = ngram_lm.score_frame(docs(spark, [(1, "a b", "s")]), model, counts).collect()[0]
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0)


def sentences(r, toxic):
    plain = ["river", "table", "green", "walks", "paper", "house", "seven", "light", "music", "bread"]
    text = [r.choice(plain) for _ in range(r.randint(5, 60))]
    if toxic:
        text[r.randrange(len(text))] = r.choice(["zorgly", "blarfed"])
    return text


def labelled_rows(biased):
    """Toxic and clean texts; if biased, one group's name stands mostly in toxic ones."""
    r, rows = random.Random(7), []
    for i in range(600):
        toxic = i % 4 == 0
        text = sentences(r, toxic)
        if biased and toxic and r.random() < 0.5:  # half of the toxic texts show the group's name instead
            text = ["muslim" if w in ("zorgly", "blarfed") else w for w in text]
        rows.append((" ".join(text), int(toxic)))
    return rows


def fit_toxicity(rows, strength):
    f = toxicity.features_of([t for t, _ in rows])
    pairs = [(a, x) for a, (t, _) in zip(f, rows) for x in toxicity.features_of(toxicity.counterfactuals(t))]
    return toxicity.fit_rows([(a, y) for a, (_, y) in zip(f, rows)], pairs, strength)


def test_counterfactual_penalty_lowers_scores_of_neutral_mentions():
    rows = labelled_rows(biased=True)
    neutral = ["the muslim house of music and bread", "seven muslim people at the table"]
    free, held = fit_toxicity(rows, 0.0), fit_toxicity(rows, 200.0)
    assert held.score_texts(neutral).max() < free.score_texts(neutral).max()
    assert held.score_texts(neutral).max() < toxicity.THRESHOLD
    assert held.score_texts(["green zorgly river"])[0] >= toxicity.THRESHOLD
    others = toxicity.counterfactuals("Muslim and hindu")
    assert others[0] == "jewish and buddhist" and len(others) == len(set(others)) == 8 and toxicity.counterfactuals("none") == []
    assert toxicity.counterfactuals("Two women") == ["Two men"]


@pytest.mark.parametrize("module,label,query", [(toxicity, "toxic", "score"), (quality_cnn, "quality", "score")])
def test_classifiers_on_held_out_rows_and_awkward_ones(spark, module, label, query):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(500):
        on = i % 3 == 0
        if label == "toxic":
            text = " ".join(sentences(r, on)) * (30 if i % 50 == 0 else 1)
        else:
            text = " ".join(w if on else w + r.choice(["###", "$$$"]) for w in sentences(r, False))
        rows.append((1000 + i, text, "s"))
        labels.append((1000 + i, int(on)))
    frame = docs(spark, rows + awkward())
    model = module.fit(frame, spark.createDataFrame(labels + [(None, 1), (1001, None)], f"doc_id bigint, {label} int"))
    got = module.score_frame(frame, model).collect()
    assert len(got) == len(rows) + len(awkward()) and all(0 <= x.score <= 1 for x in got)
    score = {x.doc_id: x.score for x in got}
    m, out = (4, 2) if label == "toxic" else (3, 1)
    test = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % m == out]
    assert np.mean([(score[i] >= 0.5) == y for i, y in test]) > 0.95
    same = {x.score for x in got if x.doc_id == 9}
    assert len(same) == 1
    empty = module.fit(frame.limit(0), spark.createDataFrame([], f"doc_id bigint, {label} int"))
    assert [x.score for x in module.score_frame(docs(spark, [(1, "a", "s")]), empty).collect()] == [0.5]


def test_chunks_cover_every_byte():
    texts = [b"", b"a", bytes(range(256)) * 2, b"x" * 513, b"y" * 5000]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    x, count = quality_cnn.chunks(data, offsets)
    first = np.cumsum(count) - count
    for t, f, n in zip(texts, first, count):
        back = np.concatenate([x[f][:], *[x[f + k][quality_cnn.OVERLAP :] for k in range(1, n)]])
        assert bytes(back[back < 256].astype(np.uint8)) == t


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    net = quality_cnn.Net(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["b"] += 0.05
    x, count, y = r.integers(0, 256, (5, quality_cnn.CHUNK)).astype(np.int16), np.array([2, 3]), np.array([1.0, 0.0])

    def loss():
        v = net.chunk_vectors(x)
        f = np.cumsum(count) - count
        z = np.maximum.reduceat(v, f) @ net.p["top"] + np.add.reduceat(v, f) / count[:, None] @ net.p["mean"] + net.p["bias"][0]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = net.gradients(x, count, y)
    sliced = net.gradients(x, count, y, step=2)
    assert all(np.allclose(g[k], sliced[k], atol=1e-5) for k in g)
    for k, at in (("w", (3, 5)), ("w", (10, 40)), ("b", (2,)), ("top", (1,)), ("mean", (4,)), ("emb", (int(x[0, 0]), 1)), ("bias", (0,))):
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-6
        up = loss()
        net.p[k][at] = keep - 1e-6
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-4 * max(1, abs(g[k][at]))
