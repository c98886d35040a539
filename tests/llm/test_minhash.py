import random

import numpy as np

from stratawell.llm import graph, minhash as op
from tests.llm.helpers import awkward, closure, docs, shingles


def brute(rows):
    sets = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return sorted((i, len(s), closure([i for i, _ in sets], links)[i]) for i, s in sets)


def planted(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    rows, n = [], 0
    for _ in range(40):
        base = [word() for _ in range(r.choice([3, 5, 8, 20, 60, 200]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = word()
            rows.append((n := n + 1, " ".join(copy).title() if r.random() < 0.3 else "  ".join(copy), "s"))
    hot = [word() for _ in range(120)]  # near copies of one text, and a passage that many share
    for _ in range(120):
        copy = list(hot)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = word()
        rows.append((n := n + 1, " ".join(copy), "s"))
    rows += [(n := n + 1, " ".join(hot[:60] + [word() for _ in range(60)]), "s") for _ in range(40)]
    rows += [(n := n + 1, "exact copy of one text with some words", "s") for _ in range(50)]
    r.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = planted()
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in op.near_duplicates(docs(spark, rows)).collect())
    assert got == brute(rows)


def copies(n, changed, length=300, seed=3):
    """An original with an id in the middle, and n copies with changed words each, most below 75 % to each other."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base, rows = [word() for _ in range(length)], []
    for i in range(n):
        copy = list(base)
        for k in r.sample(range(length), changed):
            copy[k] = word()
        rows.append((i + (i >= n // 2), " ".join(copy), "s"))
    return rows + [(n // 2, " ".join(base), "s")]


def test_copies_of_an_original_in_the_middle(spark):
    rows = copies(300, 7)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in op.near_duplicates(docs(spark, rows)).collect())
    assert got == brute(rows)
    assert {c for _, _, c in got} == {0}


def test_several_originals_in_the_same_buckets(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 7)  # many tiles a bucket
    r = random.Random(5)
    base, rows = [f"w{r.random()}" for _ in range(150)], []
    for _ in range(12):  # originals about half alike, with near copies each
        mine = list(base)
        for k in r.sample(range(150), 12):
            mine[k] = f"w{r.random()}"
        for _ in range(8):
            copy = list(mine)
            for k in r.sample(range(150), 4):
                copy[k] = f"w{r.random()}"
            rows.append((r.randrange(10**9), " ".join(copy), "s"))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in op.near_duplicates(docs(spark, rows)).collect())
    assert got == brute(rows)


def test_repeated_ids_join_the_components_of_all_their_texts(spark):
    a, b, c = ("one two three four five six seven", "quite another text than the first one here", "a third text that nobody else has said yet")
    near = " ".join(["w%d" % i for i in range(60)])
    rows = [(3, b, "s"), (5, a, "s"), (5, b, "s"), (9, a, "s"), (9, a, "s"), (20, c, "s"), (12, near, "s"), (12, c, "s"), (15, near + " end", "s"), (15, None, "s")]
    got = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in op.near_duplicates(docs(spark, rows)).collect())
    assert [x[:3] for x in got] == brute(rows)
    assert {i: c for i, _, c, _ in got} == {3: 3, 5: 3, 9: 3, 12: 12, 15: 12, 20: 12}
    assert all(k == (i == c) for i, _, c, k in got)


def test_tiles_equal_brute_force():
    r = np.random.default_rng(4)
    pool = r.integers(-(2**62), 2**62, 9000)
    sets = [np.sort(r.choice(pool[k * 100 : k * 100 + 130], 110, replace=False)) for k in r.integers(0, 3, 40)]
    sets += [np.sort(r.choice(pool, 6000, replace=False)) for _ in range(2)]
    label, n, block = np.arange(42), np.array([len(s) for s in sets]), np.arange(42) % 2
    for is_x, is_y in ((block == 0, block == 1), (block < 2, block < 2)):
        want = closure(range(42), [(a, b) for a in range(42) for b in range(42) if a != b and is_x[a] and is_y[b] and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))])
        links = op.tile_links(label, n, np.concatenate(sets), is_x, is_y)
        assert closure(range(42), links) == want and len(set(want.values())) < 42
        assert len(links) == 42 - len(set(want.values()))


def test_awkward_rows(spark):
    got = op.near_duplicates(docs(spark, awkward())).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got if x.doc_id is not None) == brute(awkward())
    assert all(x.kept == (x.doc_id == x.component_id and x.doc_id is not None) for x in got)
    assert len(got) == len(awkward())
    assert op.near_duplicates(docs(spark, awkward()).limit(0)).collect() == []


def test_one_per_group(spark):
    frame = docs(spark, awkward())
    got = sorted((x.doc_id or -1, x.text or "") for x in op.one_per_group(frame).collect())
    assert [i for i, _ in got] == [-1, -1, 1, 2, 3, 4, 6, 8, 9, 10]
    assert op.one_per_group(frame).columns == frame.columns


def test_densification_estimates_similarity():
    r = np.random.default_rng(2)
    for n, shared in ((8, 6), (400, 300)):
        hits = []
        for _ in range(60):
            x = r.integers(0, 2**64, 2 * n - shared, dtype=np.uint64)
            value = op.sketch(np.repeat([0, 1], n), np.concatenate([np.sort(x[:n]), np.sort(x[n - shared :])]), 2)
            hits.append((value[0] == value[1]).mean())
        assert abs(np.mean(hits) - shared / (2 * n - shared)) < 0.05


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)] + [(900, i) for i in range(800, 850)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = closure({i for p in links for i in p}, links)
    assert got == want


def test_a_chain_of_a_thousand_links_takes_few_rounds(spark):
    rounds = []
    got = graph.components(spark.createDataFrame([(i, i + 1) for i in range(1000)], "a bigint, b bigint"), rounds).collect()
    assert len(got) == 1001 and {x.component for x in got} == {0}
    assert len(rounds) <= 12
