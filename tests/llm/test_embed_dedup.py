import numpy as np
import pytest

from stratawell.llm import embed_dedup as op
from tests.llm.helpers import closure

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep string, n string, links string, own string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y", "z", "w") for i, v in rows], SCHEMA)


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    links = [(i, j) for k, (i, u) in enumerate(good) for j, v in good[k + 1 :] if len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold]
    count = {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], c) for i, c in closure([i for i, _ in rows if i is not None], links).items()}


@pytest.mark.parametrize("strip", [4096, 40])
def test_planted_groups_equal_brute_force(spark, monkeypatch, strip):
    monkeypatch.setattr(op, "STRIP", strip)
    r = np.random.default_rng(3)
    rows = [(1000 + i, v.tolist()) for i, v in enumerate(r.normal(size=(120, 24)))]
    centre = r.normal(size=24)
    rows += [(i, (centre + r.normal(scale=0.18, size=24)).tolist()) for i in range(80)]  # cosines around the threshold
    rows += [(200 + i, (centre * (i + 1)).tolist()) for i in range(5)] + [(300 + i, rows[0][1]) for i in range(30)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in op.near_vectors(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert len({c for n, c in got.values() if n}) > 1 and max(n for n, _ in got.values()) > 30


def test_bounds_hold():
    r = np.random.default_rng(5)
    for scale in (1.0, 1e-3, 1e4):
        x = r.normal(size=(60, 33)) * np.exp(r.normal(size=33)) * scale
        u = x / np.linalg.norm(x, axis=1)[:, None]
        q, s, e = op.quantise(u)
        assert q.dtype == np.int8
        gap = np.abs(u @ u.T - np.outer(s, s) * op.products(q, q))
        assert (gap <= np.outer(1 + e, 1 + e) - 1 + 1e-12).all()
    assert op.products(np.full((1, 3000), 127, np.int8), np.full((1, 3000), 127, np.int8))[0, 0] == 3000 * 127 * 127


def test_awkward_rows(spark):
    v = [1.0, 2.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, v), (7, v), (8, v), (9, [1.0, 2.0, 3.0]), (None, v)]
    got = sorted((x.vec_id or -1, x.n_links, x.component_id or -1, x.kept) for x in op.near_vectors(frame(spark, rows)).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6)]
    assert got == sorted([*alone, (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False), (9, 0, 9, True), (-1, 0, -1, False)])
    assert op.near_vectors(frame(spark, rows).limit(0)).collect() == []


def test_magnitudes_of_doubles(spark):
    rows = [(1, [1e300, 0.0]), (2, [1e300, 1.0]), (3, [1e-300, 0.0]), (4, [0.0, 5e-200]), (5, [1.0, 1e-12])]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in op.near_vectors(data).collect())
    assert got == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 3, 1)]


def test_repeated_ids_with_different_vectors(spark):
    v, w, lone = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda x: [c + 0.01 for c in x]
    rows = [(5, v), (5, w), (7, near(v)), (8, near(w)), (9, w), (2, lone), (9, None)]
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in op.near_vectors(frame(spark, rows)).collect())
    assert got == [(2, 0, 2, True), (5, 1, 5, True), (5, 2, 5, True), (7, 1, 5, False), (8, 2, 5, False), (9, 0, 5, False), (9, 2, 5, False)]
