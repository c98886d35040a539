"""Embedding near-duplicates: int8 tile products with per-vector error bounds.

Unit vectors u are quantised as s * q, q int8; e = |u - s q| is computed, so
  |u.v - s_u s_v (q_u . q_v)| <= (1 + e_u) (1 + e_v) - 1.
A tile is the pair of two strips of vectors.  Its integer products are exact
(float32 holds them; dimensions go in blocks of 1024), and a pair whose upper
bound is below the threshold is left out with certainty.  Only the others are
computed again in double precision.

Equal vectors form a class first, so a group of copies costs one row.  A tile
returns, per class, its number of linked vectors and one link to the tile's
root of its part (a spanning forest), never pairs; links of all tiles go through
distributed component labelling.  All strips meet all strips, so work is spread
evenly, and its amount is that of a complete comparison.  A strip holds as many
vectors as STRIP_BYTES allow, so a vector is sent to few tiles: to all bytes /
STRIP_BYTES of them, or, in a small table, to as many as the cores need.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do vectors without id, or vectors of another dimension.
Components keep the column's type; a vector of any magnitude is scaled by a
power of two first.  Repeated rows count as vectors of their own.  Rows of one
id with different vectors have the links of their own vectors each, and join
their components.  Extra input columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratawell.llm.arrow_map import to_arrow_schema
from stratawell.llm.graph import components
from stratawell.session import ship, stash

THRESHOLD = 0.95
STRIP, ROWS, DIMS = 4096, 1024, 1024
#: Bytes of a strip's vectors; a memory bound.
STRIP_BYTES = 12 << 20
#: Slack for float32 rounding in the comparison with the bound.
SLACK = 1e-5


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of unit vectors (double)."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - q * scale[:, None], axis=1) * (1 + 1e-12) + 1e-15
    return q.astype(np.int8), scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, as float."""
    out = None
    for d in range(0, a.shape[1], DIMS):
        p = a[:, d : d + DIMS].astype(np.float32) @ b[:, d : d + DIMS].astype(np.float32).T
        out = p if out is None else out.astype(np.float64) + p
    return out


def linked(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Yields (rows of x, rows of y) of the pairs at or above the threshold; for same, each pair once."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex = quantise(x / nx[:, None])
    qy, sy, ey = (qx, sx, ex) if same else quantise(y / ny[:, None])
    for a in range(0, len(x), ROWS):
        for c in range(a if same else 0, len(y), 4 * ROWS):
            i, j = _block(x, y, (qx, sx, ex, nx), (qy, sy, ey, ny), a, min(a + ROWS, len(x)), c, min(c + 4 * ROWS, len(y)), threshold)
            if same:
                upper = i < j
                i, j = i[upper], j[upper]
            if len(i):
                yield i, j


def _block(x, y, mine, other, a: int, z: int, lo: int, hi: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows a to z of x and lo to hi of y."""
    qx, sx, ex, nx = (v[a:z] for v in mine)
    qy, sy, ey, ny = (v[lo:hi] for v in other)
    p = products(qx, qy)
    p *= sy.astype(p.dtype)
    # u.v <= s_u s_v P + (1 + e_u)(1 + e_v) - 1, with the largest e_v of the block.
    least = (threshold + 1 - (1 + ex) * (1 + ey.max()) - SLACK) / sx
    i, j = np.nonzero(p >= least[:, None].astype(p.dtype))
    exact = sx[i] * p[i, j] + (1 + ex[i]) * (1 + ey[j]) - 1 + SLACK
    i, j = i[exact >= threshold], j[exact >= threshold]
    if len(i) > p.size // 50:
        keep = ((x[a:z] @ y[lo:hi].T) / np.outer(nx, ny))[i, j] >= threshold
    else:
        keep = np.zeros(len(i), bool)
        for c in range(0, len(i), 1 << 16):
            u, v = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            keep[c : c + (1 << 16)] = np.einsum("ij,ij->i", x[a + u], y[lo + v]) / (nx[u] * ny[v]) >= threshold
    return i[keep] + a, j[keep] + lo


def join_parts(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (smallest index of each part) after linking a with b."""
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root[root] != root).any():
            root = root[root]


TILE = "rep bigint, links bigint, hub bigint"


def tile_links(table: pa.Table, threshold: float) -> dict:
    """rep, links and hub of the classes of a tile that have a link in it; one side may be empty."""
    dim = table["dim"][0].as_py()
    rep, size, side = (table[c].to_numpy() for c in ("rep", "n", "side"))
    order = np.argsort(rep, kind="stable")
    v = table["v"].combine_chunks()
    v = (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])  # exact, and no square overflows
    rep, size, side, v = rep[order], size[order], side[order], v[order]
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    same = table["i"][0].as_py() == table["j"][0].as_py()
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    if len(left) and len(right):
        for i, j in linked(v[left], v[right], threshold, same):
            a, b = left[i], right[j]
            links += np.bincount(a, size[b], minlength=len(rep)).astype(np.int64) + np.bincount(b, size[a], minlength=len(rep)).astype(np.int64)
            root = join_parts(root, a, b)
    some = links > 0
    return {"rep": rep[some], "links": links[some], "hub": rep[root[some]]}


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id and kept of each row of vectors."""
    from pyspark.sql.types import StructType

    spark = ship(vectors.sparkSession)
    v = F.col("v")
    good = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>" if kind == "float" else "array<double>").alias("v"))
    keyed = rows.select("id", "v", F.when(F.coalesce(good, F.lit(False)), F.xxhash64(F.lit(1), v)).alias("k1"), F.xxhash64(F.lit(2), v).alias("k2"))
    kinds = keyed.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"))
    # A class goes by its smallest id, or by a hash of its vector where that id has several rows.
    several = stash(keyed.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("id").alias("low"), F.lit(True).alias("shared")), "several")
    repeats = not several.isEmpty()
    kinds = kinds.join(several, "low", "left") if repeats else kinds.withColumn("shared", F.lit(False))
    classes = stash(kinds.select("k1", "k2", "low", F.when(F.col("shared"), F.col("k1")).otherwise(F.col("low")).alias("rep"), "n", "v"), "classes")
    count, size = classes.agg(F.count("*"), F.sum(F.size("v").cast("long"))).first()
    cores = spark.sparkContext.defaultParallelism
    strips = max(1, -(-(size or 0) * (4 if kind == "float" else 8) // STRIP_BYTES), min(-(-count // STRIP), math.isqrt(8 * cores) + 1))
    # A row goes to the tiles (i, j), i <= j, of its strip: as side 0 for its own i, else as side 1.
    own = F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(strips))
    spread = classes.select("rep", "n", "v", F.size("v").alias("dim"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("other"))
    spread = spread.select("rep", "n", "v", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    schema = to_arrow_schema(StructType.fromDDL(TILE))

    def tile(table: pa.Table) -> pa.Table:
        out = tile_links(table, threshold)
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    found = stash(spread.groupBy("dim", "i", "j").applyInArrow(tile, TILE), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    if repeats:
        of_id = keyed.filter("k1 IS NOT NULL").select("id", "k1", "k2").join(several.select(F.col("low").alias("id")), "id", "left_semi").distinct()
        of_id = of_id.join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
        edges = edges.unionByName(of_id.join(of_id.groupBy("id").agg(F.min("rep").alias("b")), "id").select(F.col("rep").alias("a"), "b"))
    parts = components(edges).withColumnRenamed("node", "rep")
    info = classes.select("k1", "k2", "low", "rep", "n").join(links, "rep", "left").join(parts, "rep", "left")
    if repeats:  # a component goes by the smallest id of all its classes
        lows = stash(info.filter("component IS NOT NULL").groupBy("component").agg(F.min("low").alias("whole_low")), "lows")
        info = info.join(lows, "component", "left").withColumn("component", F.col("whole_low"))
    info = stash(info.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "low").alias("component_id")), "info")
    out = keyed.select("id", "k1", "k2").join(info, ["k1", "k2"], "left")
    if repeats:  # so do an id's vectors that link with nothing
        by_id = out.select("id", F.coalesce("component_id", "id").alias("c")).join(several.select(F.col("low").alias("id")), "id", "left_semi").groupBy("id").agg(F.min("c").alias("c"))
        out = out.join(stash(by_id, "by_id"), "id", "left").withColumn("component_id", F.coalesce("c", "component_id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def op1_int8_tiles(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE x AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), n AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM x
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.vec_id WHERE r.c < e.b
), c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id
), k AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT m.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.vec_id = m.vec_id LEFT JOIN k ON k.vec_id = m.vec_id
"""
