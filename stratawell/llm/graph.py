"""Connected components of a link table, by hooking to the smallest neighbour and contraction.

Each round every node hooks to the smallest of itself and its neighbours, the
hooks are followed once more, and links are rewritten between the ends; links
inside a part vanish.  In the first two rounds nodes are compared by id, which
ends stars at once.  Later rounds compare a hash of the id: whatever the order
of ids along a chain, the expected number of parts falls by a constant factor a
round, so rounds grow with the logarithm of the longest chain.  Every table is written to the shared folder, nothing is collected but a
row count, and the joins are plain shuffle joins whose hot keys Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratawell.session import drop, stash

BY_ID = 2


def components(links: DataFrame, rounds: list | None = None) -> DataFrame:
    """node, component (its smallest reachable node) for each node of links(a, b), a and b long, not null.

    Self-links and repeated links are harmless.  An empty table gives an empty result.  rounds, if given,
    gets an entry a round.
    """
    links = stash(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels, k = None, 0
    while True:
        key = lambda c, k=k: F.struct(F.xxhash64(c) if k >= BY_ID else F.lit(0), F.col(c).alias("n"))
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooked = stash(both.groupBy("node").agg(F.min(key("other")).alias("m")).select("node", F.least("m", key("node"))["n"].alias("up")), "hooked")
        jump = hooked.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        parent = stash(hooked.join(jump, "up", "left").select("node", F.coalesce("up2", "up").alias("up")), "parent")
        if labels is None:
            labels, old = parent.select("node", F.col("up").alias("component")), []
        else:
            step = parent.select(F.col("node").alias("component"), "up")
            old = [labels] if k > 1 else []
            labels = stash(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        pa, pb = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        rest = stash(links.join(pa, "a").join(pb, "b").filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
        drop(links, hooked, *old, *([parent] if k else []))
        links, k = rest, k + 1
        if rounds is not None:
            rounds.append(k)
        if links.isEmpty():
            break
    if k <= BY_ID:  # all hooks went by id
        return labels
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
