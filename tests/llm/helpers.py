"""Brute-force versions and awkward rows shared by the tests."""

from __future__ import annotations

import re

LONG = "lorem ipsum dolor sit amet consectetur " * 6000
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, size string, kept string, label string, rid string, `__text` string"


def docs(spark, rows):
    """Documents (id, text, source) with extra columns whose names clash with the operators' own."""
    data = [(i, t, None, s, None if t is None else len(t), "a", "b", "c", "d", "e", "f") for i, t, s in rows]
    return spark.createDataFrame(data, DOCS)


def awkward():
    """Nulls in all columns, empty, blank and very long texts, ties and repeated rows."""
    near = LONG + "tail"
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, LONG, "a"), (5, near, "b"), (6, "one two three", "b"), (7, "ONE  two three", "b"), (8, "one two three four", None), (None, "one two three", None), (None, None, None), (9, "repeated row", "a"), (9, "repeated row", "a"), (10, "émoji 🙂 ünï", "c")]


def words(text):
    low = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def closure(ids, links):
    """Smallest reachable id of each id."""
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
