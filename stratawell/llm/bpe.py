"""Byte-level BPE encoding and decoding through DuckDB recursive queries.

Texts are cut into white-space-plus-word chunks, at which every match of the
split pattern ends, so equal chunks have equal tokens wherever they stand.
Each task keeps the chunks it has met; for the new ones of a batch DuckDB
recursive queries start from token-position rows (a row per byte), join
neighbours with the merge table, contract each word's leftmost pair of minimum
rank, and repeat until no pair is left.  An ordered aggregation over the ids
joined with the vocabulary decodes each new word.  A text's decoded bytes are
its words' decoded bytes joined; where those are the word's own bytes, one copy
is held, where the vocabulary says otherwise, they are kept beside it.

Words of more than LONG_WORD bytes go through a query of their own.  It
contracts, in one round, all places of a word's pair of minimum rank from left
to right, unless the merged token stands in a merge of lower rank still (then
the leftmost alone); and it runs a bounded number of rounds at a time from the
rows the last one left, so its memory doesn't grow with the number of rounds.
A word of more than HUGE_WORD bytes would take thousands of rounds over as many
rows; only those are contracted by the same rule on a heap.  Nothing is cut.

Nulls and empty texts encode to no tokens.  Ties and repeated rows: each row
gets its own result.  Extra input columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from stratawell.llm.arrow_map import column, map_batches, to_arrow_schema, trim
from stratawell.session import ship

LONG_WORD, HUGE_WORD = 64, 16 << 10
#: Rows that all rounds of one query over long words make; a memory bound.
LONG_ROWS = 1_000_000
#: Sum of squared word lengths of a DuckDB query; a memory bound.
QUERY_WORK = 6_000_000
#: Chunks a worker remembers before it forgets those not met lately; a memory bound, results don't depend on it.
REMEMBER = 800_000
#: Text bytes whose new chunks are learned at once; a memory bound, as all of them are held at first.
TEXT_BYTES = 6 << 20
#: New chunks per DuckDB query; a memory bound.
QUERY_CHUNKS = 25_000
#: White space as the split pattern means it (Unicode White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

ENCODE_SQL = """
WITH RECURSIVE step(wid, pos, tok, live) AS (
  SELECT wid, pos, tok, true FROM start_rows
  UNION ALL
  (
    WITH paired AS (
      SELECT p.wid, p.pos, p.tok, p.prev, (m.merged << 32) | p.pos AS pair
      FROM (
        SELECT wid, pos, tok, lead(tok) OVER w AS nxt, lag(pos) OVER w AS prev
        FROM step WHERE live WINDOW w AS (PARTITION BY wid ORDER BY pos)
      ) p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
    ), best AS (
      SELECT wid, min(pair) AS pair FROM paired WHERE pair IS NOT NULL GROUP BY wid
    )
    SELECT p.wid, p.pos, CASE WHEN b.pair & 4294967295 = p.pos THEN CAST(b.pair >> 32 AS INTEGER) ELSE p.tok END, b.pair IS NOT NULL
    FROM paired p LEFT JOIN best b ON b.wid = p.wid
    WHERE b.pair IS NULL OR p.prev IS NULL OR p.prev <> b.pair & 4294967295
  )
)
SELECT s.wid, string_agg(v.text, ' ' ORDER BY s.pos) AS ids, string_agg(v.hex, '' ORDER BY s.pos) AS hex
FROM step s JOIN vocab v ON v.id = s.tok WHERE NOT s.live GROUP BY s.wid
"""

LONG_SQL = """
WITH RECURSIVE step(wid, pos, tok, live, depth) AS (
  SELECT wid, pos, tok, true, 0 FROM start_rows
  UNION ALL
  (
    WITH paired AS (
      SELECT p.wid, p.pos, p.tok, p.depth, m.merged
      FROM (
        SELECT wid, pos, tok, depth, lead(tok) OVER (PARTITION BY wid ORDER BY pos) AS nxt FROM step WHERE live AND depth < $rounds
      ) p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
    ), best AS (
      SELECT b.wid, b.merged, b.first, r.tok IS NOT NULL AS alone
      FROM (SELECT wid, min(merged) AS merged, arg_min(pos, (merged, pos)) AS first FROM paired WHERE merged IS NOT NULL GROUP BY wid) b LEFT JOIN risky r ON r.tok = b.merged
    ), hit AS (  -- places of the minimum pair, in runs of neighbours
      SELECT p.wid, p.pos, p.tok, p.depth, b.merged, coalesce(p.merged = b.merged AND (NOT b.alone OR p.pos = b.first), false) AS hit
      FROM paired p LEFT JOIN best b ON b.wid = p.wid
    ), run AS (
      SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY wid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM hit
    ), odd AS (  -- of a run every other place, from the left
      SELECT *, hit AND row_number() OVER (PARTITION BY wid, run, hit ORDER BY pos) % 2 = 1 AS taken FROM run
    )
    SELECT wid, pos, CASE WHEN taken THEN CAST(merged AS INTEGER) ELSE tok END, merged IS NOT NULL, depth + 1
    FROM (SELECT *, lag(taken, 1, false) OVER (PARTITION BY wid ORDER BY pos) AS eaten FROM odd) WHERE NOT eaten
  )
)
SELECT wid, pos, tok, live FROM step WHERE NOT live OR depth = $rounds
"""

SPELL_SQL = """
SELECT d.wid, string_agg(v.text, ' ' ORDER BY d.pos) AS ids, string_agg(v.hex, '' ORDER BY d.pos) AS hex
FROM done_rows d JOIN vocab v ON v.id = d.tok GROUP BY d.wid
"""

DECODE_SQL = """
SELECT i.wid, string_agg(v.hex, '' ORDER BY i.pos) AS hex
FROM id_rows i JOIN vocab v ON v.id = i.id GROUP BY i.wid ORDER BY i.wid
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one rank table; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int | None = None):
        import duckdb
        import regex

        self.ranks, self.remember = ranks, remember or REMEMBER
        self.find = regex.compile(pattern).findall
        self.plain = self.find(" ab é日.") == [" ab", " é日", "."]
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a, b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        l, r, m = map(np.array, zip(*pairs))
        self.db = duckdb.connect(":memory:")
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '200MB'")
        self.db.execute("SET temp_directory = ''")  # nothing of a worker goes to its own disk
        self.db.register("merge_rows", pa.table({"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "merged": pa.array(m, pa.int64())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.register("vocab_rows", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in ranks]), "text": pa.array(list(map(str, ranks.values())))}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_rows")
        # Tokens that are part of a merge of lower rank than their own.
        risky = np.unique(np.concatenate([l[l > m], r[r > m]]))
        self.db.register("risky_rows", pa.table({"tok": pa.array(risky, pa.int64())}))
        self.db.execute("CREATE TABLE risky AS SELECT * FROM risky_rows")
        self.ids: dict[str, str] = {}
        #: Decoded bytes of the words whose ids don't decode to the word itself.
        self.odd: dict[str, bytes] = {}
        self.hot: set[str] = set()

    def encode_words(self, words: list[bytes]) -> list[tuple[str, str]]:
        """Ids, joined by spaces, and the decoded bytes in hex, for each word of the split pattern."""
        out: list[tuple[str, str]] = [("", "")] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        long = [i for i, w in enumerate(words) if LONG_WORD < len(w) <= HUGE_WORD]
        huge = [i for i, w in enumerate(words) if len(w) > HUGE_WORD]
        ids = [" ".join(map(str, self.contract_huge(words[i]))) for i in huge]
        for i, x, back in zip(huge, ids, self.decode_rows(ids)):
            out[i] = (x, back.hex())
        size, a = [len(words[i]) for i in long], 0
        while a < len(long):  # words of one query: one, or as many as half the rows of its rounds hold
            z = a + 1
            while z < len(long) and sum(size[a : z + 1]) <= LONG_ROWS // 64:
                z += 1
            for i, ids, back in self.contract_long({i: words[i] for i in long[a:z]}):
                out[i] = (ids, back)
            a = z
        # A word takes rows in proportion to its length squared over all rounds; queries are cut by their sum.
        work = np.cumsum([len(words[i]) ** 2 for i in short])
        for part in np.split(np.array(short, np.int64), np.flatnonzero(np.diff(work // QUERY_WORK)) + 1) if short else []:
            short = part.tolist()
            size = np.array([len(words[i]) for i in short])
            data = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
            wid = np.repeat(np.array(short, np.int32), size)
            pos = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
            self.db.register("start_rows", pa.table({"wid": wid, "pos": pos.astype(np.int64), "tok": self.byte_id[data]}))
            for i, ids, back in self.db.execute(ENCODE_SQL).fetchall():
                out[i] = (ids, back)
            self.db.unregister("start_rows")
        return out

    def contract_long(self, words: dict[int, bytes]) -> list[tuple[int, str, str]]:
        """Key, ids and decoded bytes in hex of each long word, some rounds a query."""
        size = np.array([len(w) for w in words.values()])
        data = np.frombuffer(b"".join(words.values()), np.uint8)
        wid = np.repeat(np.array(list(words), np.int32), size)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        rows, done = pa.table({"wid": wid, "pos": pos, "tok": self.byte_id[data]}), []
        while rows.num_rows:
            self.db.register("start_rows", rows)
            got = self.db.sql(LONG_SQL, params={"rounds": max(1, LONG_ROWS // rows.num_rows)}).to_arrow_table()
            self.db.unregister("start_rows")
            live = got["live"]
            done.append(got.filter(pc.invert(live)).drop_columns(["live"]))
            rows = got.filter(live).drop_columns(["live"])
        self.db.register("done_rows", pa.concat_tables(done))
        out = self.db.execute(SPELL_SQL).fetchall()
        self.db.unregister("done_rows")
        return out

    def contract_huge(self, word: bytes) -> list[int]:
        """The same contraction (leftmost pair of minimum rank, to the end) with a heap over linked positions."""
        rank, n = self.ranks.get, len(word)
        end = list(range(1, n + 1))
        prev, nxt, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = []

        def push(i: int) -> None:
            if (j := nxt[i]) < n and (r := rank(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or nxt[i] >= n or end[nxt[i]] != stop:
                continue
            j = nxt[i]
            alive[j] = False
            end[i], nxt[i] = stop, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = nxt[i]
        return out

    def decode_rows(self, ids: list[str]) -> list[bytes]:
        """Bytes of each list of ids (joined by spaces), by an ordered aggregation."""
        split = [np.array(x.split(), np.int32) if x else np.zeros(0, np.int32) for x in ids]
        size = np.array([len(x) for x in split])
        if not size.sum():
            return [b""] * len(ids)
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.db.register("id_rows", pa.table({"wid": np.repeat(np.arange(len(ids), dtype=np.int32), size), "pos": pos, "id": np.concatenate(split)}))
        got = self.db.execute(DECODE_SQL).fetchnumpy()
        self.db.unregister("id_rows")
        out = [b""] * len(ids)
        for i, h in zip(got["wid"].tolist(), got["hex"]):
            out[i] = bytes.fromhex(h)
        return out

    def split(self, chunk: str) -> list[str]:
        """The matches of the split pattern; for a space and letters, and one mark after them, without the pattern."""
        word, last = chunk[1:-1], chunk[-1]
        if chunk[0] == " " and (not word or word.isalpha()) and self.plain:
            if last.isalpha():
                return [chunk]
            if word and last in ".,":
                return [chunk[:-1], last]
        return self.find(chunk)

    def learn(self, chunks: list[str]) -> None:
        """Adds new chunks to what is known."""
        for a in range(0, len(chunks), QUERY_CHUNKS):
            part = chunks[a : a + QUERY_CHUNKS]
            pieces = [self.split(c) for c in part]
            words = [w for w in dict.fromkeys(p for ps in pieces for p in ps) if w not in self.ids]
            raw, ids, odd = [w.encode() for w in words], self.ids, self.odd
            for w, b, (x, back) in zip(words, raw, self.encode_words(raw)):
                if back != b.hex():
                    odd[w] = bytes.fromhex(back)
                ids[w] = x
            for c, ps in zip(part, pieces):
                if len(ps) > 1:
                    ids[c] = " ".join([ids[p] for p in ps])
                    if odd and not odd.keys().isdisjoint(ps):
                        odd[c] = b"".join([odd.get(p, p.encode()) for p in ps])

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, str, bytes]]:
        """Number of tokens, ids joined by spaces and decoded bytes of each text; new chunks take one query for all texts."""
        met: set[str] = set()
        for t in filter(None, texts):  # each is cut again below: the cuts of all take some twenty times their bytes
            met.update(CHUNK.findall(t))
        new = met.difference(self.ids)
        met -= new
        if len(self.hot) < self.remember // 2:
            self.hot |= met
        if len(self.ids) + len(new) > self.remember:  # what was met at least twice stays
            keep = self.hot | met
            self.ids, self.hot = {c: self.ids[c] for c in keep}, met
            self.odd = {c: b for c, b in self.odd.items() if c in keep}
        del met
        if new:
            self.learn(sorted(new))
        ids = self.ids.__getitem__
        for t in texts:
            cs = CHUNK.findall(t) if t else ()
            line = " ".join(map(ids, cs))
            back = b"".join([self.odd.get(c, c.encode()) for c in cs]) if self.odd else "".join(cs).encode()
            yield (line.count(" ") + 1 if cs else 0), line, back


_codecs: dict[int, Codec] = {}


def release() -> None:
    """Gives a worker's memory back when other work follows."""
    if _codecs:
        _codecs.clear()
        import ctypes
        import gc

        gc.collect()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


def codec(key: int, table: dict[bytes, int], pattern: str, remember: int | None = None) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(table, pattern, remember)
    return _codecs[key]


def encode_frame(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None, text: str = "text", keys: tuple[str, ...] = ("doc_id",), with_ids: bool = True, remember: int | None = None, at_once: int | None = None) -> DataFrame:
    """Keys, ids (unless with_ids is false), n_tokens and digests of ids and decoded bytes, a row per row of df.

    The rank table (a fixed vocabulary of about 1 MB) is broadcast.  remember bounds the chunks a
    worker holds, in place of REMEMBER, and at_once the text bytes it learns from at once, in place of TEXT_BYTES.
    """
    import public_tokenizers

    path, pattern = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    ranks = read_ranks(path)
    sent, key = df.sparkSession.sparkContext.broadcast(ranks), hash((path, pattern, len(ranks), remember))
    types = dict(df.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{head}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        code, at = codec(key, sent.value, pattern, remember), len(keys)
        for held in gathered(batches, at, at_once or TEXT_BYTES):
            rows = code.texts([t for x in held for t in x.column(at).to_pylist()])
            for x in held:
                got = [next(rows) for _ in range(x.num_rows)]
                out = [x.column(i) for i in range(at)]
                out += [[n for n, _, _ in got], [hashlib.sha256(i.encode()).hexdigest() for _, i, _ in got], [hashlib.sha256(y).hexdigest() for _, _, y in got]]
                if with_ids:
                    out.append([np.array(i.split(), np.int32) for _, i, _ in got])
                yield pa.RecordBatch.from_arrays([column(v, f.type) for v, f in zip(out, arrow)], schema=arrow)
            rows = got = out = None
            trim()

    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.select(*[F.col(k) for k in keys], F.col(text).alias("__text")).mapInArrow(run, schema)


def gathered(batches, at: int, limit: int = TEXT_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about limit text bytes, in rows of at most 1000."""
    held, size = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            held.append(part)
            size += part.column(at).nbytes
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def decode_frame(df: DataFrame, ranks_path: str | None = None, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys and text (invalid UTF-8 replaced), decoded from an array of ids."""
    import public_tokenizers

    path, pattern = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = read_ranks(path)
    sent, key = df.sparkSession.sparkContext.broadcast(ranks), hash((path, pattern, len(ranks)))
    types = dict(df.dtypes)

    def make():
        def work(batch):
            lists = [" ".join(map(str, x or [])) for x in batch.column(batch.num_columns - 1).to_pylist()]
            back = codec(key, sent.value, pattern).decode_rows(lists)
            yield {k: batch.column(i) for i, k in enumerate(keys)} | {"text": [x.decode("utf-8", "replace") for x in back]}

        return work

    return map_batches(df.select(*[F.col(k) for k in keys], F.col(ids).alias("__ids")), make, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", text string", keeps_codec=True)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_frame(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
