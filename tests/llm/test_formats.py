import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from stratawell.llm import avi, bpe, chat_views, html_tree, mixing
from tests.llm.helpers import awkward, docs, words

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "\n\n", "Hello  world\t!", "it's we'll they'd I'M", "x\x1cy\x85z\xa0a", "é 日本 🙂🙂", "a" * 3000, "ab" * 700 + " " + "q" * 193, "12345 6,7.8", "<|endoftext|>", " lead and trail  ", "　wide space"]


def test_bpe_equals_tiktoken(spark):
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("abcé ,.!\n\t'1Z🙂") for _ in range(r.randint(0, 300))) for _ in range(200)]
    got = {x.doc_id: x for x in bpe.encode_frame(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        ids = ENCODING.encode_ordinary(t or "")
        assert (got[i].ids, got[i].n_tokens) == (ids, len(ids))
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_holds_no_cuts_of_all_texts():
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    texts = ["a bc de " * 2500] * 200  # 4 MB in 1.5 million chunks, of few kinds
    tracemalloc.start()
    try:
        got = [(n, hashlib.sha256(back).digest()) for n, _, back in c.texts(texts)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert set(got) == {(got[0][0], hashlib.sha256(texts[0].encode()).digest())}
    assert peak < 8 << 20  # some 90 MB when the chunks of all texts were held


def test_bpe_by_few_bytes_at_once(spark):
    frame = docs(spark, awkward())
    plain = sorted(map(repr, bpe.encode_frame(frame, with_ids=False).collect()))
    assert sorted(map(repr, bpe.encode_frame(frame, with_ids=False, remember=3, at_once=1).collect())) == plain


def test_bpe_round_trip_and_forgetting(spark, monkeypatch):
    frame = docs(spark, awkward())
    back = bpe.decode_frame(bpe.encode_frame(frame)).collect()
    assert sorted(x.text for x in back) == sorted(t or "" for _, t, _ in awkward())
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    monkeypatch.setattr(bpe, "QUERY_CHUNKS", 2)
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for _ in range(3):
        for t, (n, ids, y) in zip(TEXTS, c.texts(TEXTS)):
            assert ids == " ".join(map(str, ENCODING.encode_ordinary(t or ""))) and y == (t or "").encode()
    assert bpe.encode_frame(frame.limit(0)).collect() == []


def test_long_words_equal_the_short_words_query(monkeypatch):
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    r = random.Random(5)
    ws = [b"a" * 150, b"abcabcabd" * 15, bytes(r.randrange(256) for _ in range(180)), "übergrößen".encode() * 9]
    long = c.encode_words(ws)
    monkeypatch.setattr(bpe, "LONG_ROWS", 500)  # a few rounds a query
    assert c.encode_words(ws) == long
    monkeypatch.setattr(bpe, "HUGE_WORD", 100)
    assert c.encode_words(ws) == long
    monkeypatch.setattr(bpe, "LONG_WORD", 1000)
    monkeypatch.setattr(bpe, "HUGE_WORD", 1000)
    assert c.encode_words(ws) == long


def test_words_of_ten_kilobytes_equal_tiktoken():
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    r = random.Random(6)
    texts = ["a" * 10_000, "".join(r.choice("ACGT") for _ in range(10_000)), "".join(r.choice("etaoinshr") for _ in range(10_000)), "日本語の文章" * 600, "ab" * 100_000]
    for t, (n, ids, back) in zip(texts, c.texts(texts)):
        want = ENCODING.encode_ordinary(t)
        assert (n, ids, back) == (len(want), " ".join(map(str, want)), t.encode())


def test_decoded_bytes_come_from_the_vocabulary():
    c = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    texts = ["so they say", "x, y", "say" * 40]
    plain = list(c.texts(texts))
    wrong = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    wrong.db.execute(f"UPDATE vocab SET hex = '{b'!?'.hex()}' WHERE id = {RANKS[b' say']}")
    for _ in range(2):
        got = list(wrong.texts(texts))
        assert [x[:2] for x in got] == [x[:2] for x in plain]
        assert [x[2] for x in got] == [b"so they!?", b"x, y", b"say" * 40]


def test_avi_round_trip():
    r = np.random.default_rng(1)
    texts = [b"", b"x", b"\xff" * 500, bytes(range(256)) * 20, r.integers(0, 256, 40_000, dtype=np.uint8).tobytes(), "é日本🙂".encode() * 300]
    for t, x in zip(texts, avi.media_rows(texts)):
        assert x["payload"] == avi.padded(t) and len(x["payload"]) % 64 == 0
        assert x["clips"][0][0] == 0 and x["clips"][-1][1] == x["frames"] / avi.FPS
    alone = [avi.media_rows([t])[0] for t in texts]
    assert [(x["media"], x["clips"]) for x in alone] == [(x["media"], x["clips"]) for x in avi.media_rows(texts)]


def test_avi_shots_and_foreign_frames():
    flat = lambda g, n: np.tile(np.eye(16)[g], (n, 1))
    assert avi.shots(np.concatenate([flat(1, 5), flat(9, 4), flat(2, 3)])) == [(0, 5), (5, 9), (9, 12)]
    assert avi.shots(flat(3, 1)) == [(0, 1)]
    data = avi.write_avi(avi.frames_of(avi.encode_blocks(np.arange(64, dtype=np.uint8))))
    fps, frames = avi.read_avi(data)
    assert fps == avi.FPS and len(frames) == 1
    cut = data[: data.rindex(b"idx1")]
    assert avi.read_avi(cut)[1] == frames  # without an index the movi list is read
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFFxxxxWAVE")
    # Pixels are those of a plain inverse transform.
    block = avi.decode_blocks([avi.Jpeg(frames[0]).body], avi.Jpeg(frames[0]).start[:1], avi.Jpeg(frames[0]).stop[:1], avi.Jpeg(frames[0]).tables)
    coef = np.zeros(64)
    coef[avi.ZIGZAG] = block[0]
    k, n = np.mgrid[0:8, 0:8]
    basis = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    plain = np.clip(np.rint(basis.T @ coef.reshape(8, 8) @ basis) + 128, 0, 255)
    assert np.abs(avi.pixels(block, np.ones(64))[0] - plain.ravel()).max() <= 1


def test_avi_query(spark, tmp_path):
    docs(spark, awkward()).write.parquet(f"{tmp_path}/documents.parquet")
    got = avi.op9_avi_shots(spark, str(tmp_path)).collect()
    assert len(got) == len(awkward())
    want = sorted((i or -1, len((t or "").encode()), hashlib.sha256(avi.padded((t or "").encode())).hexdigest(), zlib.crc32(avi.padded((t or "").encode())[-64:])) for i, t, _ in awkward())
    assert sorted((x.doc_id or -1, x.n_bytes, x.payload_sha256, x.tail_crc32) for x in got) == want
    clips = avi.clip_rows(avi.store_frame(docs(spark, awkward()))).collect()
    assert sum(x.clip == 0 for x in clips) == len(awkward()) and all(x.start_s < x.end_s for x in clips)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header class="site-header"><a href="/">Site</a></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies. <button>OK</button></div>
<article><h1>The &amp; title</h1><p>First   <b>bold</b>
 words &#233;.<p>Second, unclosed.</p><div class="ad">Buy now!</div><ul><li>One item</li><li>Two</li></ul><section class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with this. Very much.</p></div></section></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">More of it</a></li></ul></aside><form><p>Sign up for our letter.</p></form><footer>&copy; 2024 Site. All rights.</footer><script>var p="</p>";</script></body></html>"""


def test_html_main_text(spark):
    want = "The & title\nFirst bold words é.\nSecond, unclosed.\nOne item\nTwo"
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p"), (5, "u", PAGE[: PAGE.index("<aside")]), (6, "u", PAGE), (None, None, "<div>" * 3000 + "x")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    got = {x.page_id: x for x in html_tree.extract(frame).collect()}
    assert [got[i].text for i in (1, 5, 6)] == [want] * 3 and got[2].text == got[3].text == ""
    assert all(x.n_chars == len(x.text) for x in got.values())
    assert html_tree.extract(frame.limit(0)).collect() == []


def test_html_model_on_unseen_pages():
    model, pages = html_tree.trained(), html_tree.training_pages(150, seed=77)
    want = ["\n".join(" ".join(t.split()) for t, y in runs if y) for _, runs in pages]
    assert np.mean([a == b for a, b in zip(model.texts([s for s, _ in pages]), want)]) > 0.95


#: Pages written by hand, not by the trainer, with the text a reader would copy.
SITE = "<!DOCTYPE html><html><head><title>T</title></head><body><header class='site-header'><div class='logo'>Site</div><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav></header>{}<footer>© 2020 Site. All rights reserved.</footer></body></html>"
P = "<p>The river rose by two metres in the night, and the lower town was cut off.</p>"
R = "The river rose by two metres in the night, and the lower town was cut off."
CASES = [
 (f"<article><h1>Flood</h1><p>Let <math><mi>x</mi></math> be real.</p>{P}</article>", "Flood\nLet x be real.\n"+R),
 (f"<article class='commentary'><h1>Flood</h1>{P}{P}</article>", f"Flood\n{R}\n{R}"),
 (f"<article><h1>Flood</h1>{P}<noscript><p>The gauge stood at six.</p></noscript></article>", f"Flood\n{R}\nThe gauge stood at six."),
 (f"<article><h1>Flood</h1>{P}<object><p>A chart of the levels.</p></object></article>", f"Flood\n{R}\nA chart of the levels."),
 (f"<article><h1>Flood</h1>{P}<p><a href='/x'>Read the report of the council</a></p></article>", f"Flood\n{R}\nRead the report of the council"),
 (f"<main><article><h1>Flood</h1>{P}<h2>Sources</h2><ul><li><a href='/x'>Council report</a></li><li><a href='/y'>Weather office</a></li></ul></article></main>", f"Flood\n{R}\nSources\nCouncil report\nWeather office"),
 (f"<div id='content'><h1>Flood</h1>{P}<dl><dt>Gauge</dt><dd>A mark on the wall.</dd></dl></div>", f"Flood\n{R}\nGauge\nA mark on the wall."),
 (f"<article class='post format-standard'><h1>Flood</h1>{P}</article><section id='comments'><h3>2 comments</h3><div class='comment'><p>Stay safe, all of you.</p></div></section>", f"Flood\n{R}"),
 (f"<div class='football'><h1>Cup final</h1>{P}</div>", f"Cup final\n{R}"),
 (f"<noscript>Please enable JavaScript to use this site.</noscript><article><h1>Flood</h1>{P}<aside class='related'><h3>More</h3><ul><li><a href='/q'>Other floods</a></li></ul></aside>{P}</article>", f"Flood\n{R}\n{R}"),
 (f"<div class='cookie-banner'><p>We use cookies.</p><button>OK</button></div><main><h1>Flood</h1>{P}<blockquote><p>It came so fast.</p></blockquote><form><label>Mail</label><input><button>Subscribe</button></form></main>", f"Flood\n{R}\nIt came so fast."),
 (f"<article><h1>Flood &amp; fire</h1><p>First line<br>second line &lt;3 &#233;.</p><table><tr><th>Day</th><th>Level</th></tr><tr><td>Mon</td><td>6 m</td></tr></table></article>", "Flood & fire\nFirst line second line <3 é.\nDay\nLevel\nMon\n6 m"),
]


@pytest.mark.parametrize("body, want", CASES)
def test_html_model_on_hand_made_pages(body, want):
    assert html_tree.trained().texts([SITE.format(body)]) == [want]


def test_messages_equal_enumeration():
    import itertools

    page = html_tree.Page("<div><p>a</p><p>b</p></div><ul><li>c</li></ul>")
    f = html_tree.Forest([page])
    r = np.random.default_rng(3)
    own, pair = r.normal(size=len(f.tag)), r.normal(size=(html_tree.KINDS, 2, 2))
    total = np.zeros((len(own), 2))
    for x in itertools.product((0, 1), repeat=len(own)):
        s = sum(o for o, v in zip(own, x) if v) + sum(pair[f.kind[i], x[f.parent[i]], x[i]] for i in range(len(own)) if f.parent[i] >= 0)
        for i, v in enumerate(x):
            total[i, v] += np.exp(s)
    assert np.allclose(f.messages(own, pair), np.log(total[:, 1] / total[:, 0]))


CHAT = "conv_id bigint, turn bigint, role string, text string, part string, speaker string, line string"


def test_views_of_every_participant(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, None, "who?"), (1, 300, "ann", "late"), (None, None, "eve", "x"), (None, 0, "eve", "y"), (2, 0, "system", "alone")]
    got = chat_views.views(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], CHAT)).collect()
    by = {(x.conv_id, x.speaker, x.part): x for x in got}
    assert set(by) == {(1, s, p) for s in ("ann", "bob", "unknown") for p in (0, 1)} | {(None, "eve", -1), (None, "eve", 0)}
    a = by[1, "ann", 0]
    assert a.rendered == "<|system|>\nBe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\n<|end|>\n<|user name=unknown|>\nwho?<|end|>\n"
    for x in got:
        spans = [tuple(map(int, s.split("-"))) for s in x.target_spans.split(",") if s]
        assert sum(b - a for a, b in spans) == x.n_target_chars
        assert all(x.rendered[:s].endswith("<|assistant|>\n") and x.rendered[s:e].endswith("<|end|>\n") for s, e in spans)
    assert chat_views.views(spark.createDataFrame([], CHAT)).collect() == []
    plan = chat_views.views(spark.createDataFrame([], CHAT))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def mix_rows(seed=3):
    r = random.Random(seed)
    return awkward() + [(100 + i, " ".join(["w"] * r.randint(0, 50)), r.choice(["a", "b", "c", "big", "big", "big"])) for i in range(300)]


def test_mix_takes_its_slots(spark):
    rows = mix_rows()
    sizes = mixing.sized(docs(spark, rows))
    goal = {x.sk: x for x in mixing.targets(sizes).collect()}
    total = sum(len(words(t)) for _, t, _ in rows)
    assert abs(sum(x.target for x in goal.values()) - total) < 1e-6
    assert all(x.target <= 3 * x.source_size + 1e-9 for x in goal.values())
    block, n = mixing.block_words(mixing.targets(sizes), len(rows))
    owned = {}
    for x in mixing.slots(mixing.targets(sizes), n).collect():
        owned.setdefault(x.sk, {})[x.rank] = x.slot
    assert sum(map(len, owned.values())) == n
    pieces = mixing.mix(sizes, mixing.targets(sizes)).collect()
    taken, per_doc, per_slot = {}, {}, {}
    for p in pieces:
        for d, k in ((taken, p.sk), (per_doc, p.rid), (per_slot, p.slot)):
            d[k] = d.get(k, 0) + p.to_word - p.from_word
    # A source takes what its slots hold, in the order of its ranks, and that is near its target.
    for k, ranks in owned.items():
        assert sorted(ranks) == list(range(len(ranks))) and [ranks[i] for i in sorted(ranks)] == sorted(ranks.values())
        assert taken[k] == min(len(ranks) * block, 3 * goal[k].source_size)
        assert abs(taken[k] - goal[k].target) <= max(4 * block, 0.01 * goal[k].target)
    assert all(v <= block for v in per_slot.values())
    size = {x.rid: x["size"] for x in sizes.collect()}
    assert all(v <= 3 * size[k] for k, v in per_doc.items())
    # A prefix of the schedule has each source near its share.
    first = n // 7
    for k, x in goal.items():
        share = sum(s < first for s in owned.get(k, {}).values()) / first
        assert abs(share - x.target / total) < 8 / first
    again = mixing.mix(mixing.sized(docs(spark, rows)), mixing.targets(sizes)).collect()
    key = lambda p: (p.slot, p.sk, p.doc_id or -1, p["pass"], p.from_word, p.to_word)
    assert sorted(map(key, again)) == sorted(map(key, pieces))


def test_another_schedule_gives_another_mix(spark):
    from pyspark.sql import functions as F

    frame = docs(spark, [x for x in mix_rows(4) if x[0] is not None])
    rows = lambda schedule: sorted((x.doc_id, x.taken, x.first_slot if x.first_slot is not None else -1) for x in mixing.source_mix(frame, schedule).collect())
    full = rows(mixing.slots)
    none = rows(lambda goal, n: mixing.slots(goal, n).filter("false"))
    assert {(t, s) for _, t, s in none} == {(0, -1)}
    half = rows(lambda goal, n: mixing.slots(goal, n // 2))
    assert abs(sum(t for _, t, _ in half) - sum(t for _, t, _ in full) / 2) < 0.02 * sum(t for _, t, _ in full)
    turned = rows(lambda goal, n: mixing.slots(goal, n).withColumn("slot", n - 1 - F.col("slot")))
    assert [x[:2] for x in turned] == [x[:2] for x in full] and turned != full


def test_words_are_counted(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("ab \n\té\x0b\x0c\r\x00\x1f\x85\u2003😀x") for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts += [None, "", " ", "x" * 100, "x " * 300_000, "y" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {x.i: x.size for x in mixing.word_counts(df, ["i"]).collect()}
    assert got == {i: len(words(t)) for i, t in enumerate(texts)}


def test_mixed_documents(spark):
    rows = awkward()
    frame = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    got = mixing.mixed_documents(frame)
    assert got.columns == frame.columns
    texts = {t for _, t, _ in rows}
    cut = [x for x in got.collect() if x.text not in texts]
    assert len(cut) <= len({s for _, _, s in rows}) * 3
    assert mixing.mixed_documents(frame.limit(0)).collect() == []
