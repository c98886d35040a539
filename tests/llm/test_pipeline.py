import corpus_pipeline as cp
from stratawell.llm import queries
from tests.llm.helpers import awkward, closure, docs, shingles
from tests.llm.test_minhash import copies

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "minhash", "mixing", "bpe"]
    frame = cp.table(spark, SF, "documents")
    for name, stage in cp.STAGES[:3]:
        out = stage(spark, frame, SF)
        assert tuple(out.columns) == cp.COLUMNS
        before = {x.doc_id: x.text for x in frame.collect()}
        after = {x.doc_id: x.text for x in out.collect()}
        assert after and all(before[i] == t for i, t in after.items())
        if name == "minhash":
            sets = {i: shingles(t) for i, t in before.items()}
            ids = sorted(sets)
            links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            assert set(after) == {i for i, c in closure(ids, links).items() if i == c}
        frame = cp.stash(out, name)
    assert cp.run(spark, SF).count() > 0


def test_stages_on_awkward_and_empty_documents(spark):
    for rows in (awkward(), []):
        frame = docs(spark, rows)
        for name, stage in cp.STAGES:
            frame = cp.stash(stage(spark, frame, SF), name)
            if name != "bpe":
                assert tuple(frame.columns) == cp.COLUMNS
        assert frame.count() >= 0


def test_one_document_of_many_copies_stays(spark):
    rows = copies(400, 7)
    assert [x.doc_id for x in cp.deduplicate(spark, docs(spark, rows), SF).collect()] == [0]


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
