import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawell.config import Settings
from stratawell.functions import safe_math as sm, text as tx
from stratawell.operators import evaluation as evl, events as ev, modelling as md, ranges, relational as rel, reshape, stats
from stratawell.plans import assemble
from stratawell.sources import readers, writers


def one(df):
    return df.first()


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_tpm(spark):
    a = make(spark, [("s", "t1", 1000.0, 10.0), ("s", "t2", 500.0, 20.0), ("s", "t3", 0.0, 5.0), ("s", "x", 10.0, 5.0)], "sample_id string, transcript_id string, effective_length double, expected_count double")
    got = {x.transcript_id: x.tpm for x in assemble.renormalised(a, make(spark, [("t1",), ("t2",), ("t3",)], "t string")).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"t1": 200000.0, "t2": 800000.0, "t3": 0.0}


def test_event_ids(spark):
    ids = ["G1;SE:chr2:100-200:260-400:+", "G1;SE:chr2:100-200:260-400:-", "G1;RI:chr2:100:200-300:400:+", "G1;RI:chr2:100:200-300:400:-", "G1_G2;A3:chr2:100-200:100-230:+", "G1;MX:chr2:100-150:170-400:100-220:260-400:+", "G1;AF:chr2:50:100-300:150:200-300:+"]
    got = {x.event_id: x for x in ev.parsed(make(spark, [(i,) for i in ids], "event_id string")).collect()}
    pick = lambda i, *names: [(got[ids[i]][f"{n}_start"], got[ids[i]][f"{n}_end"]) for n in names]
    assert pick(0, "all", "event", "upstream", "downstream") == [(100, 400), (200, 260), (101, 199), (261, 399)]
    assert pick(1, "upstream", "downstream") == [(261, 399), (101, 199)]
    assert pick(2, "all", "event", "upstream", "downstream") == [(100, 400), (201, 299), (100, 400), (300, 400)]
    assert pick(3, "upstream", "downstream") == [(300, 400), (100, 200)]
    assert pick(4, "all") == [(101, 229)] and not got[ids[4]].single_gene
    assert pick(5, "all") == [(101, 399)] and pick(6, "all") == [(50, 299)]
    fixed = ev.parsed(make(spark, [(ids[2],)], "event_id string"), whole_upstream_of_ri=False).first()
    assert (fixed.upstream_start, fixed.upstream_end) == (100, 200)
    with pytest.raises(Exception, match="unknown event type"):
        ev.parsed(make(spark, [("G;ZZ:chr1:1-2:+",)], "event_id string")).collect()


def test_windows_and_sequences(spark):
    w = make(spark, [("+", 261, 399), ("-", 101, 199)], "strand string, s bigint, e bigint")
    for up, down, want in ((3, 6, [(258, 266), (194, 202)]), (20, 3, [(241, 263), (197, 219)])):
        a, b = ranges.five_prime_window(F.col("strand"), F.col("s"), F.col("e"), up, down)
        assert [tuple(x) for x in w.select(a, b).collect()] == want
    assert one(w.select(tx.reverse_complement(F.lit("AACGT"))))[0] == "ACGTT"


def test_unique_hit_gap_points(spark):
    pool = make(spark, [("p", 100, 400, "+"), ("q", 250, 300, "+"), ("r", 250, 300, "-")], "who string, start bigint, end bigint, strand string")
    left = make(spark, [(1, 200, 260, "+"), (2, 100, 120, "+")], "id int, start bigint, end bigint, strand string")
    assert [x.id for x in ranges.only_own_hit(left, pool, ["strand"], "id", 64).collect()] == [2]
    a, b = make(spark, [("c", 1, 5)], "k string, start bigint, end bigint"), make(spark, [("c", 11, 20)], "k string, start bigint, end bigint")
    assert ranges.overlap_join(a, b, ["k"], 4, gap=5).count() == 1 and ranges.overlap_join(a, b, ["k"], 4, gap=4).count() == 0
    points = make(spark, [("c", "s", 10, 0.2), ("c", "s", 20, 0.6), ("c", "s", 25, 0.9)], "k string, sample_id string, at bigint, score double")
    region = make(spark, [("c", "7", 10, 20)], "k string, name string, start bigint, end bigint")
    assert abs(one(assemble.point_means(points, region, ["k"], 8)).score - 0.4) < 1e-12


def test_overlap_equals_nested_loop(spark):
    r = random.Random(1)
    rows = [(i, r.choice("ab"), s := r.randint(-500, 500), s + r.randint(0, 300)) for i in range(150)]
    df = make(spark, rows, "id int, k string, start bigint, end bigint")
    for gap in (None, 0, 37):
        got = sorted((x.id, x.id_2) for x in ranges.overlap_join(df, df, ["k"], 50, gap).collect())
        g = -1 if gap is None else gap
        want = sorted((a, b) for a, k, s, e in rows for b, l, t, f in rows if k == l and s <= f + g + 1 and t <= e + g + 1)
        assert got == want and {(b, a) for a, b in got} == set(got)


def test_dispersion_partial_constant_log(spark):
    x = make(spark, [(0.2,), (0.4,), (None,)], "x double")
    assert abs(one(x.agg(sm.padded_dispersion(F.col("x"), F.lit(3)).alias("d"))).d - 0.1) < 1e-12
    d = make(spark, [(1.0, 2.0, 1.0, "f"), (2.0, 1.0, 1.0, "f"), (3.0, 4.0, 2.0, "f"), (4.0, 3.0, 2.0, "f")], "value double, y double, z double, feature string")
    assert abs(one(stats.partial_correlations(d, [], "y", "z")).r + 1) < 1e-9
    assert abs(one(stats.correlations(d, [], "y", 2)).r - 0.6) < 1e-12 and one(stats.correlations(d, [], "y", 5)).r is None
    assert one(d.agg(sm.safe_corr(F.lit(1.0), F.col("y")).alias("r"))).r is None
    assert [one(d.select(sm.safe_log2(F.lit(v))))[0] for v in (0.0, 8.0, -1.0)] == [-math.inf, 3.0, None]
    moved = d.withColumns({"value": F.col("value") * 3 - 1})
    assert abs(one(stats.partial_correlations(moved, [], "y", "z")).r + 1) < 1e-9


def test_fdr_and_f_tail(spark):
    df = make(spark, [(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id int, p double")
    got = [x.adjusted for x in stats.adjusted_p(df, [], "p", ["id"]).orderBy("id").collect()]
    assert [v and round(v, 12) for v in got] == [0.03, 0.04, 0.04, None]
    assert abs(stats.f_tail(3.3158, 2, 30) - 0.05) < 1e-5 and stats.f_tail(0.0, 1, 5) == 1.0 and stats.f_tail(1.0, 1, 0) is None
    assert abs(stats.f_tail(1.0, 7, 7) - 0.5) < 1e-12


def test_thirds_impute_scale_one_se(spark):
    d = md.dichotomised(make(spark, [(0.333,), (0.5,), (0.667,)], "psi double"), "psi", 1 / 3, 2 / 3, ("control", "case"))
    assert [x["class"] for x in d.orderBy("psi").collect()] == ["control", "case"]
    long = make(spark, [(1, True, 1.0), (2, True, None), (3, True, 3.0), (4, False, 5.0), (5, False, None)], "id int, train boolean, value double").withColumn("feature", F.lit("f"))
    got = [x.scaled for x in md.imputed_scaled(long, F.col("train")).orderBy("id").collect()]
    assert [round(v, 12) for v in got] == [-1, 0, 1, 3, 0]
    grid = make(spark, [("m", 0.1, 0.60, 0.1), ("m", 0.03, 0.68, 0.1), ("m", 0.01, 0.70, 0.1)], "k string, s double, metric double, sd double")
    assert one(md.one_se(grid, ["k"], "s", "metric", "sd", 10)).s == 0.03


def test_evaluation(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4
    c = one(evl.confusion(make(spark, rows, "t int, p int").withColumn("k", F.lit(1)), ["k"], "t", "p"))
    assert [round(c[n], 6) for n in ("accuracy", "balanced_accuracy", "kappa", "mcc")] == [0.7, 0.7, 0.4, 0.408248]
    s = make(spark, [(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1)], "t int, s double").withColumn("k", F.lit(1))
    assert one(evl.auroc(s, ["k"], "t", "s")).auroc == 0.875
    assert one(evl.auroc(s.withColumn("s", -F.col("s")), ["k"], "t", "s")).auroc == 0.125
    assert one(evl.auroc(s.filter("t = 1"), ["k"], "t", "s")).auroc is None
    assert abs(one(evl.pr_area(s, ["k"], "t", "s")).pr_area - (0.5 + 0.5 * 2 / 3)) < 1e-12


def test_robust_and_folds(spark):
    full, fold = np.array([1.0, 1.0, 0.0]), np.array([[1, 1, 1], [1, 0, 1], [0, 0, 1.0]])
    assert md.robust(full, fold).tolist() == [True, False, False]
    df = make(spark, [(g,) for g in "aaaaabbbccddef"], "g string")
    f = {x.g: x.fold for x in md.group_folds(df, "g", 3, 1).collect()}
    assert set(f.values()) == {1, 2, 3} and len(f) == 6
    assert md.share_holdout(df, "g", 0.1, 5).count() >= 1


def test_lasso_with_free_column():
    r = np.random.default_rng(0)
    z, x = r.normal(size=(200, 1)), r.normal(size=(200, 4))
    y = 3 * z[:, 0] + 2 * x[:, 0] + r.normal(scale=0.1, size=200)
    w = md.lasso_path(x, y, z, np.array([0.0, 0.1, 100.0]))
    full = np.linalg.lstsq(np.column_stack([np.ones(200), z, x]), y, rcond=None)[0]
    assert np.allclose(w[0], full[2:], atol=1e-6) and (w[2] == 0).all() and w[1][0] != 0
    strength, coef, by_fold = md.lasso_one_se(x, y, z, [0.01, 0.1, 1.0], np.arange(200) % 5)
    assert coef[0] > 1 and by_fold.shape == (5, 4)


def test_unit_fits_tell_failures(spark):
    r = random.Random(2)
    rows = [("good", float(x := r.gauss(0, 1)), r.gauss(0, 1), 2 * x + r.gauss(0, 0.1), i) for i in range(60)] + [("flat", 1.0, 2.0, 5.0, i) for i in range(20)] + [("few", 1.0, 2.0, 3.0, 1)]
    got = md.unit_fits(make(spark, rows, "u string, a double, b double, y double, i int"), "u", ["a", "b"], "y", None, "i", [0.001, 0.01, 0.1], 5, 1).collect()
    good = {(x.arm, x.feature): x for x in got if x.unit == "good"}
    assert good["real", "a"].robust and good["real", "a"].p_base < 1e-10 and not (good["permuted", "a"].robust and good["permuted", "a"].p_base < 1e-6)
    assert all(x.status != "ok" for x in got if x.unit != "good")


def test_relational_rules(spark):
    left, right = make(spark, [(1, "old"), (2, "old")], "k int, v string"), make(spark, [(1, None)], "k int, v string")
    assert sorted(map(tuple, rel.update_join(left, right, ["k"], ["v"]).collect())) == [(1, None), (2, "old")]
    many = make(spark, [(2, "a", 1), (2, "b", 2)], "k int, v string, o int")
    assert sorted(map(tuple, rel.update_join(left, many, ["k"], ["v"], order=F.col("o")).collect())) == [(1, "old"), (2, "b")]
    x = make(spark, [("a",), (None,), ("b",)], "v string")
    assert {r.v for r in rel.not_in(x, "v", make(spark, [("a",), (None,)], "m string")).collect()} == {None, "b"}
    assert rel.occurs_once(make(spark, [(1,), (1,), (2,)], "k int"), ["k"]).count() == 1
    ids = [r.row_id for r in rel.row_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), [F.col("v")]).orderBy("v").collect()]
    assert ids == list(range(1, 1001))
    s = rel.seeded_sample(spark.range(100).repartition(7), 10, 3, ["id"])
    assert {r.id for r in s.collect()} == {r.id for r in rel.seeded_sample(spark.range(100).repartition(2), 10, 3, ["id"]).collect()}
    p = rel.permuted(spark.range(50).withColumn("g", F.lit(1)), ["g"], "id", ["id"], 1, "other")
    assert sorted(r.other for r in p.collect()) == list(range(50))


def test_running_sums_and_ranks_of_hot_and_missing_keys(spark):
    import pandas as pd

    from stratawell.operators import ordered

    r = random.Random(8)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.randint(0, 40), i, r.random()) for i in range(400)]
    df = make(spark, rows, "k string, v int, i int, x double")
    pdf = pd.DataFrame(rows, columns=["k", "v", "i", "x"])
    g = pdf.sort_values(["v", "i"]).groupby("k", dropna=False)
    placed = ordered.ranged(df, ["k"], ["v", "i"])
    up = {x.i: x.s for x in ordered.running(placed, ["k"], ["v", "i"], "s", F.col("x")).collect()}
    want = dict(zip(pdf.loc[g.x.cumsum().index, "i"], g.x.cumsum()))
    assert all(abs(up[i] - want[i]) < 1e-9 for i in want) and len(up) == 400
    low = {x.i: x.s for x in ordered.running(placed, ["k"], ["v", "i"], "s", F.col("x"), least=True, back=True).collect()}
    back = pdf.sort_values(["v", "i"], ascending=False).groupby("k", dropna=False).x.cummin()
    assert low == dict(zip(pdf.loc[back.index, "i"], back))
    rank = {x.i: x.rank for x in ordered.average_ranks(df, ["k"], "v", "rank").collect()}
    assert rank == dict(zip(pdf.i, pdf.groupby("k", dropna=False).v.rank()))
    total = {x.i: x.t for x in ordered.with_totals(df, ["k"], t=F.count("*")).collect()}
    assert total == dict(zip(pdf.i, pdf.groupby("k", dropna=False).i.transform("size")))


def test_reshape_round_trip(spark):
    w = make(spark, [(1, 2.0, None), (2, 3.0, 4.0)], "id int, `a;x` double, `b.y` double")
    long = reshape.to_long(w, ["id"], ["a;x", "b.y"])
    assert long.count() == 4
    back = reshape.to_wide(long, ["id"], "feature", "value", ["a;x", "b.y"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, w.collect()))
    assert reshape.usable_features(long).collect()[0].feature == "a;x"


def test_text_rules(spark):
    df = make(spark, [("ENSG00000198561.13",), ("ENSG00000198561",)], "v string")
    assert [r[0] for r in df.select(tx.strip_version(F.col("v"))).collect()] == ["ENSG00000198561"] * 2
    pick = lambda c: one(df.select(c))[0]
    assert pick(tx.hex_colour(F.lit("236,232,56"))) == "#ECE838" and pick(tx.hex_colour(F.lit("1,2"))) is None
    assert pick(tx.title(F.lit("h3K4"))) == "H3K4" and pick(tx.replace_first(F.lit("a.b.c"), r"\.", "-")) == "a-b.c"
    assert pick(tx.base_name(F.lit("x/y/z.gz"))) == "z.gz" and pick(tx.piece(F.lit("a_b"), "_", 3)) is None
    names = make(spark, [("up_7",), ("down_7",), ("7",)], "n string")
    assert [tuple(r) for r in names.select(*ev.region_of(F.col("n"))).collect()] == [("upstream_other_region", 7), ("downstream_other_region", 7), ("event_name", 7)]


def test_psi(spark):
    m = make(spark, [("e", ["a"], ["a", "b"])], "event_id string, alternative array<string>, total array<string>")
    t = make(spark, [("s", "a", 1.0), ("s", "b", 3.0), ("z", "a", 0.0), ("z", "b", 0.0)], "sample_id string, transcript_id string, tpm double")
    assert {x.sample_id: x.psi for x in ev.psi(m, t).collect()} == {"s": 0.25, "z": None}


def test_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    t = readers.delimited(spark, put("a.csv", "a,b,c\nx,,1.5\nNA,y,NA\nz\n"), "a string, b string, c double").collect()
    assert [tuple(r) for r in t] == [("x", "", 1.5), (None, "y", None), ("z", "", None)]
    g = readers.gtf(spark, put("a.gtf", '#c\nchr1\tx\ttranscript\t5\t9\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; transcript_support_level "1 (x)";\nchr1\tx\texon\t5\t9\t.\t-\t.\tgene_id "G2"; transcript_support_level "5";\n'), ["gene_id", "transcript_id"], ["1", "2"]).collect()
    assert [(r.gene_id, r.transcript_id, r.start) for r in g] == [("G1", "T1", 5)]
    b = readers.bed(spark, put("a.bed", "chr1\t4\t9\tTss\n"))
    assert tuple(one(b)) == ("chr1", 5, 9, "Tss")
    writers.bed(b.withColumnRenamed("state", "name"), str(tmp_path / "out.bed"))
    assert tuple(one(readers.bed(spark, str(tmp_path / "out.bed")))) == ("chr1", 5, 9, "Tss")
    s = readers.fasta(spark, put("a.fa", ">chr1 more\nACGTACGT\nACNN\n>chr2\nGGG\n"))
    assert sorted(map(tuple, s.collect())) == [("chr1", "ACGTACGTACNN"), ("chr2", "GGG")]
    w = make(spark, [("chr1", 2, 4, "+"), ("chr1", 2, 4, "-"), ("chr1", 10, 12, "+")], "seqnames string, start bigint, end bigint, strand string")
    seqs = readers.subsequences(w, readers.sequence_chunks(s, 4, 3), 4)
    assert sorted(r.seq for r in seqs.collect()) == ["ACG", "CGT", "CNN"]
    writers.fasta(seqs.select(F.lit("n").alias("name"), "seq"), str(tmp_path / "out.fa"))
    assert readers.fasta(spark, str(tmp_path / "out.fa")).count() == 2
    p = readers.psi_matrix(spark, put("psi", "s1\ts2\ne1\t0.5\tNA\n"))
    assert sorted((r.sample_id, r.psi) for r in p.collect()) == [("s1", 0.5), ("s2", None)]
    c = readers.palette(spark, put("p.json", '{"mark": [{"A": "236,232,56", "B": "0,0,255"}]}'))
    assert {r.label: r.hex for r in c.collect()} == {"A": "#ECE838", "B": "#0000FF"}
    m = readers.methylation(spark, put("m.csv", "l,s1,s2\n10,0.2,-1\n"))
    assert [tuple(r) for r in m.collect()] == [(10, "s1", 0.2)]
    paths = [put(f"IHX0000000{i}.tab", f"r1\t10\t5\t2\t0.2\t0.4\t0.1\t0.9\n") for i in (1, 2)]
    x = readers.signal_summaries(spark, paths, r"(IHX\d{8})")
    assert {r.sample_id for r in x.collect()} == {"IHX00000001", "IHX00000002"}
    e = readers.event_members(spark, {"SE": put("ioe", "event_id\talternative_transcripts\ttotal_transcripts\ne\ta\ta,b\n")})
    assert one(e).other == ["b"]
    named = seqs.withColumnRenamed("seq", "sequence")
    assert {r.sequence: r.score for r in readers.scores(spark, put("score", "ACG\t1.5\n"), named).collect()} == {"ACG": 1.5, "CGT": None, "CNN": None}
    assert readers.all_exist(spark, [paths[0], str(tmp_path / "none")]) == [str(tmp_path / "none")]
    writers.csv(x, str(tmp_path / "out.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out.csv")).count() == 2
    writers.matrix(make(spark, [("e1", 0.5, None)], "id string, s1 double, s2 double"), "id", ["s1", "s2"], str(tmp_path / "mat"))
    assert spark.read.text(str(tmp_path / "mat" / "body")).first()[0] == "e1\t0.5\tNA"
    calls = []
    for _ in range(2):
        got = writers.remembered(spark, str(tmp_path / "memo"), lambda: calls.append(1) or spark.range(3))
        assert got.count() == 3
    assert calls == [1]
    assert readers.selected(spark, put("sel.tsv", "a\tb\tc\n1\tx\tNA\n"), {"c": "double", "a": "int"}).first() == (None, 1)


def test_entry_points(spark):
    meta = make(spark, [("s1", "u1", "", "u2"), ("s2", "", "", "u3")], "id string, exp_RNA_a string, exp_RNA_b string, exp_WGBS_x string")
    samples = assemble.complete_samples(meta, "id", [["exp_RNA_a", "exp_RNA_b"], ["exp_WGBS_x"]])
    files = assemble.file_table(meta, "id", "exp", samples)
    assert sorted((r.assay_type, r.uuid) for r in files.collect()) == [("RNA", "u1"), ("WGBS", "u2")]
    assert assemble.incomplete(files, "id", 2, 2).count() == 0 and assemble.incomplete(files, "id", 3, 8).count() == 1
    st = Settings(event_types=("SE", "RI"), minimum_events=3, vicinity=1000, histone_marks=("m",))
    ids = [(1, "G1;SE:chr1:100-200:260-400:+"), (2, "G1;SE:chr1:150-200:260-400:+"), (3, "G2;SE:chr1:5000-5100:5200-5300:+"), (4, "G3;SE:chrX:5000-5100:5200-5300:+"), (5, "G4;A3:chr2:100-200:100-230:+")]
    e = make(spark, ids, "id int, event_id string")
    assert sorted(r.id for r in assemble.analysed_events(e, None, st).collect()) == [3]
    assert sorted(r.id for r in assemble.analysed_events(e, make(spark, [(1,)], "id int"), st).collect()) == [1, 3]
    r = random.Random(1)
    feats = [(i, f"s{s}", "m;event_name", r.random()) for i in range(6) for s in range(4)]
    features = make(spark, feats, "id int, sample_id string, feature string, value double")
    psi = features.select("id", "sample_id", (F.col("value") * 0.5 + 0.1).alias("psi"))
    groups = make(spark, [(i, "SE", "Low" if i % 2 else "High") for i in range(6)], "id int, event_type string, variability string")
    corr, top = assemble.correlation_ranking(features, psi, groups, st)
    assert {x.variability for x in corr.collect()} == {"All", "Low", "High"} and all(abs(x.middle - 1) < 1e-9 for x in top.collect())
    assert len(assemble.configurations(st.event_types)) == 18
    wide = assemble.wide_units(features, psi, ["m;event_name"]).withColumnRenamed("m;event_name", "m").withColumn("i", F.xxhash64("id", "sample_id")).withColumn("unit", (F.col("id") % 2).cast("string"))
    donors = md.rotations(make(spark, [("0", "a", "chr1"), ("1", "a", "chr2")], "unit string, t string, c string"), ["t"], "c", "unit", 10, 1)
    assert donors.count() == 2
    wide = wide.drop("i").withColumn("i", F.dense_rank().over(__import__("pyspark").sql.Window.partitionBy("unit").orderBy("id", "sample_id")))
    fits = assemble.unit_models(wide, "unit", ["m"], "psi", "i", st, donors, free=None)
    assert {x.rotated for x in fits.collect()} == {True, False}
    assert {x.unit for x in assemble.without_trans_features(fits).collect()} <= {"0", "1"}
    v = assemble.variability(psi.withColumnRenamed("id", "event_id"), groups.withColumnRenamed("id", "event_id"))
    assert {x.variability for x in v.collect()} <= {"Low", "High"}
    ge = assemble.gene_expression(make(spark, [("G1.2", "s0", 3.0)], "gene_id string, sample_id string, tpm double"), make(spark, [(1, "G1.7")], "id int, gene_id string"))
    table = assemble.feature_table({"m": make(spark, [("up_1", "s0", 0.5)], "name string, sample_id string, score double")}, make(spark, [(1, "width", 9.0)], "id int, feature string, value double"), ge)
    assert {x.feature: x.value for x in table.collect()} == {"m;upstream_other_region": 0.5, "width": 9.0, "gene_expression": 2.0}
