import random

import pytest
from pyspark.sql import functions as F

from stratawell.config import Settings
from stratawell.operators import modelling as md
from stratawell.plans import global_models as gm

SETTINGS = Settings(event_types=("SE",), minimum_events=3, vicinity=1000, histone_marks=("m",), global_folds=2, lambda_grid=(0.001, 0.1))


def rows(n=400):
    r = random.Random(3)
    out = []
    for i in range(n):
        x = r.gauss(0, 1)
        out.append((i, r.choice(["chr1", "chr2", "chr3"]), r.choice(["T", "B", "M"]), f"g{r.randint(0, 20)}", x if r.random() > 0.05 else None, r.gauss(0, 1), 1.0, min(1.0, max(0.0, 0.5 + 0.4 * x + r.gauss(0, 0.1)))))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id int, chrom string, cell string, gene string, a double, b double, flat double, psi double")


def test_real_arm_beats_permuted_arm(spark):
    got = gm.run_global(frame(spark, rows()), "id", "gene", ["a", "b", "flat"], "psi", ("chrom", ["chr1"]), ("cell", ["T", "B"]), SETTINGS, trees=10)
    m = {(x.arm, x.model, x.slice): x for x in got["metrics"].collect()}
    assert {s for _, _, s in m} == set(gm.SLICES) and {k for _, k, _ in m} >= {"l1", "forest"}
    assert m["real", "l1", "both"].auroc > 0.9 and m["real", "forest", "both"].auroc > 0.9
    assert m["real", "l1", "second_only"].balanced_accuracy > 0.8
    assert {x.feature for x in got["importances"].collect()} == {"a", "b"}  # a constant feature is not used
    s = got["sizes"].first()
    assert s.n_train + s.n_test == md.dichotomised(frame(spark, rows()), "psi", 1 / 3, 2 / 3, ("c", "d")).count() and 0 < s.npos_train < s.n_train
    assert gm.baselines(got["sizes"]).first().auroc == 0.5


def test_hold_out_groups_do_not_train(spark):
    d = gm.split(frame(spark, rows()), ("chrom", ["chr1"]), ("cell", ["T", "B"]), "psi", SETTINGS)
    train = d.filter("NOT test")
    assert train.filter("chrom = 'chr1' OR cell IN ('T', 'B')").count() == 0
    assert d.filter("strict_test").filter("chrom <> 'chr1' OR cell = 'M'").count() == 0
    with pytest.raises(ValueError):
        gm.run_global(frame(spark, rows()), "id", "gene", ["flat"], "psi", ("chrom", ["chr1"]), ("cell", ["T"]), SETTINGS)


def test_fractional_logit(spark):
    model = md.fractional_logit(frame(spark, rows()).dropna(), ["a"], "psi").stages[-1]
    assert model.coefficients[0] > 0.5


def test_every_configuration_runs_or_tells_why(spark):
    from stratawell.plans import assemble

    df = frame(spark, rows(200))
    events = df.select("gene").distinct().select("gene", F.lit("SE").alias("event_type"), F.when(F.substring("gene", 2, 2).cast("int") % 2 == 0, "Low").otherwise("High").alias("variability"))
    sets = {"all": ["a", "b"], "none": ["flat"]}
    small = Settings(event_types=("SE",), minimum_events=3, vicinity=1000, histone_marks=("m",), global_folds=2, lambda_grid=(0.01,))
    got = assemble.run_configurations(df, events, sets, small, "id", "gene", "psi", ("chrom", ["chr1"]), ("cell", ["T", "B"]), trees=3)
    status = {(x.row_filter, x.feature_set): x.status for x in got["status"].collect()}
    assert set(status) == {(f, s) for f in ("all", "Low", "High") for s in sets}
    assert all((v == "ok") == (k[1] == "all") for k, v in status.items())
    assert {(x.event_type, x.row_filter, x.feature_set) for x in got["metrics"].select("event_type", "row_filter", "feature_set").distinct().collect()} == {("SE", f, "all") for f in ("all", "Low", "High")}


def test_a_callers_metric_chooses_the_strength(spark):
    data = [(float(i % 2), 1.0, i % 2 + 1 if i < 2 else i // 2 % 2 + 1, float(i % 2)) for i in range(40)]
    df = gm.preprocess(x := spark.createDataFrame(data, "label double, weight double, fold int, a double"), ["a"]).transform(x)
    assert gm.one_se_strength(df, "label", 2, (0.001, 0.01), lambda scored, label: 1.0) == 0.01  # equal: the largest


def test_refit_without_trans_features_and_no_permuted_rotations(spark):
    from stratawell.plans import assemble

    r, data = random.Random(5), []
    for u in range(4):
        for s in range(40):
            shared, own = random.Random(s).gauss(0, 1), r.gauss(0, 1)
            data.append((str(u), s, shared, own, shared + 2 * own + r.gauss(0, 0.05)))
    wide = spark.createDataFrame(data, "unit string, s int, shared double, own double, psi double")
    donors = spark.createDataFrame([(str(u), str((u + 1) % 4), 1) for u in range(4)], "unit string, donor string, rotation int")
    st = Settings(event_types=("SE",), minimum_events=3, vicinity=1000, histone_marks=("m",), event_folds=4, lambda_grid=(0.05,))
    fits = assemble.unit_models(wide, "unit", ["shared", "own"], "psi", "s", st, donors, free=None).cache()
    assert fits.filter("rotated AND arm = 'permuted'").count() == 0 and fits.filter("NOT rotated AND arm = 'permuted'").count() == 8
    trans = {(x.unit.split("#")[0], x.feature) for x in fits.filter("rotated AND coefficient <> 0").collect()}
    again = assemble.refitted(wide, fits, "unit", ["shared", "own"], "psi", "s", st, free=None).filter("arm = 'real'").collect()
    assert {(x.unit, x.feature) for x in again if x.feature} == {(str(u), f) for u in range(4) for f in ("shared", "own")} - trans
    assert {x.unit for x in again} == {"0", "1", "2", "3"} and ("0", "shared") in trans
    picked = md.fold_features(fits).filter("NOT rotated AND arm = 'real' AND feature = 'own'")
    assert {(x.unit, x.fold) for x in picked.collect()} == {(str(u), k) for u in range(4) for k in range(1, 5)}
