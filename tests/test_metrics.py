import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.numeric import binomial_upper_tail
from barloom.operators import metrics as M
from barloom.operators import series as S
from barloom.operators.ordered import running_totals


@pytest.fixture
def preds(spark):
    def make(y, p, model="m"):
        rows = [("test", model, int(a), float(b)) for a, b in zip(y, p, strict=True)]
        return spark.createDataFrame(rows, "split string, model string, target int, prob_up double")
    return make


def auc_by_pairs(y, p):
    y, p = np.asarray(y), np.asarray(p)
    up, down = p[y == 1], p[y == 0]
    return ((up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()) / (len(up) * len(down))


def test_confusion_and_scores_of_random_predictions(preds):
    rng = np.random.default_rng(17)
    y, p = rng.integers(0, 2, 120), np.round(rng.uniform(size=120), 2)
    up = p >= 0.5
    tp, fp, fn, tn = ((up & (y == 1)).sum(), (up & (y == 0)).sum(), (~up & (y == 1)).sum(), (~up & (y == 0)).sum())
    m = M.classification_table(preds(y, p)).first()
    assert (m.tp, m.fp, m.tn, m.fn, m.n) == (tp, fp, tn, fn, 120)
    assert m.precision == pytest.approx(tp / (tp + fp)) and m.recall == pytest.approx(tp / (tp + fn))
    assert m.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn)) and m.brier == pytest.approx(((p - y) ** 2).mean())
    assert m.roc_auc == pytest.approx(auc_by_pairs(y, p))


def test_one_class(preds):
    m = M.classification_table(preds([1] * 4, [0.6] * 4)).first()
    assert m.roc_auc is None and m.balanced_accuracy is None and m.acc_pvalue_vs_majority is None and m.accuracy == 1
    none = M.classification_table(preds([0, 0, 1], [0.1, 0.2, 0.3])).first()
    assert none.precision == none.recall == none.f1 == 0.0


def test_missing_label_fails(spark, preds):
    bad = preds([1, 0], [0.4, 0.6]).withColumn("target", F.when(F.col("prob_up") > 0.5, None).otherwise(F.col("target")))
    with pytest.raises(Exception, match="missing label"):
        M.classification_table(bad).collect()


def test_auc_with_ties_and_skewed_scores(preds):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 3000)
    for p in (np.round(rng.uniform(size=3000), 2), 0.5 + 1e-9 * rng.normal(size=3000),
              np.where(rng.uniform(size=3000) < 0.4, 0.5, rng.uniform(size=3000))):
        assert M.roc_auc(preds(y, p)).first().roc_auc == pytest.approx(auc_by_pairs(y, p), abs=1e-12)


def test_running_totals_do_not_depend_on_the_blocks(preds):
    rng = np.random.default_rng(4)
    data = preds(rng.integers(0, 2, 2000), np.round(rng.normal(0.5, 0.1, 2000), 3))
    sums = {"n": F.lit(1).cast("long")}
    a, b = (running_totals(data, ["split", "model"], "prob_up", sums, k) for k in (4, 64))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def exact_tail(k, n, p):
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k, n + 1)]
    return math.fsum(math.exp(x) for x in logs)


def test_binomial_tail(spark):
    cases = [(0, 5, 0.6), (3, 5, 0.6), (5, 5, 0.6), (40, 100, 0.55), (60, 100, 0.55), (2100, 4120, 0.5531),
             (2400, 4120, 0.5531), (1, 1, 0.9), (0, 1, 0.9), (999, 1000, 0.999), (15, 17, 0.5)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for row in df.select("*", binomial_upper_tail(F.col("k"), F.col("n"), F.col("p")).alias("v")).collect():
        assert row.v == pytest.approx(exact_tail(row.k, row.n, row.p), rel=1e-9, abs=1e-13)
    huge = spark.createDataFrame([(500_500_000, 10**9, 0.5)], "k long, n long, p double")
    z = (500_500_000 - 0.5 - 5e8) / math.sqrt(10**9 / 4)
    v = huge.select(binomial_upper_tail(F.col("k"), F.col("n"), F.col("p"))).first()[0]
    assert v == pytest.approx(0.5 * math.erfc(z / 2**0.5), rel=1e-3)


def test_selection_prefers_first_declared_and_ignores_missing(spark):
    rows = [("majority", 0.6), ("a", 0.7), ("b", 0.65), ("c", 0.65), ("d", None)]
    df = spark.createDataFrame(rows, "model string, log_loss double")
    out = {r.model: r for r in M.select_model(df, "log_loss", "majority", ["majority", "d", "a", "c", "b"]).collect()}
    assert [m for m, r in out.items() if r.selected] == ["c"] and not out["c"].selected_beats_majority


def test_roc_drops_only_collinear_points(preds):
    y, p = [1, 1, 0, 1, 0, 0, 1, 0], [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]
    rows = S.roc_points(preds(y, p)).orderBy("fpr", "tpr").collect()
    assert (rows[0].fpr, rows[0].tpr) == (0, 0) and (rows[-1].fpr, rows[-1].tpr) == (1, 1)
    area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(rows, rows[1:], strict=False))
    assert area == pytest.approx(auc_by_pairs(y, p)) and len(rows) < len(y) + 1


def test_calibration_matches_numpy(preds):
    rng = np.random.default_rng(9)
    p = np.round(rng.beta(2, 3, 1000), 3)
    y = (rng.uniform(size=1000) < p).astype(int)
    place = np.searchsorted(np.percentile(p, np.linspace(0, 100, 11))[1:-1], p)
    rows = S.calibration_curve(preds(y, p)).orderBy("bin").collect()
    assert [r.n for r in rows] == [int((place == b).sum()) for b in sorted(set(place))]
    assert np.allclose([r.mean_predicted for r in rows], [p[place == b].mean() for b in sorted(set(place))])
    assert S.calibration_curve(preds(y, [0.5] * 1000)).isEmpty()
    counts = {r.bin: r.n for r in S.probability_histogram(preds(y, p)).collect()}
    assert sum(counts.values()) == 1000 and max(counts) == 39
