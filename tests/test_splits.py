import datetime as dt
from dataclasses import replace

import pytest

from barloom.operators import baseline, splits
from barloom.params import ResearchParams, SplitParams
from barloom.plans import inputs


@pytest.fixture
def dates(spark):
    def make(n):
        first = dt.date(2020, 1, 1)
        rows = [(t, first + dt.timedelta(days=k), k % 2) for k in range(n) for t in ("A", "B")]
        return spark.createDataFrame(rows, "ticker string, date date, target int")
    return make


def test_fraction_split_is_purged(dates):
    tagged = splits.date_segments(splits.date_axis(dates(103)), ResearchParams())
    rows = {r.name: r for r in splits.segment_summary(tagged).collect()}
    assert [rows[s].n_dates for s in splits.SEGMENTS] == [61 - 1, 20 - 1, 22]
    assert rows["test"].n_rows == 44
    gap = lambda a, b: (rows[b].start - rows[a].end).days
    assert gap("train", "validation") == 2 and gap("validation", "test") == 2
    splits.assert_chronological(splits.segment_summary(tagged))


@pytest.mark.parametrize("n,expected", [(4129, (2476, 824, 827)), (2809, (1684, 560, 563))])
def test_known_split_sizes(dates, n, expected):
    tagged = splits.date_segments(splits.date_axis(dates(n)), ResearchParams())
    rows = {r.name: r.n_dates for r in splits.segment_summary(tagged).collect()}
    assert tuple(rows[s] for s in splits.SEGMENTS) == expected


def test_explicit_dates_and_zero_purge(dates):
    params = ResearchParams(split=SplitParams(train_end="2020-02-01", val_end="2020-03-01", purge_days=0))
    tagged = splits.date_segments(splits.date_axis(dates(100)), params)
    rows = {r.name: r for r in splits.segment_summary(tagged).collect()}
    assert str(rows["train"].end) == "2020-02-01" and str(rows["validation"].end) == "2020-03-01"
    assert sum(r.n_dates for r in rows.values()) == 100
    assert params.purge_days() == 0 and params.cv_gap() == 1


def test_guards_fail_when_evaluated(dates):
    with pytest.raises(Exception, match="too few dates"):
        splits.date_segments(splits.date_axis(dates(9)), ResearchParams()).collect()
    with pytest.raises(Exception, match="segment is empty"):
        splits.date_segments(splits.date_axis(dates(12)), replace(ResearchParams(), split=SplitParams(purge_days=5))).collect()
    with pytest.raises(Exception, match="min_train_days"):
        splits.walk_forward_folds(splits.date_axis(dates(40)), 40, 10).collect()


def test_overlap_is_detected(spark):
    rows = [("train", dt.date(2020, 1, 1), dt.date(2020, 1, 3)), ("validation", dt.date(2020, 1, 2), dt.date(2020, 1, 5))]
    with pytest.raises(AssertionError):
        splits.assert_chronological(spark.createDataFrame(rows, "name string, start date, end date"))


def test_walk_forward_sizes(dates):
    axis = splits.date_axis(dates(100))
    folds = splits.fold_table(splits.walk_forward_folds(axis, 40, 25, 1), axis).orderBy("fold").collect()
    plan = splits.fold_table(splits.walk_forward_folds(axis, 40, 25, 1), axis)._jdf.queryExecution().executedPlan()
    assert "NestedLoop" not in plan.toString() and "Cartesian" not in plan.toString()
    assert [f.train_rows for f in folds] == [78, 128, 178] and [f.test_rows for f in folds] == [50, 50, 20]
    assert all(f.train_end < f.test_start for f in folds) and {str(f.train_start) for f in folds} == {"2020-01-01"}


def test_cv_folds_leave_a_gap(dates):
    axis = splits.date_axis(dates(50))
    folds = splits.cv_folds(axis, 3, 1).orderBy("fold").collect()
    assert [(f.train_to, f.test_from, f.test_to) for f in folds] == [(13, 14, 26), (25, 26, 38), (37, 38, 50)]
    rows = splits.assign_folds(dates(50), splits.cv_folds(axis, 3, 1), axis)
    assert rows.where("role = 'test'").count() == 72 and rows.where("role = 'train'").count() == 150


def test_weights_and_priors(spark, small):
    tagged = inputs.tagged(spark, small)
    weights = {r.target: r for r in baseline.class_weights(tagged.where("split = 'train'")).collect()}
    n = sum(r.n_class for r in weights.values())
    assert weights[1].weight * weights[1].n_class == pytest.approx(n / 2)
    prior = {r.split: r.prior for r in baseline.priors(tagged).collect()}
    assert prior["validation"] == pytest.approx(weights[1].n_class / n)
