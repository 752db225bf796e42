"""Invariants and brute-force comparisons on small inputs."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife.contracts import SMART_BIG5, Settings, Span, feature_columns, quarter_range
from fleetlife.operators import drift, lifecycle, rankmetrics, sampling, sequences, survmetrics, windows
from fleetlife.operators.encode import codebook, encode
from fleetlife.operators.prefix import running_totals
from fleetlife.plans.datasets import rolling_split, smart_columns
from fleetlife.sources.testdata import EVENT_SETTINGS as S


def days(spark, rows):
    """Panel rows from (unit, day number, failure, reading)."""
    start = date(2024, 1, 1)
    full = [
        (u, start + timedelta(days=d), "A", 10**12, f, *([v] * 5)) for u, d, f, v in rows
    ]
    types = "serial_number string, date date, model string, capacity_bytes bigint, failure tinyint, "
    return spark.createDataFrame(full, types + ", ".join(f"{c} double" for c in SMART_BIG5))


# --- contracts ---------------------------------------------------------------------------


def test_feature_contract():
    names = feature_columns()
    assert len(names) == len(set(names)) == 43
    assert names[:3] == ["model", "capacity_gb", "drive_age_days"]


def test_quarters():
    assert quarter_range("2024-Q4") == (date(2024, 10, 1), date(2024, 12, 31))
    assert quarter_range("2025-Q1") == (date(2025, 1, 1), date(2025, 3, 31))
    span = Span.of_quarters(["2024-Q4", "2025-Q2"])
    assert (span.first, span.last) == (date(2024, 10, 1), date(2025, 6, 30))
    with pytest.raises(ValueError):
        quarter_range("2024-05")


def test_settings_from_dict():
    raw = {
        "data": {"healthy_downsample_ratio": 40},
        "labels": {"horizons_days": [7, 30]},
        "split": {
            "strategy": "time",
            "train_quarters": ["2024-Q4", "2025-Q1"],
            "val_quarters": ["2025-Q2"],
            "test_quarters": ["2025-Q3"],
        },
    }
    settings = Settings.from_dict(raw)
    assert settings.negatives_per_positive == 40
    assert settings.splits["train"].last < settings.splits["val"].first
    assert settings.splits["val"].last < settings.splits["test"].first
    raw["split"]["strategy"] = "random"
    with pytest.raises(ValueError):
        Settings.from_dict(raw)


def test_feature_sets():
    columns = ["date", "smart_1_raw", "smart_1_normalized", "smart_5_raw"]
    assert smart_columns("big5", columns) == SMART_BIG5
    assert smart_columns("full", columns) == ["smart_1_raw", "smart_5_raw"]
    with pytest.raises(ValueError):
        smart_columns("auto", columns)


# --- labels ------------------------------------------------------------------------------


def test_label_edges(spark):
    frame = days(spark, [("F", d, int(d == 9), 1.0) for d in range(10)] + [("C", d, 0, 1.0) for d in range(10)])
    rows = {(r.serial_number, r.rul_time_days): r.will_fail_within_3 for r in lifecycle.labels(frame, [3]).collect()}
    assert rows["F", 3] == 1 and rows["F", 4] == 0 and rows["F", 0] == 1
    assert rows["C", 3] == 0 and rows["C", 2] is None


def test_failure_before_later_rows(spark):
    """A failed unit that reports again ends at its last row, not at the failure."""
    frame = days(spark, [("F", 0, 0, 1.0), ("F", 1, 1, 1.0), ("F", 5, 0, 1.0)])
    row = lifecycle.drive_summary(frame).first()
    assert row.event == 1 and row.last_date == date(2024, 1, 6) and row.lifetime_days == 6


def test_label_partition_and_nesting(panel):
    lab = lifecycle.labels(panel, S.horizons)
    total = panel.count()
    for n in S.horizons:
        y = F.col(f"will_fail_within_{n}")
        r = lab.agg(F.count_if(y == 1), F.count_if(y == 0), F.count_if(y.isNull())).first()
        assert sum(r) == total
    assert lab.where("will_fail_within_3 = 1 AND will_fail_within_7 IS DISTINCT FROM 1").isEmpty()


def test_splits_do_not_overlap(panel, summary):
    last = None
    for name in ("train", "val", "test"):
        r = rolling_split(panel, summary, S.splits[name], S.horizon).agg(F.min("date"), F.max("date")).first()
        assert S.splits[name].first <= r[0] and r[1] <= S.splits[name].last
        assert last is None or last < r[0]
        last = r[1]


def test_as_of_uses_no_later_rows(panel):
    cut = S.splits["train"].last
    assert lifecycle.drive_summary(panel, as_of=cut).agg(F.max("last_date")).first()[0] <= cut


# --- windows -----------------------------------------------------------------------------


def test_rolling_matches_plain_python(spark):
    rng = random.Random(1)
    points = {u: sorted(rng.sample(range(60), 15)) for u in ("A", "B")}
    rows = [(u, d, 0, None if rng.random() < 0.3 else float(rng.randint(0, 9))) for u in points for d in points[u]]
    got = {
        (r.serial_number, r.date): r
        for r in windows.with_rolling(windows.forward_fill(days(spark, rows))).collect()
    }
    for unit in points:
        last, seen = 0.0, []
        for _, d, _, v in sorted(x for x in rows if x[0] == unit):
            last = last if v is None else v
            seen.append((d, last))
            row = got[unit, date(2024, 1, 1) + timedelta(days=d)]
            for w in (7, 14, 30):
                inside = [x for t, x in seen if t > d - w]
                assert row[f"smart_5_raw_rmean_{w}"] == pytest.approx(np.mean(inside))
                std = row[f"smart_5_raw_rstd_{w}"]
                assert std is None if len(inside) == 1 else std == pytest.approx(np.std(inside, ddof=1))


def test_fill_starts_at_lookback_edge(spark):
    """A value older than the look-back is not carried into the span."""
    frame = days(spark, [("A", 0, 0, 5.0), ("A", 40, 0, None), ("A", 41, 0, 2.0), ("A", 42, 0, None)])
    span = Span(date(2024, 2, 9), date(2024, 3, 31))
    rows = windows.rolling_span(frame, span).orderBy("date").collect()
    assert [r.smart_5_raw for r in rows] == [0.0, 2.0, 2.0]


def test_windows_share_one_shuffle(panel):
    plan = windows.rolling_span(panel, S.splits["test"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert "SinglePartition" not in plan


def test_labels_reuse_the_window_shuffle(spark, panel):
    """Without broadcasts, the panel is still shuffled once: the lives are joined on its key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = rolling_split(panel, lifecycle.unit_lives(panel), S.splits["val"], S.horizon)
        plan = split._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(serial_number") == 2
    assert "SortMergeJoin" in plan and "SinglePartition" not in plan


def test_summary_does_not_sort_the_panel(panel):
    plan = lifecycle.drive_summary(panel)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.index("HashAggregate") < plan.index("Scan")
    assert "Sort [" not in plan[plan.index("HashAggregate"):]


def test_newest_rows_are_limited_before_the_shuffle(panel):
    plan = windows.latest_snapshot(panel)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange"):]


def test_latest_snapshot(panel):
    latest = {r.serial_number: r.date for r in windows.latest_snapshot(panel).collect()}
    expected = {r.serial_number: r.d for r in panel.groupBy("serial_number").agg(F.max("date").alias("d")).collect()}
    assert latest == expected


# --- running totals ----------------------------------------------------------------------


@pytest.mark.parametrize("cells_per_bucket", [7, 50, 1_000_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_any_bucket_size(spark, cells_per_bucket, descending):
    rng = random.Random(3)
    rows = [(g, round(rng.random(), 6), rng.randint(0, 5)) for g in ("a", "b") for _ in range(500)]
    cells = spark.createDataFrame(rows, "g string, v double, n bigint").groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = running_totals(cells, "v", ["n"], ["g"], descending, cells_per_bucket).collect()
    for g in ("a", "b"):
        total, last = 0, [r for r in got if r.g == g]
        for r in sorted(last, key=lambda r: -r.v if descending else r.v):
            assert r.n_before == total
            total += r.n
            assert r.n_upto == total
        assert all(r.n_total == total for r in last)


def test_running_totals_do_not_sort_in_one_task(spark, scores):
    curve = rankmetrics.rank_curve(scores, cells_per_bucket=20)
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "SinglePartition" not in plan
    whole = rankmetrics.rank_curve(scores)
    assert curve.exceptAll(whole).isEmpty() and whole.exceptAll(curve).isEmpty()


# --- ranking metrics ---------------------------------------------------------------------

TIED = ([1, 0, 1, 0, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.7, 0.6, 0.5, 0.5, 0.1])


def scored(spark, y, s):
    return spark.createDataFrame(list(zip(y, map(float, s))), "y int, score double")


def test_tied_scores(spark):
    row = rankmetrics.classification_bundle(scored(spark, *TIED)).first()
    assert row.pr_auc == pytest.approx(0.642857, abs=1e-6)
    assert row.roc_auc == pytest.approx(0.666667, abs=1e-6)


def test_recall_row_level_equals_tie_grouped(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.2).astype(int)
    s = rng.permutation(400) / 400 + 0.2 * y
    order = np.argsort(-s)
    fpr, tp = np.cumsum(1 - y[order]) / (1 - y).sum(), np.cumsum(y[order])
    last = np.where(fpr <= 0.05)[0][-1]
    curve = rankmetrics.rank_curve(scored(spark, y.tolist(), s.tolist()))
    at = curve.agg(rankmetrics.recall_at_fpr(0.05).alias("at")).first()["at"]
    assert at.recall == pytest.approx(tp[last] / y.sum())
    assert at.threshold == pytest.approx(s[order][last])


def test_one_class_only(spark):
    row = rankmetrics.classification_bundle(scored(spark, [0, 0], [0.1, 0.2])).first()
    assert row.pr_auc is None and row.roc_auc is None and row.fbeta is None
    assert row.fpr_1pct.recall is None and row.fpr_1pct.threshold is None


def test_no_feasible_threshold(spark):
    row = rankmetrics.classification_bundle(scored(spark, [0, 1], [0.9, 0.2])).first()
    assert row.fpr_1pct.recall == 0.0 and row.fpr_1pct.threshold == 0.9


# --- concordance -------------------------------------------------------------------------


def brute_concordance(rows):
    good = tied = pairs = 0
    for ti, ei, ri in rows:
        if ei != 1:
            continue
        for tj, ej, rj in rows:
            if tj > ti or (tj == ti and ej == 0):
                pairs += 1
                good += rj < ri
                tied += rj == ri
    return good, tied, pairs


@pytest.mark.parametrize("cells_per_bucket", [11, 1_000_000])
@pytest.mark.parametrize("hot", [False, True])
def test_concordance_equals_all_pairs(spark, cells_per_bucket, hot):
    rng = random.Random(9)
    rows = [
        (10 if hot and rng.random() < 0.4 else rng.randint(1, 40), int(rng.random() < 0.4), float(rng.randint(0, 12)))
        for _ in range(300)
    ]
    frame = spark.createDataFrame(rows, "time int, event int, risk double")
    r = survmetrics.concordance(frame, cells_per_bucket=cells_per_bucket).first()
    good, tied, pairs = brute_concordance(rows)
    assert (r.concordant, r.tied, r.comparable) == (good, tied, pairs)
    assert r.c_index == pytest.approx((good + tied / 2) / pairs)


def test_concordance_of_reversed_risk(scores):
    a = survmetrics.concordance(scores).first().c_index
    b = survmetrics.concordance(scores.withColumn("risk", -F.col("risk"))).first().c_index
    assert a + b == pytest.approx(1.0)


def test_concordance_plan_has_no_pairs(scores):
    plan = survmetrics.concordance(scores)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_concordance_without_events(spark):
    frame = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0)], "time int, event int, risk double")
    assert survmetrics.concordance(frame).first().c_index is None


# --- sampling ----------------------------------------------------------------------------


def test_undersample_keeps_positives_and_repeats(scores):
    rows = scores.dropna(subset=["y"])
    once = sampling.undersample(rows, 3.0)
    again = sampling.undersample(rows.repartition(13), 3.0)
    assert once.where("y = 1").count() == rows.where("y = 1").count()
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()
    assert once.where("y = 0").count() < rows.where("y = 0").count()


def test_undersample_keeps_all_when_few(scores):
    rows = scores.dropna(subset=["y"])
    assert sampling.undersample(rows, 1e6).count() == rows.count()


def test_sample_n_is_exact(panel):
    assert sampling.sample_n(panel, 100).count() == 100
    assert sampling.sample_n(panel, 10**9).count() == panel.count()
    assert sampling.sample_n(panel, 0).count() == 0


def test_smallest_hashes_orders_few_counts(spark, monkeypatch):
    """No window over a group's slots sees a number of rows that grows with the group."""
    import hashlib

    seen, reached = [], sampling._reached

    def spy(counts, limits, within, place):
        seen.append(counts.groupBy(*within).count().agg({"count": "max"}).first()[0])
        return reached(counts, limits, within, place)

    monkeypatch.setattr(sampling, "_reached", spy)
    rows = spark.range(100_000).selectExpr("cast(id % 2 as int) AS g", "id")
    limits = spark.createDataFrame([(0, 30_000), (1, 7)], "g int, n bigint")
    kept = {r.id for r in sampling.smallest_hashes(rows.where("g = 0 or id < 40000"), limits, ["id"], ["g"]).collect()}
    order = sorted(range(100_000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:8])
    expected = [i for i in order if i % 2 == 0][:30_000] + [i for i in order if i % 2 and i < 40_000][:7]
    assert kept == set(expected) and len(kept) == 30_007
    assert len(seen) == 2 and seen[0] <= 1 << 16 and seen[1] < 100  # 50,000 rows and slots in a group


def test_smallest_hashes_with_one_hot_slot(spark):
    """Rows that share a hash slot are ranked by their keys."""
    rows = spark.range(50).select((F.col("id") % 5).cast("string").alias("k"), "id", F.lit(0).alias("g"))
    limits = spark.createDataFrame([(0, 17)], "g int, n bigint")
    kept = sampling.smallest_hashes(rows, limits, ["k", "id"], ["g"])
    assert kept.count() == 17 and kept.select("id").distinct().count() == 17


def test_sample_plan_moves_no_group_to_one_task(scores):
    """The joins on the group are broadcasts; rows are only shuffled by (group, hash slot)."""
    limits = scores.sparkSession.createDataFrame([(0, 50), (1, 20)], "event tinyint, n bigint")
    kept = sampling.smallest_hashes(scores, limits, ["serial_number", "date"], ["event"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(event" in line]
    assert sum("_slot" not in line for line in moved) == 1  # the counts per slot, not the rows


@pytest.mark.parametrize("events,others,expected", [(10, 100, (10, 50)), (100, 10, (50, 10)), (100, 100, (30, 30)), (7, 8, (7, 8))])
def test_balanced_cap(spark, events, others, expected):
    """Sixty rows at most: half of each kind, and what one kind lacks goes to the other."""
    rows = [(f"e{i}", "2024-01-01", 1) for i in range(events)] + [(f"c{i}", "2024-01-01", 0) for i in range(others)]
    frame = spark.createDataFrame(rows, "serial_number string, date string, event int")
    kept = {r.event: r["count"] for r in sampling.balanced_cap(frame, 60).groupBy("event").count().collect()}
    assert (kept[1], kept[0]) == expected


# --- encoding ----------------------------------------------------------------------------


def test_codes(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "model string")
    book = codebook(train)
    assert {r.model: r.code for r in book.collect()} == {"a": 0, "b": 1, "c": 2}
    later = spark.createDataFrame([("c",), ("z",), (None,)], "model string")
    assert sorted(r.model_code for r in encode(later, book).collect()) == [-1, -1, 2]


# --- drift -------------------------------------------------------------------------------


def both_windows(spark, ref, cur, column="x"):
    rows = [(v, True, False) for v in ref] + [(v, False, True) for v in cur]
    kind = "string" if isinstance(next(v for v in [*ref, *cur] if v is not None), str) else "double"
    return spark.createDataFrame(rows, f"{column} {kind}, in_ref boolean, in_cur boolean")


@pytest.mark.parametrize("cells_per_bucket", [40, 1_000_000])
def test_psi_and_ks_by_hand(spark, cells_per_bucket):
    """0 to 99 against 50 to 99 twice. A tenth of the reference is in each bin, a fifth of the current
    rows in each of the upper five and nothing in the lower five, which counts as a millionth:
    5 * 0.1 * ln 2 + 5 * (0.1 - 0.000001) * ln 100,000 = 0.34657 + 5.75640."""
    ref, cur = [float(i) for i in range(100)], [float(50 + i % 50) for i in range(100)]
    row = drift.numeric_drift(both_windows(spark, ref, cur), ["x"], cells_per_bucket=cells_per_bucket).first()
    assert row.psi == pytest.approx(6.1030, abs=1e-4)
    assert row.ks_stat == 0.5 and row.edge_count == 11 and row.drifted


def test_small_shift_by_hand(spark):
    """Two values: 60 and 40 of 100 rows, then 50 and 50. The sixth decile lies between them, so each
    value has a bin: 0.1 * ln(0.6 / 0.5) + 0.1 * ln(0.5 / 0.4) = 0.01823 + 0.02231."""
    row = drift.numeric_drift(both_windows(spark, [1.0] * 60 + [2.0] * 40, [1.0] * 50 + [2.0] * 50), ["x"]).first()
    assert row.edge_count == 3 and row.psi == pytest.approx(0.0405, abs=1e-4) and row.ks_stat == pytest.approx(0.1)


def test_same_rows_in_another_order(spark):
    values = [float(i * i % 97) for i in range(400)]
    row = drift.numeric_drift(both_windows(spark, values, values[::-1]), ["x"]).first()
    assert (row.psi, row.ks_stat, row.ks_pvalue, row.drifted) == (0.0, 0.0, 1.0, False)


def test_published_p_value(spark):
    p = spark.range(1).select(drift.ks_pvalue(F.lit(0.0043), F.lit(60000), F.lit(60000)).alias("p")).first().p
    assert p == pytest.approx(0.636, abs=2e-3)


def test_few_rows_are_listed_and_constant_is_zero(spark):
    few = drift.numeric_drift(both_windows(spark, [1.0] * 49, [1.0] * 80), ["x"])
    assert [(r.feature, r.psi, r.ks_stat, r.drifted) for r in few.collect()] == [("x", None, None, False)]
    assert tuple(drift.drift_summary(few).first()) == (1, 0, 0.0)
    row = drift.numeric_drift(both_windows(spark, [0.0] * 60, [9.0] * 60), ["x"]).first()
    assert row.psi == 0.0 and row.edge_count == 1


def test_new_category_and_null(spark):
    both = both_windows(spark, ["a", None, "b", "b"], ["a", None, "c", "c"], "model")
    row = drift.categorical_drift(both, ["model"]).first()
    assert row.new_categories == 1 and row.drifted
    same = both_windows(spark, ["a", None], ["a", None], "model")
    assert drift.categorical_drift(same, ["model"]).first().psi == 0.0


@pytest.mark.parametrize(
    "drifted,features,now,before,reasons",
    [
        (2, 4, None, None, ["drift in 2 of 4 features"]),
        (3, 7, None, None, []),
        (0, 4, 0.4375, 0.5, ["pr_auc fell from 0.5 to 0.438"]),
        (0, 4, 0.46875, 0.5, []),
        (0, 4, 0.5, 0.25, []),
        (4, 4, 0.125, 0.25, ["drift in 4 of 4 features", "pr_auc fell from 0.25 to 0.125"]),
        (0, 0, None, 0.25, []),
    ],
)
def test_retrain_decision(spark, drifted, features, now, before, reasons):
    kind = "n_features int, n_drifted int, drifted_share double"
    summary = spark.createDataFrame([(features, drifted, drifted / max(features, 1))], kind)
    row = drift.retrain_decision(summary, now, before).first()
    assert row.reasons == reasons and row.retrain == bool(reasons)


# --- sequences ---------------------------------------------------------------------------


def test_sequences(panel, summary):
    everything = sequences.sequence_dataset(panel, summary, S.splits["val"])
    units = {r.serial_number for r in everything.select("serial_number").distinct().collect()}
    assert units == {r.serial_number for r in lifecycle.in_span(panel, S.splits["val"]).select("serial_number").distinct().collect()}
    rows = sequences.sequence_dataset(panel, summary, S.splits["val"], max_anchors=40).collect()
    assert 0 < len(rows) <= 40 < everything.count()
    for r in rows:
        assert len(r.window) == 30 and all(len(x) == 5 for x in r.window) and r.dur >= 1


def test_short_history_is_padded(spark):
    frame = days(spark, [("A", d, 0, float(d + 1)) for d in range(3)])
    rows = sequences.with_row_windows(windows.forward_fill(frame), 5).orderBy("date").collect()
    assert [x[0] for x in rows[-1].window] == [0.0, 0.0, 1.0, 2.0, 3.0]


def test_newest_features_without_windows(spark):
    """One aggregation per unit gives the newest rows of all windows, gaps and single days included."""
    from fleetlife.contracts import Span, rolling_columns
    from fleetlife.operators.windows import rolling_span
    from fleetlife.sources.testdata import lineitem_panel

    panel = lineitem_panel(spark, "/root/testdata/sf0.001")
    span = Span(date(1998, 1, 1), date(1998, 12, 31))
    names = ["serial_number", "date", "model", "capacity_bytes", *SMART_BIG5, *rolling_columns()]
    newest = {}
    for r in rolling_span(panel, span).select(*names).collect():
        if r.serial_number not in newest or newest[r.serial_number].date < r.date:
            newest[r.serial_number] = r
    rows = rolling_span(panel, span, latest_only=True)
    assert "RangeFrame" not in rows._jdf.queryExecution().executedPlan().toString()
    rows = rows.select(*names).collect()
    assert len(rows) == len(newest) > 100
    for r in rows:
        for a, b in zip(r, newest[r.serial_number]):
            assert a == b or (a is not None and a == pytest.approx(b, abs=1e-9))
