"""Life histories by days equal a full rebuild, and read only what can change."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlife.contracts import quarter_name
from fleetlife.operators.lifecycle import drive_summary, labels
from fleetlife.plans import lifestate
from fleetlife.plans.lifestate import apply_days, read_labels, read_summary
from fleetlife.session import stage
from fleetlife.streaming.incremental import ingest_new_days

SCHEMA = "date date, serial_number string, model string, capacity_bytes bigint, failure tinyint"
HORIZONS = (7, 30)


def fleet(seed, units=25, days=400):
    """Units with gaps, some that fail, some that come back after a failure."""
    rng = random.Random(seed)
    rows = []
    for u in range(units):
        at, end = rng.randrange(60), rng.randrange(90, days)
        while at < end:
            rows.append((date(2024, 1, 1) + timedelta(at), f"u{u}", f"m{at // 150}", 10**12 + at // 150, 0))
            at += rng.choice([1, 1, 2, 9])
        if rng.random() < 0.5:
            rows[-1] = (*rows[-1][:4], 1)
            if rng.random() < 0.4:
                rows.append((rows[-1][0] + timedelta(rng.choice([3, 200])), f"u{u}", "m9", None, 0))
    return rows


def same(spark, root, rows):
    panel = stage(spark.createDataFrame(rows, SCHEMA))
    names = ["date", "serial_number", "model", "capacity_bytes", "failure", "event", "rul_time_days", *[f"will_fail_within_{n}" for n in HORIZONS]]
    key = lambda r: (r[1], r[0])
    ours = sorted(map(tuple, read_labels(spark, root).select(*names).collect()), key=key)
    assert ours == sorted(map(tuple, labels(panel, HORIZONS).select(*names).collect()), key=key)
    units = drive_summary(panel)
    assert sorted(map(tuple, read_summary(spark, root).select(units.columns).collect())) == sorted(map(tuple, units.collect()))


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
def test_equals_a_rebuild_after_any_order(spark, tmp_path, order):
    rows = fleet(1)
    months = sorted({r[0].replace(day=1) for r in rows})
    parts = [[r for r in rows if r[0].replace(day=1) in months[i : i + 4]] for i in range(0, len(months), 4)]
    parts = {"forward": parts, "backward": parts[::-1], "mixed": random.Random(2).sample(parts, len(parts))}[order]
    root, done = str(tmp_path), []
    for i, part in enumerate(parts):
        apply_days(spark, root, spark.createDataFrame(part, SCHEMA), f"b{i}", HORIZONS)
        done += part
    same(spark, root, done)
    assert len(lifestate._versions(spark, root)) == lifestate.KEPT_VERSIONS


def test_new_day_reads_no_old_quarter(spark, tmp_path):
    rows = [r for r in fleet(3) if r[4] == 0]
    last = {u: max(r[0] for r in rows if r[1] == u) for u in {r[1] for r in rows}}
    root = str(tmp_path)
    apply_days(spark, root, spark.createDataFrame(rows, SCHEMA), "all", HORIZONS)
    before = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "label_days").iterdir() if p.is_dir()}
    unit = max(last, key=last.get)
    day = last[unit] + timedelta(1)
    more = [(day, unit, "m9", 1, 1)]
    written = apply_days(spark, root, spark.createDataFrame(more, SCHEMA), "next", HORIZONS)
    earliest = quarter_name(last[unit] - timedelta(30))
    assert set(written) <= {earliest, quarter_name(last[unit]), quarter_name(day)}
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "label_days").iterdir() if p.is_dir()}
    assert len(before) > 3
    assert all(after[n] == files for n, files in before.items() if n.removeprefix("quarter=") not in written)
    same(spark, root, rows + more)


def test_batch_applied_again(spark, tmp_path):
    """After a failure between state and labels, and with all its days stored already."""
    rows, root = fleet(4, units=8), str(tmp_path)
    half = [r for r in rows if r[0] < date(2024, 6, 1)]
    rest = [r for r in rows if r[0] >= date(2024, 6, 1)]
    apply_days(spark, root, spark.createDataFrame(half, SCHEMA), "a", HORIZONS)
    frame = spark.createDataFrame(rest, SCHEMA)
    apply_days(spark, root, frame, "b", HORIZONS)
    apply_days(spark, root, frame, "b", HORIZONS)
    same(spark, root, rows)
    apply_days(spark, root, frame, "c", HORIZONS)  # the same days under another name
    same(spark, root, rows)


def test_repeated_days_and_late_failures(spark, tmp_path):
    days = [date(2024, 3, 1) + timedelta(k) for k in range(20)]
    rows, root = [(d, "u", "m", 5, 0) for d in days], str(tmp_path)
    apply_days(spark, root, spark.createDataFrame(rows[:10] + rows[:3], SCHEMA), "a", HORIZONS)
    apply_days(spark, root, spark.createDataFrame(rows[8:], SCHEMA), "b", HORIZONS)
    same(spark, root, rows)
    late = [(days[-1], "u", "m", 5, 1)]
    apply_days(spark, root, spark.createDataFrame(late, SCHEMA), "c", HORIZONS)
    same(spark, root, rows[:-1] + late)


def test_from_the_stream(spark, tmp_path):
    """The stream applies every batch it stores."""
    rows, landing = fleet(5, units=6), tmp_path / "landing"
    landing.mkdir()
    root, columns = str(tmp_path), [f.split()[0] for f in SCHEMA.split(", ")]
    for part, months in (("one", (1, 2, 3, 4)), ("two", tuple(range(5, 13)))):
        own = [r for r in rows if r[0].month in months and r[0].year == 2024]
        text = "\n".join([",".join(columns), *(",".join("" if v is None else str(v) for v in r) for r in own)])
        (landing / f"{part}.csv").write_text(text + "\n")
        ingest_new_days(
            spark, str(landing), f"{root}/panel", f"{root}/checkpoint", columns, life=root, horizons=HORIZONS
        ).awaitTermination()
    same(spark, root, [r for r in rows if r[0].year == 2024])


def test_labels_are_pruned(spark, tmp_path):
    root = str(tmp_path)
    apply_days(spark, root, spark.createDataFrame(fleet(6, units=4), SCHEMA), "a", HORIZONS)
    plan = read_labels(spark, root).where(F.col("quarter") == "2024-Q2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quarter" in plan
