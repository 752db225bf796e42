"""Day files, archives, the stored panel, and incremental ingest."""

import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from fleetlife.contracts import Span, quarter_name
from fleetlife.operators.eda import ingest_audit
from fleetlife.plans import jobs
from fleetlife.sources.panel import (
    in_quarters,
    one_row_per_day,
    panel_schema,
    read_day_files,
    read_header,
    read_panel,
    read_zipped_quarters,
    write_bucketed_panel,
    write_panel,
    write_report,
)
from fleetlife.streaming.incremental import ingest_new_days

HEADER = [
    "date", "serial_number", "model", "capacity_bytes", "failure", "datacenter", "smart_5_normalized", "smart_5_raw",
]
DAY_1 = """date,serial_number,model,capacity_bytes,failure,datacenter,smart_5_normalized,smart_5_raw
2024-10-01,A,M1,4000,0,x,100,4e3
2024-10-01,B,M2,,0,,100,
"""
DAY_2 = """date,serial_number,model,capacity_bytes,failure,datacenter,smart_5_normalized,smart_5_raw
2024-10-02,A,M1,4000,1,x,99,8
"""


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    (folder / "__MACOSX").mkdir(parents=True)
    (folder / "2024-10-01.csv").write_text(DAY_1)
    (folder / "__MACOSX" / "._2024-10-01.csv").write_text("junk")
    (folder / "._2024-10-01.csv").write_text("junk")
    (folder / ".DS_Store").write_text("junk")
    return folder


def test_types_by_name():
    kinds = {f.name: f.dataType.simpleString() for f in panel_schema([*HEADER, "pod_id", "is_legacy_format"])}
    assert kinds == {
        "date": "date", "serial_number": "string", "model": "string", "capacity_bytes": "bigint",
        "failure": "tinyint", "datacenter": "string", "smart_5_normalized": "double", "smart_5_raw": "double",
        "pod_id": "string", "is_legacy_format": "string",
    }


def test_day_files(spark, landing):
    assert read_header(spark, str(landing)) == HEADER
    rows = read_day_files(spark, str(landing)).orderBy("serial_number").collect()
    assert [r.serial_number for r in rows] == ["A", "B"]
    assert rows[0].date == date(2024, 10, 1) and rows[0].smart_5_raw == 4000.0
    assert rows[1].capacity_bytes is None and rows[1].smart_5_raw is None and rows[1].datacenter is None


def test_changed_header_stops_the_job(spark, landing):
    (landing / "2024-10-03.csv").write_text(DAY_2.replace("smart_5_raw", "smart_9_raw"))
    with pytest.raises(Exception):
        read_day_files(spark, str(landing), HEADER).collect()


def test_bad_value_stops_the_job(spark, landing):
    (landing / "2024-10-03.csv").write_text(DAY_2.replace(",8\n", ",eight\n"))
    with pytest.raises(Exception):
        read_day_files(spark, str(landing), HEADER).agg(F.sum("smart_5_raw")).collect()


def test_zipped_quarter_equals_plain_files(spark, landing, tmp_path):
    (landing / "2024-10-02.csv").write_text(DAY_2)
    archive = tmp_path / "q4.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data/2024-10-01.csv", DAY_1)
        z.writestr("data/2024-10-02.csv", DAY_2)
        z.writestr("__MACOSX/data/._2024-10-02.csv", "junk")
        z.writestr("data/._2024-10-02.csv", "junk")
        z.writestr("data/.DS_Store", "junk")
    zipped = read_zipped_quarters(spark, [str(archive)], HEADER)
    plain = read_day_files(spark, str(landing), HEADER)
    assert zipped.schema == plain.schema
    assert zipped.exceptAll(plain).isEmpty() and plain.exceptAll(zipped).isEmpty()


def test_panel_round_trip_and_pruning(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    later = panel.withColumn("date", F.add_months("date", 4))
    both = panel.unionByName(later)
    write_panel(both, path)
    back = read_panel(spark, path)
    assert back.drop("quarter").select(both.columns).exceptAll(both).isEmpty()
    one = in_quarters(back, ["2024-Q1"])
    assert one.count() == panel.count()
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()
    audit = {r.quarter: r.rows for r in ingest_audit(back).collect()}
    assert sum(audit.values()) == both.count() and audit["2024-Q1"] == panel.count()


def test_repeated_unit_days(spark, panel):
    twice = panel.unionByName(panel)
    once = one_row_per_day(twice)
    assert once.count() == panel.count()
    assert once.select(panel.columns).exceptAll(panel).isEmpty()


def test_bucketed_panel_needs_no_shuffle(spark, panel, tmp_path):
    from fleetlife.operators.lifecycle import unit_lives
    from fleetlife.plans.datasets import rolling_split
    from fleetlife.sources.testdata import EVENT_SETTINGS

    write_bucketed_panel(panel, "bucketed_panel", str(tmp_path / "bucketed"), 4)
    table = spark.table("bucketed_panel")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = rolling_split(table, unit_lives(table), EVENT_SETTINGS.splits["val"], 7)
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        expected = rolling_split(panel, unit_lives(panel), EVENT_SETTINGS.splits["val"], 7)
        assert split.count() == expected.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_panel")


def test_hot_placeholder_unit(spark, panel, tmp_path):
    """A unit that repeats one day many times is one row per day before anything is sorted."""
    copies = F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("copy")
    hot = panel.limit(1).select("*", copies).drop("copy")
    path = str(tmp_path / "hot")
    write_panel(panel.unionByName(hot), path)
    assert read_panel(spark, path).count() == panel.count()


def test_report_sink(spark, tmp_path):
    write_report(spark.range(3), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


def test_only_new_days_are_ingested(spark, landing, tmp_path):
    places = [str(tmp_path / n) for n in ("panel", "checkpoint")]

    def run():
        ingest_new_days(spark, str(landing), *places, HEADER).awaitTermination()
        return read_panel(spark, places[0]).count()

    assert run() == 2
    assert run() == 2
    (landing / "2024-10-02.csv").write_text(DAY_2)
    assert run() == 3
    assert [r.quarter for r in read_panel(spark, places[0]).select("quarter").distinct().collect()] == ["2024-Q4"]


def test_stream_adds_to_a_stored_panel(spark, landing, tmp_path):
    path = str(tmp_path / "panel")
    jobs.ingest(spark, [str(landing)], HEADER, str(tmp_path))
    later = tmp_path / "later"
    later.mkdir()
    (later / "2024-10-02.csv").write_text(DAY_2)
    (later / "2024-10-01.csv").write_text(DAY_1)  # the stored day once more
    ingest_new_days(spark, str(later), path, str(tmp_path / "checkpoint"), HEADER).awaitTermination()
    rows = read_panel(spark, path).orderBy("date", "serial_number").collect()
    assert [(r.date.day, r.serial_number) for r in rows] == [(1, "A"), (1, "B"), (2, "A")]
    assert read_panel(spark, path).columns == [*HEADER, "quarter"]


def test_two_streams_into_one_panel(spark, tmp_path):
    """Each has batches of its own: the second doesn't replace the first, nor does a checkpoint made anew."""
    path = str(tmp_path / "panel")
    texts = [DAY_2.replace("2024-10-02", f"2024-10-0{d}") for d in (2, 3, 4)]
    for k, text in enumerate(texts):
        folder = day_folder(tmp_path / f"landing{k}", f"day{k}", text)
        ingest_new_days(spark, folder, path, str(tmp_path / f"checkpoint{k}"), HEADER).awaitTermination()
        assert read_panel(spark, path).count() == k + 1
    assert sorted(r.date.day for r in read_panel(spark, path).collect()) == [2, 3, 4]


def test_repeats_across_batches(spark, landing, tmp_path):
    """The later batch wins over the earlier one and over the panel, unless an older row reports a failure."""
    path, later = str(tmp_path / "panel"), tmp_path / "later"
    jobs.ingest(spark, [str(landing)], HEADER, str(tmp_path))
    stored = {r.serial_number: r for r in read_panel(spark, path).collect()}
    rows = [line.split(",") for line in DAY_1.strip().splitlines()[1:]]
    later.mkdir()
    at = {name: i for i, name in enumerate(HEADER)}

    def say(number, values):
        lines = [",".join(HEADER)]
        for serial, reading, failure in values:
            own = list(next(r for r in rows if r[at["serial_number"]] == serial))
            own[at["smart_5_raw"]], own[at["failure"]] = str(reading), str(failure)
            lines.append(",".join(own))
        (later / f"{number}.csv").write_text("\n".join(lines) + "\n")
        ingest_new_days(spark, str(later), path, str(tmp_path / "checkpoint"), HEADER).awaitTermination()
        return {r.serial_number: (r.smart_5_raw, r.failure) for r in read_panel(spark, path).collect()}

    other = (stored["B"].smart_5_raw, stored["B"].failure)
    assert say(1, [("A", 11, 0), ("A", 11, 0)]) == {"A": (11.0, 0), "B": other}
    assert say(2, [("A", 12, 1)]) == {"A": (12.0, 1), "B": other}
    assert say(3, [("A", 13, 0), ("B", 14, 1)]) == {"A": (12.0, 1), "B": (14.0, 1)}


def test_stream_keeps_pruning(spark, panel, tmp_path):
    """With streamed batches, a span still reads its quarters and its columns only, on both sides."""
    from fleetlife.operators.lifecycle import in_span

    path = str(tmp_path / "panel")
    older = panel.withColumn("date", F.add_months("date", 7))
    write_panel(panel.unionByName(older), path)
    landing = tmp_path / "landing"
    fresh = panel.withColumn("date", F.add_months("date", 14))
    again = panel.where("date = '2024-01-07'")
    fresh.unionByName(again).coalesce(1).write.option("header", True).csv(str(landing))
    ingest_new_days(spark, str(landing), path, str(tmp_path / "checkpoint"), panel.columns).awaitTermination()
    whole = read_panel(spark, path)
    assert whole.count() == 3 * panel.count()
    span = Span(date(2024, 1, 5), date(2024, 1, 20))
    asked = in_span(whole, span).select("serial_number", "date", "smart_5_raw")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "smart_5_raw" in line]
    assert len(scans) == 2
    for line in scans:
        assert "PartitionFilters: [isnotnull(quarter" in line
        for other in ("capacity_bytes", "model", "smart_197_raw"):
            assert other not in line.split("ReadSchema")[1]
    assert asked.count() == in_span(panel, span).count()


def test_header_of_an_archive(spark, tmp_path):
    archive = tmp_path / "q4.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("data/._2024-10-01.csv", "junk")
        z.writestr("data/2024-10-01.csv", DAY_1)
    assert jobs.header_of(spark, [str(archive)]) == list(HEADER)
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.txt", "nothing")
    with pytest.raises(ValueError):
        jobs.header_of(spark, [str(tmp_path / "none.zip")])


def day_folder(folder, name, text):
    folder.mkdir()
    (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_ingests_keep_what_is_stored(spark, tmp_path):
    """One quarter, then two folders at once (one of them with the same quarter again), then nothing new."""
    first = day_folder(tmp_path / "a", "2024-10-01", DAY_1)
    second = day_folder(tmp_path / "b", "2024-10-02", DAY_2)
    third = day_folder(tmp_path / "c", "2025-01-05", DAY_2.replace("2024-10-02", "2025-01-05"))
    audit = jobs.ingest(spark, [first], HEADER, str(tmp_path)).collect()
    assert [(r.quarter, r.rows) for r in audit] == [("2024-Q4", 2)]
    audit = jobs.ingest(spark, [second, third], HEADER, str(tmp_path)).collect()
    assert sorted((r.quarter, r.days, r.rows) for r in audit) == [("2024-Q4", 2, 3), ("2025-Q1", 1, 1)]
    audit = jobs.ingest(spark, [third], HEADER, str(tmp_path)).collect()
    assert [(r.quarter, r.rows) for r in audit] == [("2025-Q1", 1)]
    assert read_panel(spark, str(tmp_path / "panel")).count() == 4


def test_repeated_day_is_one_whole_row(spark):
    rows = [("A", date(2024, 10, 1), 0, 9.0, None), ("A", date(2024, 10, 1), 1, None, 5.0), ("A", date(2024, 10, 1), 1, 2.0, 3.0)]
    frame = spark.createDataFrame(rows, "serial_number string, date date, failure tinyint, x double, y double")
    assert [tuple(r) for r in one_row_per_day(frame).collect()] == [rows[2]]


def test_spans_read_their_quarters_only(spark, panel, tmp_path):
    from fleetlife.operators.windows import rolling_span
    from fleetlife.plans.datasets import label_counts, point_in_time_split, survival_split
    from fleetlife.operators.lifecycle import unit_lives

    path = str(tmp_path / "panel")
    write_panel(panel.unionByName(panel.withColumn("date", F.add_months("date", 7))), path)
    stored = read_panel(spark, path)
    span = Span(date(2024, 1, 5), date(2024, 1, 20))
    lives = unit_lives(panel)
    jobs_of_a_span = [
        rolling_span(stored, span), label_counts(stored, lives, span, 7),
        point_in_time_split(stored, lives, span, 7), survival_split(stored, lives, span),
    ]
    for frame in jobs_of_a_span:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(quarter" in plan and "quarter#" in plan.split("PartitionFilters: [")[1][:120]
    assert rolling_span(stored, span).count() == rolling_span(panel, span).count()


def test_names_of_quarters_sort_like_days():
    assert [quarter_name(date(2023, m, 1)) for m in (1, 3, 4, 12)] == ["2023-Q1", "2023-Q1", "2023-Q2", "2023-Q4"]
    assert quarter_name(date(2023, 12, 31)) < quarter_name(date(2024, 1, 1))


def test_staged_tables_can_be_dropped(spark):
    import os

    from fleetlife.session import drop_staged, stage

    frame = stage(spark.range(3))
    folder = frame.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert frame.count() == 3 and os.path.isdir(folder)
    import fleetlife.session as session

    kept, session._STAGED[:] = session._STAGED[:-1], session._STAGED[-1:]
    drop_staged(spark)
    session._STAGED[:] = kept  # other tests still use theirs
    assert not os.path.exists(folder)
