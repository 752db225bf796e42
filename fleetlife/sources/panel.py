"""The daily panel: schema, day files, zipped quarters, and the partitioned table."""

from __future__ import annotations

import csv
import io
import posixpath
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlife.contracts import STRING_COLUMNS
from fleetlife.session import stage

_SPARK_TYPES = {"date": T.DateType(), "capacity_bytes": T.LongType(), "failure": T.ByteType()}
_ARROW_TYPES = {"date": pa.date32(), "capacity_bytes": pa.int64(), "failure": pa.int8()}


def _is_reading(column: str) -> bool:
    return column.endswith(("_raw", "_normalized"))


def column_type(column: str) -> T.DataType:
    """Pinned types by name; readings are doubles, everything else is text."""
    if column in _SPARK_TYPES:
        return _SPARK_TYPES[column]
    if _is_reading(column) and column not in STRING_COLUMNS:
        return T.DoubleType()
    return T.StringType()


def panel_schema(header: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, column_type(c)) for c in header])


def read_header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Column names from the first line of one day file (folders are searched for ``*.csv``)."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path if isinstance(path, str) else list(path))
    )
    return next(csv.reader([lines.first().value]))


def read_day_files(
    spark: SparkSession, path: str | Sequence[str], header: Sequence[str] | None = None
) -> DataFrame:
    """Typed rows of all day files below a folder or several.

    Types are pinned, nothing is inferred, empty cells are null. A file whose header or values do
    not fit the schema stops the job. Only ``*.csv`` is read; hidden files, ``._*`` copies and
    ``__MACOSX`` folders are skipped by the reader because of their leading dot or underscore.
    """
    header = read_header(spark, path) if header is None else header
    return (
        spark.read.schema(panel_schema(header))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("dateFormat", "yyyy-MM-dd")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(path if isinstance(path, str) else list(path))
    )


def is_day_file(member: str) -> bool:
    """A real day CSV inside an archive, not a system copy."""
    name = posixpath.basename(member)
    return name.endswith(".csv") and "__MACOSX" not in member and not name.startswith("._")


def read_zipped_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line of the first day file in an archive, read by a task like its rows."""

    def first_line(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place in batch["path"]:
                with zipfile.ZipFile(place) as archive:
                    members = sorted(filter(is_day_file, archive.namelist()), key=posixpath.basename)
                    for member in members[:1]:
                        with archive.open(member) as raw:
                            line = io.TextIOWrapper(raw, "utf-8", newline="").readline()
                        yield pd.DataFrame({"line": [line]})

    found = spark.createDataFrame([(path,)], "path string").mapInPandas(first_line, "line string").first()
    if found is None:
        raise ValueError(f"no day file in {path}")
    return next(csv.reader([found.line]))


def read_zipped_quarters(
    spark: SparkSession, paths: Sequence[str], header: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Typed rows from zip archives of day files, one task per group of members.

    Tasks list the members, then the list is spread, and each task streams its members in
    blocks; an archive is never held in memory. The paths must be readable by every executor.
    """
    columns = list(header)
    schema = panel_schema(columns)
    types = {
        c: _ARROW_TYPES.get(c, pa.float64() if isinstance(column_type(c), T.DoubleType) else pa.string())
        for c in columns
    }

    def list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with zipfile.ZipFile(path) as archive:
                    names = [n for n in archive.namelist() if is_day_file(n)]
                yield pd.DataFrame({"path": path, "member": names})

    def read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pacsv.ConvertOptions(
            column_types=types,
            include_columns=columns,
            null_values=[""],
            strings_can_be_null=True,
            quoted_strings_can_be_null=True,
        )
        for batch in batches:
            for row in batch.to_pylist():
                with zipfile.ZipFile(row["path"]) as archive, archive.open(row["member"]) as raw:
                    # Every later file must have the columns of the first one.
                    with pacsv.open_csv(io.BufferedReader(raw), convert_options=options) as reader:
                        for block in reader:
                            yield block

    archives = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1))
    members = archives.mapInPandas(list_members, "path string, member string")
    spread = members.repartition(partitions or spark.sparkContext.defaultParallelism)
    return spread.mapInArrow(read_members, schema)


def with_quarter(panel: DataFrame) -> DataFrame:
    """Add ``quarter`` like 2024-Q4, the partition column of the stored panel."""
    text = F.concat(F.year("date").cast("string"), F.lit("-Q"), F.quarter("date").cast("string"))
    return panel.withColumn("quarter", text)


def one_row_per_day(panel: DataFrame) -> DataFrame:
    """Collapse repeated unit-days to one of their rows, taken whole.

    A row that reports a failure is preferred, then the largest row in the order of the columns, so
    the choice doesn't depend on the input's order. Each task merges its own repeats before the
    shuffle (sorted, because rows hold text), so a placeholder unit that holds a large part of all
    rows moves as a handful of rows per task. Windows rely on this.
    """
    rest = [c for c in panel.columns if c not in ("serial_number", "date")]
    ranked = sorted(rest, key=lambda c: c != "failure")
    best = panel.groupBy("serial_number", "date").agg(F.max(F.struct(*ranked)).alias("_row"))
    return best.select("serial_number", "date", *[F.col("_row")[c].alias(c) for c in rest]).select(panel.columns)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stream_folder(path: str) -> str:
    """Where streams keep their batches, beside the panel they add to: stream=ID/batch=N/quarter=NAME."""
    return f"{path.rstrip('/')}-stream"


def add_to_panel(panel: DataFrame, path: str) -> None:
    """Add rows to the stored panel. Other quarters stay as they are; a quarter that is stored already
    keeps its rows, and a unit-day that comes again is one row."""
    spark = panel.sparkSession
    if path_exists(spark, path):
        stored = spark.read.parquet(path)
        touched = [r[0] for r in with_quarter(panel.select("date")).select("quarter").distinct().collect()]
        # Staged, because the same folders are written.
        panel = panel.unionByName(stage(in_quarters(stored, touched).drop("quarter")), allowMissingColumns=True)
    write_panel(panel, path)


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with zstd, one folder per quarter, one row per unit and day.

    Only the quarters of ``panel`` are replaced. Rows are spread by (quarter, unit), so a quarter is
    written by many tasks, and sorted so that row groups cover few units.
    """
    (
        with_quarter(one_row_per_day(panel))
        .repartition("quarter", "serial_number")
        .sortWithinPartitions("quarter", "serial_number", "date")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("quarter")
        .parquet(path)
    )


def write_bucketed_panel(panel: DataFrame, table: str, path: str, buckets: int) -> None:
    """The panel as a catalog table that is partitioned by quarter and bucketed by unit.

    Windows, summaries and joins by unit then read it without any shuffle. ``buckets`` should
    make a bucket of one quarter a few hundred megabytes.
    """
    (
        with_quarter(one_row_per_day(panel))
        .repartition(buckets, "serial_number")
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .option("compression", "zstd")
        .partitionBy("quarter")
        .bucketBy(buckets, "serial_number")
        .sortBy("serial_number", "date")
        .saveAsTable(table)
    )


#: Columns that name the batch of a streamed row.
BATCH = ("stream", "batch")


def _beaten(stored: DataFrame | None, streamed: DataFrame) -> DataFrame:
    """(serial_number, date, label) of rows that another row of the same unit-day replaces, as a small table.

    A row that reports a failure is preferred, then the later batch; what the panel stores comes before all
    batches (label ""). Only keys are read: all of the stream's, and those of the quarters it touches.
    """
    keys = ["serial_number", "date"]
    mine = streamed.select(*keys, "failure", batch_label().alias("label"))
    if stored is not None:
        # One name per quarter of the stream.
        touched = [r[0] for r in streamed.select("quarter").distinct().collect()]
        again = in_quarters(stored, touched).select(*keys, "failure")
        mine = mine.unionByName(again.join(mine.select(*keys).distinct(), keys, "left_semi").withColumn("label", F.lit("")))
    best = mine.groupBy(*keys).agg(F.max(F.struct("failure", "label"))["label"].alias("best"), F.count(F.lit(1)).alias("rows"))
    return stage(mine.join(best.where("rows > 1"), keys).where(F.col("label") != F.col("best")).select(*keys, "label"))


def batch_label() -> Column:
    """Batches of a stream sort by their number; streams by their id."""
    return F.concat(F.col("stream"), F.lit("/"), F.lpad(F.col("batch").cast("string"), 12, "0"))


def read_panel(spark: SparkSession, path: str, may_repeat: bool = False) -> DataFrame:
    """The stored panel with what streams have added; ``in_span`` reads only the quarters it needs.

    A batch has each unit-day once. Days that a batch repeats from the panel or another batch are found when
    the panel is read, from their keys alone, and left out of both scans by a small anti-join; filters and
    columns reach both sides. ``may_repeat`` merges repeated rows of the panel itself.
    """
    batches = stream_folder(path)
    streamed = path_exists(spark, batches)
    parts = [spark.read.parquet(path)] if path_exists(spark, path) or not streamed else []
    if streamed:
        keys = ["serial_number", "date"]
        added = spark.read.option("mergeSchema", True).parquet(batches).withColumn("stream", F.col("stream").cast("string"))
        columns = [c for c in added.columns if c not in BATCH]
        beaten = _beaten(parts[0] if parts else None, added)
        if not beaten.isEmpty():
            parts = [p.join(beaten.where("label = ''"), keys, "left_anti").select(p.columns) for p in parts]
            added = added.withColumn("label", batch_label()).join(beaten, [*keys, "label"], "left_anti").drop("label")
        parts.append(added.select(columns))
    panel = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    days = [c for c in panel.columns if c != "quarter"]
    panel = panel.select(*days, "quarter") if "quarter" in panel.columns else panel
    return one_row_per_day(panel) if may_repeat else panel


def in_quarters(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    return panel.where(F.col("quarter").isin(list(names)))


def write_report(report: DataFrame, path: str) -> None:
    """A small report table as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)
