"""Incremental ingest: only day files that were not seen before are read."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from fleetlife.contracts import HORIZONS
from fleetlife.plans.lifestate import apply_days
from fleetlife.sources.panel import one_row_per_day, panel_schema, stream_folder, with_quarter


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the engine gave the stream of this checkpoint; it stays as long as the checkpoint does."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def ingest_new_days(
    spark: SparkSession,
    landing: str,
    panel: str,
    checkpoint: str,
    header: Sequence[str],
    files_per_batch: int = 1000,
    life: str | None = None,
    horizons: Sequence[int] = tuple(HORIZONS),
) -> StreamingQuery:
    """Add all new day files of ``landing`` to the panel, then stop.

    Each batch is a folder of its own beside the panel, named by the stream's id and the batch's number, which
    ``read_panel`` reads together with the rest. A batch that is run again after a failure replaces its folder,
    so it adds no row twice; another stream, or one whose checkpoint was made anew, has another id. Repeated
    unit-days of a batch are merged when it is written. With ``life``, the folder of a life history
    (``plans.lifestate``), that is brought up to date with every batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        name = stream_id(batch.sparkSession, checkpoint)
        (
            with_quarter(one_row_per_day(batch))
            .write.mode("overwrite")
            .option("compression", "zstd")
            .partitionBy("quarter")
            .parquet(f"{stream_folder(panel)}/stream={name}/batch={number}")
        )
        if life is not None:
            apply_days(batch.sparkSession, life, batch, f"{name}-{number}", horizons)

    stream = (
        spark.readStream.schema(panel_schema(header))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(landing)
    )
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
