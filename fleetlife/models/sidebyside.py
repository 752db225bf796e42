"""Several fits at a time on one session: each in a thread, a scheduler pool and a job group of its own."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: How often late jobs are looked for.
WATCH_SECONDS = 0.2


class Late(TimeoutError):
    """A job that was ended at its time limit."""


def side_by_side(
    spark: SparkSession, jobs: Mapping[str, Callable[[], Any]], workers: int = 2, limit_seconds: float | None = None
) -> dict[str, Any]:
    """The result of each job, or the exception that ended it; up to ``workers`` run at a time.

    A job's Spark work is in a job group: one that takes longer than the limit is cancelled by its group and
    ends as ``Late``, and a job that fails leaves the others alone. With a fair scheduler the pools share the
    cluster; otherwise the jobs fill what the others leave free. Time spent waiting for a worker doesn't count.
    """
    context = spark.sparkContext
    free = threading.Semaphore(max(1, workers))
    groups = {name: f"{name}-{uuid.uuid4().hex}" for name in jobs}
    since: dict[str, float] = {}
    results: dict[str, Any] = {}
    late: set[str] = set()

    def run(name: str) -> None:
        with free:
            since[name] = time.monotonic()
            context.setJobGroup(groups[name], name, interruptOnCancel=True)
            context.setLocalProperty("spark.scheduler.pool", groups[name])
            try:
                results[name] = jobs[name]()
            except Exception as problem:  # one bad job must not stop the others
                results[name] = problem
            if name in late:
                results[name] = Late(f"over {limit_seconds:g} seconds")

    threads = {name: InheritableThread(target=run, args=(name,), daemon=True) for name in jobs}
    for thread in threads.values():
        thread.start()
    while waiting := [n for n, t in threads.items() if t.is_alive()]:
        threads[waiting[0]].join(WATCH_SECONDS)
        for name in waiting:
            over = limit_seconds is not None and name in since and time.monotonic() - since[name] > limit_seconds
            if over and name not in results:
                # Again and again: a job may start more Spark work after a part of it was cancelled.
                late.add(name)
                context.cancelJobGroup(groups[name])
    return results
