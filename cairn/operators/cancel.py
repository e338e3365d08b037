"""Cancelling what a thread runs on Spark, from another thread."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Cancelled(Exception):
    """A job was cancelled before it had an effect."""


class Cancellable:
    """A with block whose Spark jobs carry a tag; cancel() stops those that run, and check() raises from then on.

    with Cancellable(spark) as job: ...  # another thread calls job.cancel()
    A failure within the block after cancel() is raised as Cancelled.
    """

    def __init__(self, spark: SparkSession):
        self.sc, self.tag, self.cancelled = spark.sparkContext, f"cairn-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        self.cancelled = True
        self.sc.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled(self.tag)

    def __enter__(self) -> Cancellable:
        self.check()
        self.sc.addJobTag(self.tag)
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.sc.removeJobTag(self.tag)
        if self.cancelled and not isinstance(error, Cancelled):
            raise Cancelled(self.tag) from error
