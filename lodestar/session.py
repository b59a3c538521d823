"""Spark sessions with the settings this library is written for."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def session(app: str = "lodestar", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC, Arrow. On a cluster leave master and partitions to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {})
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@contextmanager
def step(message: str, say=print) -> Iterator[None]:
    """Says how long a step took."""
    began = time.monotonic()
    yield
    seconds = time.monotonic() - began
    say(f"{message}: {int(seconds // 60)} min {seconds % 60:.1f} s" if seconds >= 60 else f"{message}: {seconds:.1f} s")
