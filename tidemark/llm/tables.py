"""Intermediate tables in the folder that all executors share, and the size of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from tidemark.batches import text_batches
from tidemark.tables import dropped, shared_folder, written

__all__ = ["dropped", "fresh", "narrow_batches", "shared_folder", "text_batches", "written"]
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def narrow_batches(spark: SparkSession, rows: int = 10_000) -> Iterator[None]:
    """Larger Arrow batches for an action over rows of a few numbers."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with marks in front where a table has a column of that name already (in any case)."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out
