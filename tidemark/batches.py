"""Arrow batches of texts, kept small."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: int, budget: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of about ``budget`` bytes of text and at most ``rows`` rows, so that memory doesn't
    depend on the batch size. A longer text gets a slice of its own; no text is cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64()))
        part = (np.cumsum(size) - size) // budget
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.arange(1, len(size)) % rows == 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)
        give_back()


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller Arrow batches for rows that hold whole texts, unless the session was given a size (10000 too).

    The size is read when a result is computed, so it stays set in the session; unset it by spark.conf.unset.
    """
    if _ROWS not in spark.conf.getAll:
        spark.conf.set(_ROWS, str(rows))
