"""A set of ids as marked bits, small enough to broadcast whatever the table's size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadsync.llm.text_arrays import mix

MOST_BITS = 1 << 27


def slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def marked(ids: DataFrame, count: int) -> np.ndarray:
    """Marks of the ``count`` ids of a one-column table: 32 bits an id or more, but
    ``MOST_BITS`` at most (16 MB); beyond that more other ids pass, and none is lost."""
    bits = 1 << 16
    while bits < min(32 * count, MOST_BITS):
        bits *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.unique(slots(b.column(0).to_numpy(zero_copy_only=False), bits))
            yield pa.record_batch([pa.array(s >> 6), pa.array((np.uint64(1) << (s & 63).astype(np.uint64)).view(np.int64))], names=["slot", "bits"])

    got = ids.mapInArrow(words, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[got["slot"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return out


def passes(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    s = slots(ids, 64 * len(marks))
    return (marks[s >> 6] >> (s & 63)) & 1 == 1
