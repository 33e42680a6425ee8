"""Adding up large arrays of counts over all tasks, through a shuffle of their parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Values in a part; an index in a part has 16 bits.
PART = 1 << 13
COLUMNS = "part int, places binary, counts binary"


def parts(counts: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
    """The parts of one task's counts that hold any, with the places and values that are not 0."""
    out: tuple[list[int], list[bytes], list[bytes]] = ([], [], [])
    for part, own in enumerate(counts.reshape(-1, PART)):
        if len(at := np.flatnonzero(own)):
            for column, x in zip(out, (part, at.astype(np.uint16).tobytes(), own[at].astype(np.uint32).tobytes())):
                column.append(x)
    return out


def added(sent: DataFrame, size: int) -> np.ndarray:
    """The sum of the parts that all tasks sent, as an array of `size` numbers in the driver; the caller fixes that size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, places, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = sums.setdefault(part, np.zeros(PART, np.float64))
                own[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())], names=["part", "sums"])

    total = np.zeros((size // PART, PART), np.float32)
    for row in sent.repartition("part").mapInArrow(add, "part int, sums binary").collect():  # of fixed size; an iterator would run a job for each partition
        total[row.part] = np.frombuffer(bytes(row.sums), np.float32)
    return total.reshape(-1)
