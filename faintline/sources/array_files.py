"""Files of nested arrays: one row of samples and a trailing label per event (``.npy``).

``read_event_arrays`` maps the files into memory and reads a range of events per task.
``write_event_arrays`` writes files of bounded size, task by task, below a folder all executors share.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from faintline.sources.schemas import EVENT_ARRAYS

ROWS_PER_BATCH = 64
BYTES_PER_FILE = 256 * 1024 * 1024


def mounted(path: str) -> str:
    """A path that tasks can open as a file; object-store addresses must be mounted first."""
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"array files need a mounted folder, not {path}")
    return path


class EventRange(InputPartition):
    def __init__(self, path: str, first_id: int, start: int, stop: int):
        self.path, self.first_id, self.start, self.stop = path, first_id, start, stop


class EventArrayReader(DataSourceReader):
    def __init__(self, path: str, events_per_partition: int):
        self.path, self.per = path, events_per_partition

    def partitions(self) -> list[EventRange]:
        files = sorted(glob.glob(os.path.join(self.path, "*.npy"))) if os.path.isdir(self.path) else [self.path]
        ranges, first_id = [], 0
        for file in files:
            n = np.load(file, mmap_mode="r").shape[0]  # reads the header only
            ranges += [EventRange(file, first_id, i, min(i + self.per, n)) for i in range(0, n, self.per)]
            first_id += n
        return ranges

    def read(self, part: EventRange) -> Iterator[pa.RecordBatch]:
        stored = np.load(part.path, mmap_mode="r")
        for i in range(part.start, part.stop, ROWS_PER_BATCH):
            rows = np.asarray(stored[i : min(i + ROWS_PER_BATCH, part.stop)], dtype="float64")
            rows = rows.reshape(len(rows), -1)
            offsets = np.arange(len(rows) + 1, dtype="int32") * rows.shape[1]
            ids = np.arange(part.first_id + i, part.first_id + i + len(rows))
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), values], ["event_id", "vals"])


class EventArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_arrays"

    def schema(self):
        return EVENT_ARRAYS

    def reader(self, schema) -> DataSourceReader:
        return EventArrayReader(self.options["path"], int(self.options.get("eventsperpartition", "256")))


def read_event_arrays(spark: SparkSession, path: str, events_per_partition: int = 256) -> DataFrame:
    """``event_id, vals``; ids are positions, counted through the files in name order."""
    spark.dataSource.register(EventArraySource)
    path = mounted(path)
    return (
        spark.read.format("event_arrays").option("path", path).option("eventsPerPartition", events_per_partition).load()
    )


def write_event_arrays(df: DataFrame, path: str, order: str = "event_id", values: str = "vals") -> int:
    """Write arrays in the order of ``order``; returns the number of events written.

    A file holds at most ``BYTES_PER_FILE`` of samples, so a task never keeps its whole partition. It
    appears under its name only when complete, and a repeated task replaces its own files.
    """
    path = mounted(path)
    os.makedirs(path, exist_ok=False)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        held, size, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            final = os.path.join(path, f"part-{context.partitionId():06d}-{number:06d}.npy")
            partial = f"{final}.{context.taskAttemptId()}.tmp"
            with open(partial, "wb") as out:
                np.save(out, rows[:, None, :])
            os.replace(partial, final)
            return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                piece = batch.column(values).slice(start, ROWS_PER_BATCH)
                held.append(piece.flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1))
                size += held[-1].nbytes
                if size >= BYTES_PER_FILE:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    ordered = df.select(order, values).repartitionByRange(order).sortWithinPartitions(order)
    return ordered.mapInArrow(store, "n long").groupBy().sum("n").first()[0] or 0
