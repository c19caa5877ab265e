"""A Python function per event, and the facade over load, split and reshape."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.operators.aggregate import to_arrays
from faintline.operators.prep import split_events


def apply_per_event(events: DataFrame, fn: Callable[[dict], pd.DataFrame | None], schema: str) -> DataFrame:
    """Run ``fn`` on every event row and stack the rows it returns.

    An event is one row (its samples an array), so nothing is gathered or shuffled. Events for which
    ``fn`` raises ValueError or returns None are skipped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for record in pdf.to_dict("records"):
                try:
                    out = fn(record)
                except ValueError:
                    continue
                if out is not None:
                    yield out

    return events.mapInPandas(run, schema)


def apply_to_batches(
    events: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "event_id"
) -> DataFrame:
    """Run ``fn`` on batches of event rows; it returns rows of ``schema``, which holds ``key``.

    The result has one more column, ``error``: null in rows that ``fn`` returned. A batch for which ``fn``
    raises ValueError is halved until the event that fails is alone; it gives one row with its key and the
    message, and all other events keep their results.
    """
    fields = T._parse_datatype_string(schema)
    names = fields.names

    def attempt(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            yield fn(batch).assign(error=None)[[*names, "error"]]
        except ValueError as error:
            if len(batch) == 1:
                failed = {n: batch[key].tolist() if n == key else [None] for n in names}
                yield pd.DataFrame({**failed, "error": [str(error)]})
                return
            half = len(batch) // 2
            yield from attempt(batch.iloc[:half])
            yield from attempt(batch.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield from attempt(batch)

    return events.mapInPandas(run, T.StructType([*fields.fields, T.StructField("error", T.StringType())]))


class EventSeries:
    """Load a range of events, split them, and take their arrays.

    >>> series = EventSeries(strain).load(0, 1500).split(0.1)   # doctest: +SKIP
    >>> train = series.arrays("train")                          # doctest: +SKIP
    """

    def __init__(self, rows: DataFrame):
        self._rows = rows
        self.rows: DataFrame | None = None
        self.splits: DataFrame | None = None

    def load(self, low: int | None = None, high: int | None = None) -> EventSeries:
        """Events from ``low`` to ``high``, both included; without a bound, all on that side."""
        self.rows = self._rows
        if low is not None:
            self.rows = self.rows.filter(F.col("event_id") >= low)
        if high is not None:
            self.rows = self.rows.filter(F.col("event_id") <= high)
        return self

    def split(self, frac: float = 0.1, seed: int = 23) -> EventSeries:
        if self.rows is None:
            raise RuntimeError("call load before split")
        self.splits = split_events(self.rows, frac, seed)
        return self

    def arrays(self, part: str | None = None) -> DataFrame:
        """One array per event; with ``part`` only the train or test events."""
        if self.rows is None:
            raise RuntimeError("call load before arrays")
        if part is None:
            return to_arrays(self.rows)
        if self.splits is None:
            raise RuntimeError("call split before asking for a part")
        chosen = self.splits.filter(F.col("split") == part).select("event_id")
        return to_arrays(self.rows.join(chosen, "event_id", "left_semi"))
