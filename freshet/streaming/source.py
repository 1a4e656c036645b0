"""A streaming source whose offsets are batches of a feed, in the order of their dates."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "trigger long, batch_date date, file_name string, file string"


class DatedBatches(DataSource):
    """Rows that say which files to read, a trigger's batches at a time.

    Option ``steps`` is a JSON list of triggers: number, and batches of (date or null, name, files) each. An offset is the last batch of a
    trigger, as number, date and name. The plan is made once, from one listing, so no trigger lists anything.
    """

    @classmethod
    def name(cls) -> str:
        return "dated_batches"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(json.loads(self.options["steps"]))


class _Reader(DataSourceStreamReader):
    def __init__(self, steps: list):
        self.steps = steps
        self.done = 0

    def _offset(self, done: int) -> dict:
        if not done:
            return {"done": 0}
        number, batches = self.steps[done - 1]
        return {"done": done, "trigger": number, "date": batches[-1][0], "name": batches[-1][1]}

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        """One trigger further; Spark asks once before each."""
        self.done = min(self.done + 1, len(self.steps))
        return self._offset(self.done)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(step) for step in self.steps[start["done"] : end["done"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime as dt

        number, batches = partition.value
        for date, name, files in batches:
            for file in files:
                yield number, dt.date.fromisoformat(date) if date else None, name, file
