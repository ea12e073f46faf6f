"""A paged source as a Python data source: a partition for each range of pages, and retries with linear back-off."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Row = tuple
Fetch = Callable[[int], list[Row]]


def attempted(fetch: Fetch, page: int, attempts: int = 3, pause: float = 1.0) -> list[Row]:
    """A page's rows; after each failure the pause grows by ``pause`` seconds, and the last failure is raised."""
    for k in range(1, attempts + 1):
        try:
            return fetch(page)
        except OSError:
            if k == attempts:
                raise
            time.sleep(pause * k)
    return []


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Fetch, pages: int, per_task: int):
        self.fetch, self.pages, self.per_task = fetch, pages, per_task

    def partitions(self) -> list[Pages]:
        return [Pages(i, min(i + self.per_task, self.pages + 1)) for i in range(1, self.pages + 1, self.per_task)]

    def read(self, partition: Pages) -> Iterator[Row]:
        for page in range(partition.first, partition.last):
            yield from attempted(self.fetch, page)


def paged(source: str, columns: str, fetch: Fetch) -> type[DataSource]:
    """A data source to register: ``spark.dataSource.register(paged(...))``, then ``spark.read.format(source).option("pages", n)``; option ``perTask`` sets the pages of a task."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return columns

        def reader(self, schema: StructType) -> DataSourceReader:
            return PagedReader(fetch, int(self.options.get("pages", 1)), int(self.options.get("perTask", 4)))

    return Paged
