"""A paged listing as a data source (S9 of the survey): one partition per page of results.

The listing is read through a function of (offset, size) that returns the rows and the
stated total, so a network client, a folder of saved pages or a test can be behind it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Fetch = Callable[[int, int], tuple[list[dict], int]]


def saved_pages(folder: str) -> Fetch:
    """Pages saved as <offset>.json, each {"total": n, "rows": [...]}, in a folder that all executors see."""

    def fetch(offset: int, size: int) -> tuple[list[dict], int]:
        path = os.path.join(folder, f"{offset}.json")
        if not os.path.exists(path):
            return [], -1
        with open(path, encoding="utf-8") as f:
            page = json.load(f)
        return page["rows"][:size], page["total"]

    return fetch


class PagedSource(DataSource):
    """Options: folder, size. Register with spark.dataSource.register(PagedSource); read with format("paged").schema(...)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, saved_pages(self.options["folder"]), int(self.options.get("size", "100")))


class PagedReader(DataSourceReader):
    """Walks the offsets up to the total stated by the first page; the page at the total must be empty,
    every page but the last full, and all must state the same total."""

    def __init__(self, schema: StructType, fetch: Fetch, size: int):
        self.names, self.fetch, self.size = schema.names, fetch, size

    def partitions(self) -> list[InputPartition]:
        rows, total = self.fetch(0, self.size)
        if total < 0 or len(rows) < min(self.size, total):
            raise ValueError("the first page is missing or short")
        if self.fetch(total + -total % self.size, self.size)[0]:
            raise ValueError("there are rows beyond the stated total")
        self.total = total
        return [InputPartition((offset, total)) for offset in range(0, max(total, 1), self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        offset, total = partition.value
        rows, stated = self.fetch(offset, self.size)
        if stated != total or len(rows) != max(0, min(self.size, total - offset)):
            raise ValueError(f"page at {offset}: {len(rows)} rows of {stated}, expected {min(self.size, total - offset)} of {total}")
        for r in rows:
            yield tuple(json.dumps(r, ensure_ascii=False, sort_keys=True) if n == "value" and "value" not in r else r.get(n) for n in self.names)
