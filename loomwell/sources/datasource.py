"""A Spark data source for paged listings on file, one partition a page, and batch fetching that survives bad entries."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition


def fetch_all(ids: list[int], size: int, fetch: Callable[[list[int]], list[dict]]) -> tuple[list[dict], list[int]]:
    """(rows, skipped): batches of ``size``; a batch that fails is halved until the culprit stands alone."""
    rows: list[dict] = []
    skipped: list[int] = []
    waiting = [ids[i : i + size] for i in range(0, len(ids), size)][::-1]
    while waiting:
        batch = waiting.pop()
        try:
            rows += fetch(batch)
        except Exception:
            if len(batch) == 1:
                skipped += batch
            else:
                half = len(batch) // 2
                waiting += [batch[half:], batch[:half]]
    return rows, skipped


class PagedListing(DataSource):
    """format("paged_listing").option("path", folder): page-<n>.json files, each a list of {id, link, modified}.

    Filters on id and modified are taken over by the reader.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "page int, id long, link string, modified string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Page(InputPartition):
    def __init__(self, number: int, file: str):
        super().__init__(number)
        self.number, self.file = number, file


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.taken = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | GreaterThanOrEqual) and f.attribute in (("id",), ("modified",)):
                self.taken.append((f.attribute[0], isinstance(f, EqualTo), f.value))
            else:
                yield f

    def partitions(self) -> list[_Page]:
        found = [(int(m[1]), n) for n in os.listdir(self.path) if (m := re.fullmatch(r"page-(\d+)\.json", n))]
        return [_Page(k, os.path.join(self.path, n)) for k, n in sorted(found)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        with open(partition.file, encoding="utf-8") as f:
            for row in json.load(f):
                if all(row.get(a) is not None and (row[a] == v if same else row[a] >= v) for a, same, v in self.taken):
                    yield partition.number, row.get("id"), row.get("link"), row.get("modified")
