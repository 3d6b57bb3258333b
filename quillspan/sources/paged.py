"""A paged web API as a Spark data source: one partition for each page, read until an empty or failed page.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("resource", "posts").option("fetch", "package.module:function").option("pages", 10).load()

The fetch function takes (resource, page, per_page) and returns a list of rows (id, title, link, categories), empty past
the end. Offline, a folder serves the pages: lines of JSON under page=1, page=2 and so on.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "id long, title string, link string, categories array<long>"


def served(resource: str, page: int, per_page: int) -> list[tuple]:
    """The rows of a page of a folder that all executors reach, by their ids; none past the end."""
    store, root = fs.FileSystem.from_uri(resource) if ":/" in resource else (fs.LocalFileSystem(), resource)
    rows = []
    for info in store.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                rows += [json.loads(line) for line in f.read().decode().splitlines()]
    return sorted((r["id"], r.get("title"), r.get("link"), r.get("categories")) for r in rows)[:per_page]


class PagePartition(InputPartition):
    def __init__(self, page: int) -> None:
        self.page = page


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.resource, self.per_page, self.pages = options.get("resource", "posts"), int(options.get("per_page", 100)), int(options.get("pages", 100))
        self.fetch = options.get("fetch", f"{__name__}:served")

    def partitions(self) -> list[InputPartition]:
        return [PagePartition(i) for i in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.fetch.partition(":")
        yield from getattr(importlib.import_module(module), name)(self.resource, partition.page, self.per_page)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str | StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)
