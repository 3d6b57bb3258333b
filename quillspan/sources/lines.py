"""NDJSON as a streaming sink: lines of JSON that show up epoch by epoch, each once.

Tasks write files under a staging folder; an epoch's files are moved into place by its commit, which a manifest ends.
A commit that comes again (the epoch was retried after a failure) moves nothing, and readers take manifests' files alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, which executors reach alike."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class LineWriter(DataSourceStreamWriter):
    def __init__(self, path: str, fail_epoch: int | None) -> None:
        self.path, self.fail_epoch = path, fail_epoch

    def write(self, iterator: Iterator[Row]) -> Written:
        lines = [json.dumps(r.asDict(True), ensure_ascii=False, default=str) for r in iterator]
        if not lines:
            return Written(None, 0)
        store, root = _store(self.path)
        store.create_dir(f"{root}/_staged")
        name = f"{uuid.uuid4().hex}-{TaskContext.get().partitionId():05d}.json"
        with store.open_output_stream(f"{root}/_staged/{name}") as out:
            out.write(("\n".join(lines) + "\n").encode())
        return Written(name, len(lines))

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, root = _store(self.path)
        manifest = f"{root}/_epochs/{batchId:012d}"
        files = sorted(m.file for m in messages if m is not None and m.file)
        if store.get_file_info(manifest).type == fs.FileType.File:
            self._drop(messages)  # this epoch is there already
            return
        store.create_dir(f"{root}/_epochs")
        for name in files:
            store.move(f"{root}/_staged/{name}", f"{root}/{batchId:012d}-{name}")
        if self.fail_epoch == batchId:
            raise OSError(f"epoch {batchId} fails before its manifest")  # for tests of what a failure leaves
        with store.open_output_stream(f"{manifest}.tmp") as out:
            out.write(json.dumps([f"{batchId:012d}-{name}" for name in files]).encode())
        store.move(f"{manifest}.tmp", manifest)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self._drop(messages)

    def _drop(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m is not None and m.file and store.get_file_info(f"{root}/_staged/{m.file}").type == fs.FileType.File:
                store.delete_file(f"{root}/_staged/{m.file}")


class Lines(DataSource):
    """The format "lines": df.writeStream.format("lines").option("path", folder). fail_epoch makes that epoch's commit fail."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        fail = self.options.get("fail_epoch")
        return LineWriter(self.options["path"], int(fail) if fail else None)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) of the epochs that were committed; what a failed epoch has left is not among them."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/_epochs", allow_not_found=True))
    names: list[str] = []
    for info in sorted(found, key=lambda f: f.base_name):  # a manifest for each epoch
        if info.base_name.isdigit():
            with store.open_input_stream(info.path) as f:
                names += json.loads(f.read())
    files = [f"{path.rstrip('/')}/{n}" for n in names]
    return spark.read.text(files) if files else spark.createDataFrame([], "value string")
