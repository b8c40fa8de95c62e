"""Files by name on shared storage: listed, and written one per row, by tasks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

_LISTED = "path string, length long, folder boolean"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that driver and executors share, by its scheme."""
    if re.match(r"^(file:)?/", folder):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", folder)
    return fs.FileSystem.from_uri(folder)


def list_files(spark: SparkSession, base: str) -> DataFrame:
    """``path, length`` of all files below ``base``, empty ones too; hidden names (``.``, ``_``) are left out.

    Folders are listed by tasks, all of one depth in one round; a folder is
    listed by one task, so its own entries are what bounds a task.
    """
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(base)
        for batch in batches:
            for path in batch["path"].to_pylist():
                found = [f for f in store.get_file_info(fs.FileSelector(path)) if not f.base_name.startswith((".", "_"))]
                for i in range(0, len(found), 10_000):
                    part = found[i:i + 10_000]
                    yield pa.record_batch([
                        pa.array([f.path for f in part], pa.string()), pa.array([f.size or 0 for f in part], pa.int64()),
                        pa.array([f.type == fs.FileType.Directory for f in part], pa.bool_())],
                        names=["path", "length", "folder"])

    found: list[DataFrame] = []
    folders = spark.createDataFrame([(file_system(base)[1],)], "path string")
    while True:
        listed = cut(folders.repartition("path").mapInArrow(look, _LISTED))
        found.append(listed.filter("NOT folder").select("path", "length"))
        folders = listed.filter("folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, found)


def write_named(rows: DataFrame, path: str, suffix: str = ".json") -> None:
    """A file ``<path>/<name><suffix>`` for every row (``name, value``), in place of what was in ``path``.

    Tasks write to a folder of their attempt; only attempts Spark has committed
    are then moved to their names, by tasks too.  A move is repeated without
    harm, so lost executors leave neither half a file nor one of a lost attempt.
    """
    stage = f"{path.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    store, root = file_system(path)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        store.delete_dir_contents(root)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(stage)
        attempt = uuid.uuid4().hex
        store.create_dir(f"{root}/{attempt}", recursive=True)
        for batch in batches:
            for name, value in zip(batch["name"].to_pylist(), batch["value"].to_pylist()):
                with store.open_output_stream(f"{root}/{attempt}/{name}{suffix}") as out:
                    out.write(value.encode())
            yield pa.record_batch([batch["name"], pa.repeat(attempt, batch.num_rows)], names=["name", "attempt"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(path)
        _, staged = file_system(stage)
        for batch in batches:
            for name, attempt in zip(batch["name"].to_pylist(), batch["attempt"].to_pylist()):
                at, to = f"{staged}/{attempt}/{name}{suffix}", f"{root}/{name}{suffix}"
                if store.get_file_info(at).type == fs.FileType.NotFound and store.get_file_info(to).type == fs.FileType.File:
                    continue  # moved by an attempt that was lost afterwards
                store.move(at, to)
            yield batch

    schema = "name string, attempt string"
    committed = cut(rows.select("name", "value").mapInArrow(write, schema))
    committed.mapInArrow(move, schema).agg(F.count(F.lit(1))).collect()
    if store.get_file_info(file_system(stage)[1]).type != fs.FileType.NotFound:
        store.delete_dir(file_system(stage)[1])
