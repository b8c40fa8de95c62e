"""Writing several tables so that a reader sees all of them, or none.

Tables are staged below ``_data/<run>``; a numbered file below ``_commits`` that
names them makes them visible.  It is created only if no file has its number, so
of two writers one fails; a file still being written does not parse, and readers
take the newest one that does.  A run that fails halfway is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..errors import ReadOnlyTarget

COMMITS, DATA = "_commits", "_data"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm


def _path(jvm, *parts: str):
    return jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _list(fs, jvm, *parts: str) -> list[str]:
    at = _path(jvm, *parts)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at))


def _commits(spark: SparkSession, root: str) -> list[str]:
    fs, jvm = _fs(spark, root)
    return [n for n in _list(fs, jvm, root, COMMITS) if n.isdigit()]


def committed(spark: SparkSession, root: str) -> dict[str, str]:
    """``table -> path`` of the newest commit; empty before the first."""
    for number in reversed(_commits(spark, root)):
        text = spark.read.option("wholetext", True).text(f"{root}/{COMMITS}/{number}").first()
        try:
            names = json.loads(text["value"]) if text else None
        except ValueError:
            continue
        if names is not None:
            return {t: f"{root}/{p}" for t, p in names.items()}
    return {}


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def stage_tables(tables: Mapping[str, DataFrame], root: str,
                 write: Callable[[DataFrame, str], None] = write_parquet) -> dict[str, str]:
    """Write ``tables`` below a new run; nobody sees them until ``publish`` names them."""
    run = uuid.uuid4().hex
    paths = {name: f"{DATA}/{run}/{name}" for name in tables}
    for name, df in tables.items():
        write(df, f"{root}/{paths[name]}")
    return paths


def discard(spark: SparkSession, root: str, paths: Mapping[str, str]) -> None:
    """Remove staged tables that are not to be published."""
    fs, jvm = _fs(spark, root)
    for run in {p.rsplit("/", 1)[0] for p in paths.values()}:
        fs.delete(_path(jvm, root, run), True)


def publish(spark: SparkSession, root: str, paths: Mapping[str, str], keep_others: bool = True) -> dict[str, str]:
    """Make staged tables visible together.

    Tables of the previous commit stay unless staged again, or are dropped with
    ``keep_others=False``.  If another writer has taken the number, this fails
    and leaves the other's commit in place.
    """
    fs, jvm = _fs(spark, root)
    done = _commits(spark, root)
    names = {t: p[len(root) + 1:] for t, p in committed(spark, root).items()} if keep_others else {}
    names.update(paths)
    number = f"{int(done[-1]) + 1 if done else 1:020d}"
    fs.mkdirs(_path(jvm, root, COMMITS))
    try:
        out = fs.create(_path(jvm, root, COMMITS, number), False)  # fails where the file exists
    except Py4JJavaError as e:
        raise RuntimeError(f"another writer committed {number} below {root} first") from e
    out.write(bytearray(json.dumps(names, sort_keys=True).encode()))
    out.close()
    return {t: f"{root}/{p}" for t, p in names.items()}


def commit_tables(tables: Mapping[str, DataFrame], root: str,
                  write: Callable[[DataFrame, str], None] = write_parquet,
                  keep_others: bool = True, read_only: bool = False) -> dict[str, str]:
    """Write ``tables`` and make them visible together; refused for a read-only target."""
    if read_only:
        raise ReadOnlyTarget("the target is read-only")
    spark = next(iter(tables.values())).sparkSession
    return publish(spark, root, stage_tables(tables, root, write), keep_others)


def read_committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(committed(spark, root)[table])


def prune_stale(spark: SparkSession, root: str) -> list[str]:
    """Remove table directories the newest commit does not name, and older
    commit files.  Run it when no reader is still on an older commit."""
    fs, jvm = _fs(spark, root)
    kept = {p[len(root) + 1:] for p in committed(spark, root).values()}
    removed = []
    for run in _list(fs, jvm, root, DATA):
        for table in _list(fs, jvm, root, DATA, run):
            if f"{DATA}/{run}/{table}" not in kept:
                fs.delete(_path(jvm, root, DATA, run, table), True)
                removed.append(f"{DATA}/{run}/{table}")
        if not _list(fs, jvm, root, DATA, run):
            fs.delete(_path(jvm, root, DATA, run), True)
    for number in _commits(spark, root)[:-1]:
        fs.delete(_path(jvm, root, COMMITS, number), False)
    return removed
