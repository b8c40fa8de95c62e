"""Named sources of tables, and what may be written to them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import ReadOnlyTarget, SpecError
from ..functions.names import closest
from ..session import pin_session
from ..spec import TableSpec

Reader = Callable[[SparkSession, str], DataFrame]


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """One table, read with the session settings results depend on."""
    reader = pin_session(spark).read.format(fmt).options(**options)
    if fmt == "parquet":
        # Wall-clock timestamps stay wall-clock.
        reader = reader.option("inferTimestampNTZ", "true")
    return reader.load(path)


def parquet_dir(root: str) -> Reader:
    return lambda spark, name: read_table(spark, f"{root}/{name}.parquet")


def jdbc_source(url: str, partitions: Mapping[str, Mapping[str, object]] | None = None,
                **options) -> Reader:
    """Tables of a SQL engine.

    ``partitions`` gives a table's ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions``; a table without them is read by one
    connection, so large ones need them.
    """
    def read(spark: SparkSession, name: str) -> DataFrame:
        extra = {k: str(v) for k, v in (partitions or {}).get(name, {}).items()}
        return pin_session(spark).read.format("jdbc").options(
            url=url, dbtable=name, **{k: str(v) for k, v in options.items()}, **extra
        ).load()

    return read


@dataclass
class Source:
    reader: Reader
    read_only: bool = False
    jdbc_url: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)


class TableSet:
    """Sources by name.  Without a name the default one is used: the only one,
    or the one called ``default``."""

    def __init__(self, spark: SparkSession, sources: Mapping[str, Source | Reader],
                 default: str | None = None):
        self.spark = pin_session(spark)
        self.sources = {
            n: s if isinstance(s, Source) else Source(s) for n, s in sources.items()
        }
        self._default = default

    @property
    def default(self) -> str:
        if self._default is not None:
            return self._default
        if "default" in self.sources:
            return "default"
        if len(self.sources) == 1:
            return next(iter(self.sources))
        raise SpecError(f"name a source; there are {', '.join(sorted(self.sources))}")

    def source(self, name: str | None = None) -> Source:
        name = name or self.default
        if name not in self.sources:
            near = closest(name, self.sources)
            hint = f"; did you mean {near!r}?" if near else ""
            raise SpecError(f"no source named {name!r}{hint}")
        return self.sources[name]

    def read(self, table: str, source: str | None = None) -> DataFrame:
        return self.source(source).reader(self.spark, table)

    def read_all(self, specs: Mapping[str, TableSpec], source: str | None = None):
        return {name: self.read(name, source) for name in specs}

    def view(self, table: str, source: str | None = None) -> str:
        self.read(table, source).createOrReplaceTempView(table)
        return table

    def check_writable(self, name: str | None = None) -> Source:
        """Refuse before any job runs when the target is marked read-only."""
        found = self.source(name)
        if found.read_only:
            raise ReadOnlyTarget(
                f"source {name or self.default!r} is read-only; choose a writable one or "
                "clear the flag"
            )
        return found

    def write_jdbc(self, df: DataFrame, table: str, name: str | None = None,
                   mode: str = "append", batchsize: int = 500) -> None:
        target = self.check_writable(name)
        if target.jdbc_url is None:
            raise SpecError("this source has no JDBC address to write to")
        df.write.format("jdbc").mode(mode).options(
            url=target.jdbc_url, dbtable=table, batchsize=str(batchsize), **target.options
        ).save()
