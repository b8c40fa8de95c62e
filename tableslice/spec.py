"""Declared shape of the tables: columns, keys, references, and slice settings.

These are plain driver-side descriptions.  Their size follows the number of
columns and tables, never the number of rows; the rows stay in DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .errors import SpecError

KINDS = (
    "bool", "int", "float", "decimal", "text", "bytes", "uuid", "json",
    "date", "time", "timestamp", "interval", "enum", "array", "other",
)
# Kinds with no order that is both legal and the same everywhere.
UNORDERED_KINDS = frozenset({"json", "array", "enum", "interval", "other"})

LOAD_MODES = ("upsert", "insert", "skip_existing", "truncate_first")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str = "text"
    bits: int | None = None
    precision: int | None = None
    scale: int | None = None
    max_len: int | None = None
    tz: bool = False
    binary: bool = False
    type_name: str | None = None
    of: ColumnSpec | None = None
    labels: tuple[str, ...] | None = None
    nullable: bool = True
    has_default: bool = False
    generated: bool = False
    identity: bool = False
    #: SQL expressions: what an inserted row gets where the seed lacks the column,
    #: and what a generated column is made of.
    default: str | None = None
    computed: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise SpecError(f"column {self.name}: unknown kind {self.kind!r}")
        if self.default is not None:
            object.__setattr__(self, "has_default", True)
        if self.computed is not None:
            object.__setattr__(self, "generated", True)

    @property
    def orderable(self) -> bool:
        return self.kind not in UNORDERED_KINDS

    def label(self) -> str:
        """Short type label used in drift output."""
        k = self.kind
        if k in ("int", "float"):
            return f"{k}{self.bits or 64}"
        if k == "decimal":
            fixed = self.precision is not None and self.scale is not None
            return f"decimal({self.precision},{self.scale})" if fixed else "decimal"
        if k == "text":
            return "text" if self.max_len is None else f"varchar({self.max_len})"
        if k == "json":
            return "jsonb" if self.binary else "json"
        if k in ("time", "timestamp"):
            return k + ("tz" if self.tz else "")
        if k == "enum":
            return f"enum {self.type_name}"
        if k == "array":
            return f"{self.of.label()}[]" if self.of else "array"
        if k == "other":
            return self.type_name or "other"
        return k

    def spark_type(self) -> T.DataType:
        """The Spark type a parsed value of this column is held in."""
        k = self.kind
        if k == "bool":
            return T.BooleanType()
        if k == "int":
            return {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType()}.get(
                self.bits or 64, T.LongType()
            )
        if k == "float":
            return T.FloatType() if self.bits == 32 else T.DoubleType()
        if k == "decimal" and self.precision is not None and self.precision <= 38:
            return T.DecimalType(self.precision, self.scale or 0)
        if k == "bytes":
            return T.BinaryType()
        if k == "date":
            return T.DateType()
        if k == "timestamp":
            return T.TimestampType() if self.tz else T.TimestampNTZType()
        # Wide or unbounded decimals (and decimal NaN), time of day, uuid,
        # json, interval, enum and array text have no lossless Spark type.
        return T.StringType()


def int_col(name, bits=64, **kw):
    return ColumnSpec(name, "int", bits=bits, **kw)


def text_col(name, max_len=None, **kw):
    return ColumnSpec(name, "text", max_len=max_len, **kw)


def double_col(name, **kw):
    return ColumnSpec(name, "float", bits=64, **kw)


@dataclass(frozen=True)
class UniqueKey:
    columns: tuple[str, ...]
    predicate: str | None = None

    @property
    def partial(self) -> bool:
        return self.predicate is not None

    def __str__(self):
        text = f"({', '.join(self.columns)})"
        return f"{text} where {self.predicate}" if self.partial else text


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    references: str
    ref_columns: tuple[str, ...]
    deferrable: bool = False

    def __post_init__(self):
        if len(self.columns) != len(self.ref_columns):
            raise SpecError(f"foreign key {self.columns}: column counts differ")


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[UniqueKey, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()

    def __post_init__(self):
        # Primary-key columns never hold null, whatever was declared.
        if self.primary_key:
            fixed = tuple(
                replace(c, nullable=False) if c.name in self.primary_key else c
                for c in self.columns
            )
            object.__setattr__(self, "columns", fixed)
        for name in self.primary_key:
            self.require(name, "primary key")

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def writable(self) -> list[ColumnSpec]:
        return [c for c in self.columns if not c.generated]

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    def require(self, name: str, where: str) -> ColumnSpec:
        found = self.column(name)
        if found is None:
            raise SpecError(
                f"table {self.name}: `{where}` names {name!r}, which the table does not "
                f"have. Available: {', '.join(self.column_names)}"
            )
        return found

    def conflict_target(self, columns: Sequence[str]) -> UniqueKey | None:
        """The unique key on exactly these columns; a total one wins."""
        same = [u for u in self.unique if tuple(u.columns) == tuple(columns)]
        return min(same, key=lambda u: u.partial, default=None)

    def default_key(self) -> tuple[str, ...]:
        """Primary key, else a unique key (total before partial), else nothing."""
        if self.primary_key:
            return tuple(self.primary_key)
        best = min(self.unique, key=lambda u: u.partial, default=None)
        return tuple(best.columns) if best else ()


@dataclass(frozen=True)
class SliceSpec:
    """What to take from one table, and how to load it."""

    table: str
    where: str | None = None
    order_by: tuple[str, ...] = ()
    limit: int | None = None
    columns: tuple[str, ...] | None = None
    exclude_columns: tuple[str, ...] = ()
    load: str = "upsert"
    key: tuple[str, ...] | None = None
    on_drift: str = "confirm"

    def __post_init__(self):
        if self.load not in LOAD_MODES:
            raise SpecError(f"table {self.table}: unknown load mode {self.load!r}")
        if self.on_drift not in ("abort", "confirm", "ignore"):
            raise SpecError(f"table {self.table}: unknown drift policy {self.on_drift!r}")
        if self.columns is not None and self.exclude_columns:
            raise SpecError(
                f"table {self.table}: give `columns` or `exclude_columns`, not both"
            )
        if self.limit is not None and self.limit < 0:
            raise SpecError(f"table {self.table}: `limit` is negative")


@dataclass(frozen=True)
class SchemaSpec:
    tables: Mapping[str, TableSpec]
    enums: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, *tables: TableSpec, enums=None) -> SchemaSpec:
        return cls({t.name: t for t in tables}, dict(enums or {}))

    def get(self, name: str) -> TableSpec | None:
        return self.tables.get(name)


def bare_name(table: str) -> str:
    return table.rsplit(".", 1)[-1]


def merge_key(spec: TableSpec, slc: SliceSpec | None = None) -> tuple[str, ...]:
    """The columns rows are matched on: an override that is backed by a
    constraint, else the table's own key, else nothing."""
    if slc is None or slc.key is None:
        return spec.default_key()
    for name in slc.key:
        spec.require(name, "key")
    key = tuple(slc.key)
    if key != tuple(spec.primary_key) and spec.conflict_target(key) is None:
        pk = f"({', '.join(spec.primary_key)})" if spec.primary_key else "(none)"
        uq = ", ".join(str(u) for u in spec.unique) or "(none)"
        raise SpecError(
            f"table {spec.name}: key ({', '.join(key)}) is not backed by a constraint; "
            f"its primary key is {pk}, its unique keys are {uq}"
        )
    return key


def selected_columns(spec: TableSpec, slc: SliceSpec) -> list[ColumnSpec]:
    """Columns the slice carries, in the table's order; generated ones never."""
    for name in slc.columns or ():
        if spec.require(name, "columns").generated:
            raise SpecError(
                f"table {spec.name}: column {name!r} in `columns` is generated by the table "
                "and cannot be loaded"
            )
    for name in slc.exclude_columns:
        spec.require(name, "exclude_columns")
    if slc.columns is not None:
        picked = [c for c in spec.writable if c.name in slc.columns]
    else:
        picked = [c for c in spec.writable if c.name not in slc.exclude_columns]
    if not picked:
        raise SpecError(f"table {spec.name}: every column is excluded")
    names = {c.name for c in picked}
    lost = [k for k in spec.primary_key if k not in names]
    if lost and slc.load == "upsert":
        raise SpecError(
            f"table {spec.name}: key column(s) {', '.join(lost)} are excluded but the load "
            "mode is `upsert`; keep them or set load='insert'"
        )
    return picked


def select_tables(
    slices: Iterable[SliceSpec], only: Sequence[str] | None = None
) -> list[SliceSpec]:
    """Slices whose name (full or bare) was asked for, in their own order."""
    slices = list(slices)
    if only is None:
        return slices
    wanted = set(only)
    picked = []
    for s in slices:
        hit = next((n for n in (s.table, bare_name(s.table)) if n in wanted), None)
        if hit is not None:
            wanted.discard(hit)
            picked.append(s)
    if wanted:
        raise SpecError(
            f"not configured: {', '.join(sorted(wanted))}; "
            f"configured tables: {', '.join(s.table for s in slices)}"
        )
    return picked


def restrict(schema: SchemaSpec, wanted: Sequence[str]) -> SchemaSpec:
    """The wanted tables and everything they reference, directly or not.

    Enum lists no kept column uses are left out; names the schema lacks are
    the caller's to report (they are drift, not an error, beside a record).
    """
    if not wanted:
        return schema
    keep: set[str] = set()
    todo = [n for n in wanted if n in schema.tables]
    while todo:
        name = todo.pop()
        if name in keep:
            continue
        keep.add(name)
        todo += [f.references for f in schema.tables[name].foreign_keys
                 if f.references in schema.tables]
    tables = {
        n: replace(t, foreign_keys=tuple(f for f in t.foreign_keys if f.references in keep))
        for n, t in schema.tables.items() if n in keep
    }
    used = {enum_name(c) for t in tables.values() for c in t.columns}
    return SchemaSpec(tables, {n: v for n, v in schema.enums.items() if n in used})


def enum_name(col: ColumnSpec) -> str | None:
    if col.kind == "enum":
        return col.type_name
    return enum_name(col.of) if col.kind == "array" and col.of else None


def align_column_order(recorded: TableSpec, live: TableSpec) -> TableSpec:
    """Recorded column order first, columns new since then appended."""
    known = [live.column(n) for n in recorded.column_names if live.column(n)]
    fresh = [c for c in live.columns if recorded.column(c.name) is None]
    return replace(live, columns=tuple(known + fresh))


def to_struct(columns: Iterable[ColumnSpec]) -> T.StructType:
    """Spark schema carrying what Spark's own types cannot say as metadata."""
    fields = []
    for c in columns:
        extra = {"kind": c.label(), "has_default": c.has_default,
                 "generated": c.generated, "identity": c.identity}
        if c.max_len is not None:
            extra["max_len"] = c.max_len
        if c.labels:
            extra["labels"] = list(c.labels)
        fields.append(T.StructField(c.name, c.spark_type(), c.nullable, extra))
    return T.StructType(fields)


def spec_from_schema(name: str, schema: T.StructType, primary_key=(), **kw) -> TableSpec:
    """Read a TableSpec off a DataFrame's schema; keys cannot be seen there."""
    return TableSpec(
        name, tuple(_from_field(f) for f in schema.fields), tuple(primary_key), **kw
    )


def _from_field(f: T.StructField) -> ColumnSpec:
    meta = f.metadata or {}
    common = dict(
        nullable=f.nullable,
        has_default=bool(meta.get("has_default", False)),
        generated=bool(meta.get("generated", False)),
        identity=bool(meta.get("identity", False)),
    )
    return replace(_from_type(f.name, f.dataType, meta.get("max_len")), **common)


def _from_type(name: str, t: T.DataType, max_len=None) -> ColumnSpec:
    ints = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
    if type(t) in ints:
        return int_col(name, ints[type(t)])
    if isinstance(t, T.BooleanType):
        return ColumnSpec(name, "bool")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return ColumnSpec(name, "float", bits=32 if isinstance(t, T.FloatType) else 64)
    if isinstance(t, T.DecimalType):
        return ColumnSpec(name, "decimal", precision=t.precision, scale=t.scale)
    if isinstance(t, (T.VarcharType, T.CharType)):
        return text_col(name, t.length)
    if isinstance(t, T.StringType):
        return text_col(name, max_len)
    if isinstance(t, T.BinaryType):
        return ColumnSpec(name, "bytes")
    if isinstance(t, T.DateType):
        return ColumnSpec(name, "date")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return ColumnSpec(name, "timestamp", tz=isinstance(t, T.TimestampType))
    if isinstance(t, T.ArrayType):
        return ColumnSpec(name, "array", of=_from_type("item", t.elementType))
    if isinstance(t, (T.StructType, T.MapType, T.VariantType)):
        return ColumnSpec(name, "json", binary=True)
    return ColumnSpec(name, "other", type_name=t.simpleString())
