"""The engine's tables: Parquet folders with a hidden insertion sequence, their indexes as layouts, their statistics."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

TYPES = {"int": T.LongType(), "double": T.DoubleType(), "text": T.StringType()}
SEQUENCE = "_sequence"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    raise EngineError(f"columns of type {t.simpleString()} are not supported")


@dataclass
class Table:
    name: str
    columns: dict[str, str]
    path: str | None = None  # None: a registered frame
    frame: DataFrame | None = None
    rows: int = 0
    indexes: dict[str, str] = field(default_factory=dict)  # name: column
    stats: Any = None
    stale: bool = True
    sorted_by: str | None = None  # until rows are inserted
    layouts: dict[str, str] = field(default_factory=dict)  # indexed column: folder with the rows in its order


class Catalog:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.tables = spark, {}
        base = folder or spark.conf.get("spark.sql.warehouse.dir", None) or f"file://{tempfile.gettempdir()}"
        self.folder = f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"

    def __getitem__(self, name: str) -> Table:
        if name not in self.tables:
            raise EngineError(f"unknown table {name}")
        return self.tables[name]

    def schema(self, t: Table) -> T.StructType:
        return T.StructType([T.StructField(c, TYPES[k]) for c, k in t.columns.items()] + [T.StructField(SEQUENCE, T.LongType())])

    def stored(self, t: Table) -> DataFrame:
        """The table with its insertion sequence, if it is the engine's own."""
        return t.frame if t.path is None else self.spark.read.schema(self.schema(t)).parquet(t.path)

    def typed(self, t: Table, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").cast(TYPES[k]).alias(c) for c, k in t.columns.items()])

    def frame(self, name: str) -> tuple[DataFrame, dict[str, str]]:
        return self.typed(self[name], self.stored(self[name])), self[name].columns

    def relation(self, name: str, indexes: bool = True) -> tuple[DataFrame, dict[str, str], set[str], dict[str, DataFrame]]:
        """Rows, columns, which columns can be NULL (none of the engine's own tables), and the rows by indexed column."""
        t = self[name]
        nullable = set() if t.path else {f.name.lower() for f in t.frame.schema.fields if f.nullable}
        layouts = {c: self.typed(t, self.spark.read.schema(self.schema(t)).parquet(path)) for c, path in t.layouts.items()} if indexes else {}
        return *self.frame(name), nullable, layouts

    def create(self, name: str, columns: list[tuple[str, str]]) -> Table:
        if name in self.tables:
            raise EngineError(f"table {name} exists")
        if not columns:
            raise EngineError("a table needs a column")
        if len({c for c, _ in columns}) < len(columns):
            raise EngineError(f"duplicate column in {name}")
        t = Table(name, dict(columns), f"{self.folder}/{name}/0")
        self.spark.createDataFrame([], self.schema(t)).write.parquet(t.path)
        self.tables[name] = t
        return t

    def register(self, name: str, df: DataFrame) -> Table:
        """A frame under a name; columns of other types than numbers and texts are left out."""
        columns = {f.name.lower(): kind_of(f.dataType) for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType)) and not isinstance(f.dataType, T.DecimalType)}
        t = self.tables[name] = Table(name, columns, None, df)
        return t

    def load(self, name: str, df: DataFrame, order: str | None = None) -> Table:
        """A table of the engine's own with a frame's rows, in the order of a column."""
        t = self.create(name, [(f.name, kind_of(f.dataType)) for f in df.schema.fields])
        number = F.col(order) if order else F.monotonically_increasing_id()
        df.withColumn(SEQUENCE, number.cast("long")).write.mode("append").parquet(t.path)
        t.rows = self.stored(t).count()
        return t

    def insert(self, name: str, rows: list[tuple]) -> int:
        """Checks all rows, then appends them."""
        t = self[name]
        if t.path is None:
            raise EngineError(f"{name} is a registered frame and takes no rows")
        checked = []
        for i, row in enumerate(rows):
            if len(row) != len(t.columns):
                raise EngineError(f"{name} has {len(t.columns)} columns, a row has {len(row)}")
            out = []
            for value, (column, kind) in zip(row, t.columns.items(), strict=True):
                if kind == "double" and isinstance(value, int) and not isinstance(value, bool):
                    value = float(value)
                if not isinstance(value, {"int": int, "double": float, "text": str}[kind]) or isinstance(value, bool):
                    raise EngineError(f"column {column} is {kind}, not {type(value).__name__}")
                if kind == "int" and not -(1 << 63) <= value < 1 << 63:
                    raise EngineError(f"integer out of range in column {column}")
                out.append(value)
            checked.append((*out, t.rows + i))
        added = self.spark.createDataFrame(checked, self.schema(t)).coalesce(1)
        for path in {t.path, *t.layouts.values()}:  # an index keeps its order within what each statement adds
            own = [c for c, p in t.layouts.items() if p == path]
            (added.sortWithinPartitions(*own) if own else added).write.mode("append").parquet(path)
        t.rows, t.stale, t.sorted_by = t.rows + len(rows), True, None
        return len(rows)

    def index(self, name: str, table: str, column: str) -> None:
        """An index is a layout: the rows in ranges of the column, sorted, so that a bound on the column skips files and row
        groups by their minima and maxima. The first index of a table becomes its own order, others are copies."""
        t = self[table]
        if column not in t.columns:
            raise EngineError(f"unknown column {table}.{column}")
        if t.columns[column] != "int":
            raise EngineError("only INT columns can be indexed")
        if t.path is None:
            raise EngineError(f"{table} is a registered frame, whose layout is its own")
        if name in t.indexes or column in t.indexes.values():
            raise EngineError(f"{table}.{column} is indexed already")
        path = f"{self.folder}/{t.name}/{uuid.uuid4().hex[:8]}"
        self.stored(t).repartitionByRange(column).sortWithinPartitions(column).write.parquet(path)
        if not t.indexes:
            t.path, t.sorted_by = path, column
        t.indexes[name], t.layouts[column] = column, path
