"""Entities: declared record types with keys, an event time, decimals and a stream or table kind."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

STREAM, TABLE = "STREAM", "TABLE"
READ_WRITE, READ_ONLY, WRITE_ONLY = "ReadWrite", "ReadOnly", "WriteOnly"
#: The types a record may declare.
TYPES = {
    "short": T.IntegerType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(),
    "string": T.StringType(), "char": T.StringType(), "guid": T.StringType(), "bool": T.BooleanType(), "datetime": T.TimestampType(),
    "bytes": T.BinaryType(), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


class ModelError(ValueError):
    """An entity or a query breaks a rule of the model."""


@dataclass(frozen=True)
class Entity:
    """A record type. fields maps column names to type names (decimal, decimal(p,s) and those of TYPES, with ? behind a
    nullable one), in order; keys are in key order. Decimal precision: overrides by "Entity.column", then the declared
    one, then 18,2. Enums, nested records and arrays can't be declared."""

    name: str
    fields: Mapping[str, str]
    keys: tuple[str, ...] = ()
    timestamp: str | None = None
    ignore: frozenset[str] = frozenset()
    kind: str = STREAM
    access: str = READ_WRITE
    partitions: int | None = None
    decimals: Mapping[str, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self):
        for k in self.keys:
            if k not in self.fields:
                raise ModelError(f"{self.name}: key {k} isn't a column")
        if self.timestamp and self.fields.get(self.timestamp, "").rstrip("?") != "datetime":
            raise ModelError(f"{self.name}: event time {self.timestamp} must be a datetime column")
        if self.kind == TABLE and not self.keys:
            raise ModelError(f"{self.name}: a table needs a key")
        if self.kind not in (STREAM, TABLE) or self.access not in (READ_WRITE, READ_ONLY, WRITE_ONLY):
            raise ModelError(f"{self.name}: unknown kind or access")
        self.schema()

    def decimal(self, column: str) -> tuple[int, int]:
        declared = self.fields[column].rstrip("?")
        inside = declared[declared.find("(") + 1 : -1].split(",") if "(" in declared else (18, 2)
        return self.decimals.get(f"{self.name}.{column}", (int(inside[0]), int(inside[1])))

    def type_of(self, column: str) -> T.DataType:
        name = self.fields[column].rstrip("?").lower()
        if name.startswith("decimal"):
            return T.DecimalType(*self.decimal(column))
        if name not in TYPES:
            raise ModelError(f"{self.name}.{column}: type {name} isn't supported")
        return TYPES[name]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, self.type_of(c), t.endswith("?") or c not in self.keys) for c, t in self.fields.items() if c not in self.ignore])

    def warnings(self) -> list[str]:
        return [] if self.keys else [f"{self.name} has no key and is treated as a stream"]


def check_shape(schema: T.StructType, target: Entity) -> None:
    """A projection must have the target's columns: same names, same order, same types (decimals to the digit)."""
    want = target.schema()
    if schema.names != want.names:
        raise ModelError(f"{target.name}: columns are {schema.names}, not {want.names}")
    for a, b in zip(schema, want, strict=True):
        same = a.dataType == b.dataType or {type(a.dataType), type(b.dataType)} == {T.TimestampType, T.TimestampNTZType}
        if not same:
            raise ModelError(f"{target.name}.{a.name}: {a.dataType.simpleString()}, not {b.dataType.simpleString()}")
