"""Schemas from Python dataclasses, sum types, and checks that a frame keeps its schema."""

from __future__ import annotations

import dataclasses
import types
import typing
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Annotations for 32-bit integers and single precision; plain int is 64 bits.
Int = typing.NewType("Int", int)
Float32 = typing.NewType("Float32", float)

_ATOMS = {int: T.LongType(), Int: T.IntegerType(), float: T.DoubleType(), Float32: T.FloatType(), bool: T.BooleanType(), str: T.StringType(), datetime: T.TimestampType()}

#: The column that says which variant of a sum type a row is.
VARIANT = "_type"


def _type_of(hint: object) -> tuple[T.DataType, bool]:
    """(data type, nullable) of an annotation."""
    if hint in _ATOMS:
        return _ATOMS[hint], False
    if dataclasses.is_dataclass(hint):
        return schema_of(hint), False
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType) and type(None) in args and len(args) == 2:
        return _type_of(next(a for a in args if a is not type(None)))[0], True
    if origin is list:
        element, nullable = _type_of(args[0])
        return T.ArrayType(element, containsNull=nullable), False
    if origin is dict:
        key, (value, nullable) = _type_of(args[0])[0], _type_of(args[1])
        return T.MapType(key, value, valueContainsNull=nullable), False
    if origin is tuple:
        fields = [T.StructField(f"_{i}", *_type_of(a)) for i, a in enumerate(args, 1)]
        return T.StructType(fields), False
    raise TypeError(f"no column type for {hint!r}")


def schema_of(entity: type) -> T.StructType:
    """Schema of a dataclass: a plain field is not null, ``X | None`` is, list elements are not null.

    A field's ``metadata={"name": ...}`` gives a column name that Python cannot spell, such as ``@id``.
    """
    hints = typing.get_type_hints(entity)
    return T.StructType([T.StructField(f.metadata.get("name", f.name), *_type_of(hints[f.name])) for f in dataclasses.fields(entity)])


def sum_type(*variants: type) -> T.StructType:
    """Schema of a sum type: fields of all variants first, the others after them as nullable, then ``_type``.

    A field that variants declare with different types is an error.
    """
    schemas = {v.__name__: schema_of(v) for v in variants}
    fields: dict[str, T.StructField] = {}
    for name, schema in schemas.items():
        for f in schema:
            if f.name in fields and fields[f.name].dataType != f.dataType:
                raise TypeError(f"field {f.name} of {name} has another type in another variant")
            fields.setdefault(f.name, f)
    everywhere = [n for n in fields if all(n in s.names for s in schemas.values())]
    nullable = lambda n: any(s[n].nullable for s in schemas.values())
    common = [T.StructField(n, fields[n].dataType, nullable(n)) for n in everywhere]
    rest = [T.StructField(n, f.dataType, True) for n, f in fields.items() if n not in everywhere]
    return T.StructType([*common, *rest, T.StructField(VARIANT, T.StringType(), False)])


def to_row(obj: object) -> Row:
    """A dataclass object as a Row, nested ones included."""
    convert = lambda v: to_row(v) if dataclasses.is_dataclass(v) else [convert(x) for x in v] if isinstance(v, list) else v
    names = [f.metadata.get("name", f.name) for f in dataclasses.fields(obj)]
    return Row(*names)(*(convert(getattr(obj, f.name)) for f in dataclasses.fields(obj)))


def from_row(entity: type, row: Row):
    """A Row as an object of a dataclass, nested ones included."""
    hints = typing.get_type_hints(entity)

    def convert(hint, v):
        args = [a for a in typing.get_args(hint) if a is not type(None)]
        if v is None:
            return None
        if dataclasses.is_dataclass(hint):
            return from_row(hint, v)
        if isinstance(v, list) and args:
            return [convert(typing.get_args(args[0])[0] if typing.get_origin(args[0]) is list else args[0], x) for x in v]
        return convert(args[0], v) if args and dataclasses.is_dataclass(args[0]) else v

    return entity(**{f.name: convert(hints[f.name], row[f.metadata.get("name", f.name)]) for f in dataclasses.fields(entity)})


def frame_of(spark: SparkSession, objects: list, entity: type | None = None) -> DataFrame:
    """Objects of one dataclass as a frame; a null in a field that has none is rejected by name."""
    return spark.createDataFrame([to_row(o) for o in objects], schema_of(entity or type(objects[0])))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema, in its order and types; fails at once if one is missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))


def _never_null(column: Column, kind: T.DataType, path: str) -> list[tuple[Column, str]]:
    """(condition, path) of what must hold inside a value that is there."""
    if isinstance(kind, T.StructType):
        out = []
        for f in kind:
            inner = column.getField(f.name)
            if not f.nullable:
                out.append((column.isNull() | inner.isNotNull(), f"{path}.{f.name}"))
            out += [(column.isNull() | c, p) for c, p in _never_null(inner, f.dataType, f"{path}.{f.name}")]
        return out
    if isinstance(kind, T.ArrayType) and not kind.containsNull:
        return [(column.isNull() | ~F.exists(column, lambda x: x.isNull()), f"{path}[]")]
    return []


def require_non_null(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame, of which reading a null where the schema has none fails the job with the field's name.

    Readers make every column nullable, so this is what enforces a schema after reading.
    """
    checks: list[tuple[Column, str]] = []
    for f in schema:
        column = F.col(f"`{f.name}`")
        if not f.nullable:
            checks.append((column.isNotNull(), f.name))
        checks += _never_null(column, f.dataType, f.name)
    if not checks:
        return df
    # assert_true gives null where the condition holds; as a filter it cannot be pruned away
    return df.filter(reduce(lambda a, b: a & b, (F.assert_true(c, f"null in {p}").isNull() for c, p in checks)))


def to_variant(df: DataFrame, variant: str, schema: T.StructType) -> DataFrame:
    """A frame of one variant as rows of the sum type: other fields null, ``_type`` set."""
    own = [F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType) for f in schema if f.name != VARIANT]
    names = [f.name for f in schema if f.name != VARIANT]
    return df.select(*(c.alias(n) for c, n in zip(own, names, strict=True)), F.lit(variant).alias(VARIANT))


def pack_struct(df: DataFrame, name: str, columns: list[str] | None = None) -> Column:
    """Columns as one struct column."""
    return F.struct(*(F.col(f"`{c}`") for c in columns or df.columns)).alias(name)
