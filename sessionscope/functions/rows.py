"""Turning one wide row into a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _literal(value: str | int | None) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def stack_rows(df: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """Every row of ``df`` as ``len(rows)`` rows; a cell is a Column or a constant.

    The Columns of one output column must share a type.
    """
    values: list[Column] = []
    cells: list[str] = []
    for cell in (cell for row in rows for cell in row):
        if isinstance(cell, Column):
            cells.append(f"_v{len(values)}")
            values.append(cell.alias(cells[-1]))
        else:
            cells.append(_literal(cell))
    wide = df.select(*values)
    return wide.selectExpr(f"stack({len(rows)}, {', '.join(cells)}) AS ({', '.join(names)})")


def document_fields(document: DataFrame, name: str | None = None) -> DataFrame:
    """The leaves of nested rows as ``(path, text, number)``; null leaves are left out, as in JSON.

    Structs add their field's name to the path, maps their key, and arrays of structs the field ``name``.
    """

    def join(path: Column, more: Column) -> Column:
        return F.concat(path, F.lit("."), more)

    def leaves(value: Column, kind: T.DataType, path: Column) -> Column:
        if isinstance(kind, T.StructType):
            parts = [leaves(value[f.name], f.dataType, join(path, F.lit(f.name))) for f in kind.fields]
            return F.concat(*parts)
        if isinstance(kind, T.MapType):
            entries = F.map_entries(value)
            found = F.transform(entries, lambda e: leaves(e["value"], kind.valueType, join(path, e["key"])))
            return F.coalesce(F.flatten(found), none)
        if isinstance(kind, T.ArrayType):
            found = F.transform(value, lambda e: leaves(e, kind.elementType, join(path, e[name])))
            return F.coalesce(F.flatten(found), none)
        text = isinstance(kind, T.StringType)
        leaf = F.struct(
            F.substring(path, 2, 10_000).alias("path"),
            (value if text else F.lit(None)).cast("string").alias("text"),
            (F.lit(None) if text else value).cast("double").alias("number"),
        )
        return F.when(value.isNotNull(), F.array(leaf)).otherwise(none)

    none = F.array().cast("array<struct<path:string,text:string,number:double>>")
    columns = [leaves(F.col(f.name), f.dataType, F.lit(f".{f.name}")) for f in document.schema.fields]
    return document.select(F.inline(F.concat(*columns)))
