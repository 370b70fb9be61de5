"""Projection, removal, transformation and deep merging of nested columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions.paths import Path, root
from loomdoc.functions.values import Value

from . import pointers as P


def project(df: DataFrame, shape: dict[str, Path | Callable[[Value], Column]], column: str | None = None) -> DataFrame:
    """A column for each name: a singular path's value, other paths' array, or what a function of the document gives."""
    doc = root(df, column)
    return df.select(*((f(doc) if not isinstance(f, Path) else f.one(doc).col if f.singular else f.array(doc).col).alias(n) for n, f in shape.items()))


def pick(df: DataFrame, *paths: Path, column: str | None = None) -> DataFrame:
    """The values of singular paths, each named by its last step."""
    return project(df, {str(p.steps[-1][1]): p for p in paths}, column)


def transform(v: Value, path: Path, change: Callable[[Value], Column]) -> Column:
    """v's column with every node of a path of names, indexes and each() changed."""
    if not path.steps:
        return change(v)
    (kind, *args), rest = path.steps[0], Path(path.steps[1:])
    if kind == "name" and isinstance(v.dtype, T.StructType):
        return F.when(v.exists(), v.col.withField(P._quoted(args[0]), transform(v[args[0]], rest, change))) if args[0] in v.dtype.names else v.col
    if v.kind == "array" and kind in ("each", "where", "index"):
        def one(x: Column, i: Column) -> Column:
            e = Value(x, v.dtype.elementType)
            hit = args[0](e) if kind == "where" else i == (args[0] if args[0] >= 0 else F.size(v.col) + args[0]) if kind == "index" else F.lit(True)
            return F.when(hit, transform(e, rest, change)).otherwise(x)

        return F.transform(v.col, one)
    if isinstance(v.dtype, T.MapType) and kind in ("each", "name"):
        return F.transform_values(v.col, lambda k, x: F.when(F.lit(kind == "each") | (k == (args or [""])[0]), transform(Value(x, v.dtype.valueType), rest, change)).otherwise(x))
    return v.col


def transform_all(df: DataFrame, column: str, changes: list[tuple[Path, Callable[[Value], Column]]]) -> DataFrame:
    """df with a column's nodes changed path by path, each on what the one before made."""
    for path, change in changes:
        df = df.withColumn(column, transform(root(df, column), path, change))
    return df


def omit(v: Value, path: Path) -> Column:
    """v's column without the nodes of a path; array positions are those before the removal."""
    *head, (kind, *args) = path.steps

    def drop(holder: Value) -> Column:
        if kind == "name":
            return P._drop(holder, args[0])
        if kind == "index":
            n = F.size(holder.col)
            return F.filter(holder.col, lambda _, i: i != (args[0] if args[0] >= 0 else n + args[0]))
        if kind == "where":
            return F.filter(holder.col, lambda x: ~args[0](Value(x, holder.dtype.elementType)))
        return F.filter(holder.col, lambda _: F.lit(False))

    return transform(v, Path(tuple(head)), drop)


def merge_deep(a: Value, b: Value, arrays: str = "replace") -> Column:
    """b over a: structs member by member, maps by key; arrays replace, concat or union."""
    if isinstance(a.dtype, T.StructType) and isinstance(b.dtype, T.StructType):
        names = list(dict.fromkeys([*a.dtype.names, *b.dtype.names]))
        return F.struct(*((merge_deep(a[n], b[n], arrays) if n in a.dtype.names and n in b.dtype.names else (a if n in a.dtype.names else b)[n].col).alias(n) for n in names))
    if isinstance(a.dtype, T.MapType) and isinstance(b.dtype, T.MapType):
        return F.when(a.exists() & b.exists(), F.map_concat(F.map_filter(a.col, lambda k, _: ~F.map_contains_key(b.col, k)), b.col)).otherwise(F.coalesce(b.col, a.col))
    if a.kind == b.kind == "array" and arrays != "replace":
        join = F.concat if arrays == "concat" else F.array_union
        return F.coalesce(join(a.col, b.col), b.col, a.col)
    return F.coalesce(b.col, a.col.cast(b.dtype) if b.dtype else a.col)
