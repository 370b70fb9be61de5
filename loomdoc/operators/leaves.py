"""Documents as leaf tables: one row for each scalar and for each container's marker.

A leaf table has the document's id, the pointer, the type, the value as text (null for
containers) and, for containers, their size, so nothing is lost. Sorted by pointer it prunes
by Parquet's statistics: a subtree is an equality or a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions.paths import Path, escape, pattern
from loomdoc.functions.values import Value, type_class

LEAF = "array<struct<pointer:string,type:string,value:string,size:int>>"


def _row(pointer: Column, kind: str, value: Column | None = None, size: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(pointer.alias("pointer"), F.lit(kind).alias("type"), (none if value is None else value).cast("string").alias("value"), (none if size is None else size).cast("int").alias("size"))


def _scalar(t: T.DataType) -> bool:
    return not isinstance(t, T.StructType | T.MapType | T.ArrayType)


def _leaves(v: Value, pointer: Column) -> Column:
    """The rows of a value in document order, with a null for each scalar that is absent."""
    none = F.array().cast(LEAF)
    if isinstance(v.dtype, T.StructType):
        # neighbouring scalars make one array: joining arrays is what costs most here
        runs: list[list[Column] | Column] = [[_row(pointer, "object", size=sum((v[n].exists().cast("int") for n in v.dtype.names), F.lit(0)))]]
        for f in v.dtype:
            below = F.concat(pointer, F.lit("/" + escape(f.name)))
            if not _scalar(f.dataType):
                runs.append(_leaves(v[f.name], below))
            elif isinstance(runs[-1], list):
                runs[-1].append(_member(v[f.name], below))
            else:
                runs.append([_member(v[f.name], below)])
        arrays = [F.array(*r) if isinstance(r, list) else r for r in runs]
        return F.when(v.exists(), F.concat(*arrays) if len(arrays) > 1 else arrays[0]).otherwise(none)
    if isinstance(v.dtype, T.MapType):
        at = lambda e: F.concat(pointer, F.lit("/"), escape(e["key"]))
        each = lambda make: F.transform(F.map_entries(v.col), lambda e: make(Value(e["value"], v.dtype.valueType), at(e)))
        below = each(_member) if _scalar(v.dtype.valueType) else F.flatten(each(_leaves))
        return F.when(v.exists(), F.concat(F.array(_row(pointer, "object", size=F.size(v.col))), below)).otherwise(none)
    if isinstance(v.dtype, T.ArrayType):
        each = lambda make: F.transform(v.col, lambda x, i: make(Value(x, v.dtype.elementType), F.concat(pointer, F.lit("/"), i.cast("string"))))
        below = each(_member) if _scalar(v.dtype.elementType) else F.flatten(each(_leaves))
        return F.when(v.exists(), F.concat(F.array(_row(pointer, "array", size=F.size(v.col))), below)).otherwise(none)
    return F.array(_member(v, pointer))


def _member(v: Value, pointer: Column) -> Column:
    """A scalar's row, null where it is absent."""
    return F.when(v.exists(), _row(pointer, type_class(v.dtype), value=v.col))


def packed(df: DataFrame, column: str, key: str) -> DataFrame:
    """key and leaves, the leaf table with all rows of a document in one array, in document order."""
    rows = _leaves(Value(F.col(column), df.schema[column].dataType), F.lit(""))
    return df.select(key, F.array_compact(rows).alias("leaves"))


def shred(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, pointer, type, value, size: the leaves and containers of a typed column."""
    return packed(df, column, key).select(key, F.explode("leaves").alias("l")).select(key, "l.*")


def subtree(pointer: str, column: str | Column = "pointer") -> Column:
    """Whether a row is at pointer or below it."""
    at = F.col(column) if isinstance(column, str) else column
    return F.lit(True) if pointer == "" else (at == pointer) | at.startswith(pointer + "/")


def matching(leaves: DataFrame, path: Path) -> DataFrame:
    """The rows at a path of names, indexes, each() and descend(), without rebuilding documents."""
    return leaves.where(F.col("pointer").rlike(pattern(path)))


def lookup(leaves: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted, rows of key and pointer, with the type and value found there; null where there is nothing."""
    return wanted.join(leaves.select(key, "pointer", "type", "value"), [key, "pointer"], "left")


def replace_subtree(leaves: DataFrame, pointer: str, rows: DataFrame | dict[str, Column]) -> DataFrame:
    """leaves with rows (of the same columns) in place of all that is at and below a pointer.

    Columns by name instead of rows change the row at the pointer itself, and what is below goes:
    leaves are then read once and stay where they are.
    """
    if isinstance(rows, DataFrame):
        return leaves.where(~subtree(pointer)).unionByName(rows)
    here = F.col("pointer") == pointer
    return leaves.where(here | ~subtree(pointer)).withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in rows.items()})


def materialise(leaves: DataFrame, key: str, dtype: T.DataType, pointer: str = "", name: str = "doc") -> DataFrame:
    """key and name: documents of a type rebuilt from their leaves, or what they have at a pointer.

    leaves are rows or packed. Packed ones are read where they are. Rows are gathered by one
    grouping, which sorts all of them and so spills where a task's rows exceed its memory.
    An expression of the type reads a document's rows. Each lookup scans them, so it is for
    documents that fit a row and have at most some thousands of leaves. Documents without a row
    at the pointer are left out.
    """
    entry = lambda r: F.struct(r["pointer"].alias("pointer"), F.struct(r["value"].alias("value"), r["size"].alias("size")).alias("row"))
    if "leaves" in leaves.columns:
        rows = leaves.select(key, F.transform(F.filter("leaves", lambda r: subtree(pointer, r["pointer"])), entry).alias("_e"))
    else:
        rows = leaves.where(subtree(pointer)).groupBy(key).agg(F.collect_list(entry({c: F.col(c) for c in ("pointer", "value", "size")})).alias("_e"))
    # the lookup table is bound once, and what has no row at the pointer gives no row
    found = F.filter(F.array(F.map_from_entries("_e")), lambda m: F.map_contains_key(m, F.lit(pointer)))
    return rows.select(key, F.explode(F.transform(found, lambda m: _built(dtype, m, F.lit(pointer)))).alias(name))


def _built(t: T.DataType, rows: Column, at: Column) -> Column:
    here = F.try_element_at(rows, at)
    if isinstance(t, T.StructType):
        return F.when(here.isNotNull(), F.struct(*(_built(f.dataType, rows, F.concat(at, F.lit("/" + escape(f.name)))).alias(f.name) for f in t)))
    if isinstance(t, T.ArrayType):
        places = F.when(here["size"] > 0, F.sequence(F.lit(0), here["size"] - 1)).when(here["size"] == 0, F.array().cast("array<int>"))
        return F.transform(places, lambda i: _built(t.elementType, rows, F.concat(at, F.lit("/"), i.cast("string"))))
    if isinstance(t, T.MapType):
        token = lambda p: F.substring(p, F.length(at) + 2, F.length(p))
        below = F.filter(F.map_keys(rows), lambda p: p.startswith(F.concat(at, F.lit("/"))) & ~token(p).contains("/"))
        name = lambda p: F.replace(F.replace(token(p), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        made = F.map_from_entries(F.transform(below, lambda p: F.struct(name(p).alias("k"), _built(t.valueType, rows, p).alias("v"))))
        return F.when(here.isNotNull(), made)
    return here["value"].cast(t)


def latest(log: DataFrame, key: str) -> DataFrame:
    """The state that a change log (key, seq, pointer, value; a null value deletes) leads to, with versions.

    version counts all changes of a pointer, deletions too; deleted pointers are left out.
    """
    last = log.groupBy(key, "pointer").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("version"))
    return last.where(F.col("value").isNotNull())
