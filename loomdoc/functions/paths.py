"""Paths into nested columns, built step by step and lowered to column expressions.

    Path().name("items").each().where(lambda v: (v["qty"] > 30) & (v["disc"] >= 0.05)).name("price")

A path lowers to plain expressions: field access where each step yields one node, higher-order
functions where a step yields many. No rows are exploded until rows are asked for, so column
pruning and filters reach the scan. Nodes keep document order and are never deduplicated.
Over VARIANT columns each node is a VARIANT; descend() there needs the depth that sources.documents asks for.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import Value


class PathError(ValueError):
    """A path that can't be lowered over a column's type."""


def escape(token: Column | str):
    """A token as a part of a pointer: ~ is written ~0 and / is written ~1."""
    if isinstance(token, str):
        return token.replace("~", "~0").replace("/", "~1")
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


@dataclass(frozen=True)
class Path:
    steps: tuple = ()

    def _add(self, *step) -> Path:
        return Path((*self.steps, step))

    def name(self, key: str) -> Path:
        """The member of an object; nothing from others."""
        return self._add("name", key)

    def index(self, i: int) -> Path:
        """The element of an array, from the end if negative."""
        return self._add("index", i)

    def each(self) -> Path:
        """All elements of an array, all member values of an object."""
        return self._add("each")

    def slice(self, start: int | None = None, end: int | None = None, step: int = 1) -> Path:
        """As Python slices an array; a step of 0 takes nothing."""
        return self._add("slice", start, end, step)

    def where(self, test: Callable[[Value], Column]) -> Path:
        """The elements or member values for which test holds."""
        return self._add("where", test)

    def union(self, *paths: Path) -> Path:
        """The nodes of each path from here, one path after another; duplicates stay."""
        return self._add("union", paths)

    def descend(self, key: str | None = None) -> Path:
        """Members named key at any depth below, one place of the type after another; of any name without key."""
        return self._add("descend", key)

    def parent(self) -> Path:
        """The container of each node, once a node; nothing of the root."""
        return self._add("parent")

    def key(self) -> Path:
        """The name or index of each node in its container; nothing of the root."""
        return self._add("key")

    @property
    def singular(self) -> bool:
        return all(s[0] in ("name", "index") for s in self.steps)

    def one(self, v: Value) -> Value:
        """The value at a singular path."""
        if not self.singular:
            raise PathError("the path may yield several nodes")
        for _, key in self.steps:
            v = v[key]
        return v

    def nodes(self, v: Value, segments: bool = False) -> tuple[Column, T.DataType]:
        """An array of the nodes, as (pointer, value) structs, and the values' type.

        segments: pointer is an array of (name, index) structs, of which one is null, instead of text.
        """
        return _nodes(self.steps, v, F.array().cast(SEGMENTS) if segments else F.lit(""), segments=segments)

    def array(self, v: Value) -> Value:
        """The node values as one array value."""
        # without pointers, unless a step reads them
        arr, t = self.nodes(v) if _reads_keys(self.steps) else _nodes(self.steps, v, F.lit(None).cast("string"), segments=None)
        return Value(F.transform(arr, lambda n: n["value"]), T.ArrayType(t))


#: Where a node is, step by step.
SEGMENTS = T.ArrayType(T.StructType().add("name", T.StringType()).add("index", T.IntegerType()))


def _reads_keys(steps: tuple) -> bool:
    return any(kind == "key" or kind == "union" and any(_reads_keys(p.steps) for p in args[0]) for kind, *args in steps)


def _below(at: Column, token: Column | str, index: bool, segments: bool | None) -> Column:
    """The place of a child: its container's with a name or an index; nothing if segments is None."""
    if segments is None:
        return at
    if segments:
        name, number = (F.lit(None), token) if index else (token if isinstance(token, Column) else F.lit(token), F.lit(None))
        return F.array_append(at, F.struct(name.cast("string").alias("name"), number.cast("int").alias("index")))
    return F.concat(at, F.lit("/" + escape(token))) if isinstance(token, str) else F.concat(at, F.lit("/"), token.cast("string") if index else escape(token))


def _struct(pointer: Column, value: Column) -> Column:
    return F.struct(pointer.alias("pointer"), value.alias("value"))


def _none(t: T.DataType, segments: bool | None = False) -> tuple[Column, T.DataType]:
    return F.array().cast(T.ArrayType(T.StructType().add("pointer", SEGMENTS if segments else T.StringType()).add("value", t))), t


def _children(v: Value, pointer: Column, segments: bool | None) -> tuple[Column, T.DataType]:
    """All elements or member values; null ones too, but for a struct's, which are absent."""
    t = v.dtype
    elements = lambda col: F.transform(col, lambda x, i: _struct(_below(pointer, i, True, segments), x))
    members = lambda col: F.transform(F.map_entries(col), lambda e: _struct(_below(pointer, e["key"], False, segments), e["value"]))
    if isinstance(t, T.ArrayType):
        return F.coalesce(elements(v.col), _none(t.elementType, segments)[0]), t.elementType
    if isinstance(t, T.MapType):
        return F.coalesce(members(v.col), _none(t.valueType, segments)[0]), t.valueType
    if isinstance(t, T.VariantType):
        as_map, as_array = F.try_variant_get(v.col, "$", "map<string,variant>"), F.try_variant_get(v.col, "$", "array<variant>")
        return F.coalesce(members(as_map), elements(as_array), _none(t, segments)[0]), t
    if isinstance(t, T.StructType):
        common = _common([f.dataType for f in t])
        all_ = F.array(*(_struct(_below(pointer, f.name, False, segments), _as(v.col[f.name], f.dataType, common)) for f in t))
        return F.filter(all_, lambda n: n["value"].isNotNull()), common
    return _none(t or T.StringType(), segments)


def _common(types: list[T.DataType]) -> T.DataType:
    """The type that values of several members share: their own, double for numbers, text for scalars, else VARIANT."""
    if len({x.simpleString() for x in types}) == 1:
        return types[0]
    if all(isinstance(x, T.NumericType) for x in types):
        return T.DoubleType()
    if any(isinstance(x, (T.ArrayType, T.StructType, T.MapType, T.VariantType)) for x in types):
        return T.VariantType()
    return T.StringType()


def _as(col: Column, given: T.DataType, wanted: T.DataType) -> Column:
    """A member's column as the type that it shares with others."""
    if isinstance(wanted, T.VariantType) and isinstance(given, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_variant_object(col)
    return col.cast(wanted)


def _positions(size: Column, start, end, step: int) -> Column:
    """Zero-based positions that a slice takes of an array of that size."""
    if step == 0:
        return F.array().cast("array<int>")
    if step > 0:
        low, high = 0 if start is None else start, end
        a = F.lit(low) if low >= 0 else F.greatest(size + low, F.lit(0))
        b = size if high is None else F.least(F.lit(high), size) if high >= 0 else size + high
        stop = b - 1
        return F.when(a <= stop, F.sequence(a, stop, F.lit(step))).otherwise(F.array().cast("array<int>"))
    a = size - 1 if start is None else F.least(F.lit(start), size - 1) if start >= 0 else size + start
    b = F.lit(-1) if end is None else F.lit(end) if end >= 0 else F.greatest(size + end, F.lit(-1))
    return F.when(a >= b + 1, F.sequence(a, b + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _descendants(t: T.DataType, key: str | None) -> list[tuple]:
    """Paths, as steps, to all members of that name below a value of type t, outer ones first."""
    found = []
    if isinstance(t, T.StructType):
        for f in t:
            if key is None or f.name == key:
                found.append((("name", f.name),))
            found += [(("name", f.name), *p) for p in _descendants(f.dataType, key)]
    elif isinstance(t, T.ArrayType):
        found += [(("each",),)] * (key is None) + [(("each",), *p) for p in _descendants(t.elementType, key)]
    elif isinstance(t, T.MapType):
        found += [(("name", key),)] if key is not None else [(("each",),)]
        found += [(("each",), *p) for p in _descendants(t.valueType, key)]
    return found


def _token(pointer: Column, segments: bool) -> Column:
    """The last token of a pointer."""
    if segments:
        last = F.try_element_at(pointer, F.lit(-1))
        return F.coalesce(last["name"], last["index"].cast("string"))
    last = F.regexp_extract(pointer, r"[^/]*\z", 0)
    return F.replace(F.replace(last, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def _nodes(steps: tuple, v: Value, pointer: Column, above: tuple = (), segments: bool | None = False) -> tuple[Column, T.DataType]:
    """The nodes of steps from v; above has the containers of v with their pointers, inner ones first."""
    if not steps:
        t = v.dtype or T.StringType()
        return F.when(v.exists(), F.array(_struct(pointer, v.col.cast(t) if v.dtype is None else v.col))).otherwise(_none(t, segments)[0]), t
    (kind, *args), rest = steps[0], steps[1:]
    inside = ((v, pointer), *above)
    if kind in ("parent", "key") and not above:
        return _none(v.dtype or T.StringType(), segments)
    if kind == "parent":
        holder, at = above[0]
        return _nodes(rest, Value(holder.col, holder.dtype, v.exists() & holder.exists()), at, above[1:], segments)
    if kind == "key":
        of = T.LongType() if above[0][0].kind == "array" else T.StringType()
        return _nodes(rest, Value(F.when(v.exists(), _token(pointer, segments).cast(of)), of), pointer, above, segments)
    if kind == "name":
        return _nodes(rest, v[args[0]], _below(pointer, args[0], False, segments), inside, segments)
    if kind == "index":
        i = args[0]
        size = F.size(F.try_variant_get(v.col, "$", "array<variant>") if v.kind == "variant" else v.col) if v.kind in ("array", "variant") else F.lit(0)
        return _nodes(rest, v[i], _below(pointer, F.lit(i) if i >= 0 else size + i, True, segments), inside, segments)
    if kind in ("union", "descend"):
        paths = [p.steps for p in args[0]] if kind == "union" else _descendants(v.dtype, args[0])
        parts = [_nodes((*p, *rest), v, pointer, above, segments) for p in paths]
        if not parts:
            return _none(T.StringType(), segments)
        common = _common([t for _, t in parts])
        alike = lambda a, t: F.transform(a, lambda n: _struct(n["pointer"], _as(n["value"], t, common)))
        kept = [alike(a, t) for a, t in parts]
        return F.concat(*kept), common
    arr, t = _children(v, pointer, segments)
    if kind == "slice":
        if v.kind not in ("array", "variant"):
            return _none(T.StringType(), segments)
        arr = F.transform(_positions(F.size(arr), *args), lambda i: F.get(arr, i))
        if v.kind == "variant":
            arr = F.when(v.runtime_kind() == "array", arr).otherwise(_none(t, segments)[0])
    elif kind == "where":
        arr = F.filter(arr, lambda n: args[0](Value(n["value"], t, F.lit(True))))
    if not rest:
        return arr, t
    below: list[T.DataType] = []

    def step(n: Column) -> Column:
        sub, kind_below = _nodes(rest, Value(n["value"], t, F.lit(True)), n["pointer"], inside, segments)
        below.append(kind_below)
        return sub

    return F.flatten(F.transform(arr, step)), below[-1]


def root(df: DataFrame, column: str | None = None) -> Value:
    """A column as the document, or the whole row as one."""
    if column is None:
        return Value(F.struct(*df.columns), df.schema)
    return Value(F.col(column), df.schema[column].dataType)


def query(df: DataFrame, path: Path, column: str | None = None, keep: tuple[str, ...] = (), segments: bool = False) -> DataFrame:
    """One row a node: the kept columns, ord (0 upwards in a document), pointer (or its segments) and value."""
    arr, _ = path.nodes(root(df, column), segments)
    return df.select(*keep, F.posexplode(arr).alias("ord", "node")).select(*keep, "ord", "node.pointer", "node.value")


def select_values(df: DataFrame, path: Path, column: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a node, values alone: pointers are not built."""
    return df.select(*keep, F.explode(path.array(root(df, column)).col).alias("value"))


def limited(df: DataFrame, path: Path, n: int, column: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """As query, but a document's first n nodes alone; nothing is said of the rest."""
    arr, _ = path.nodes(root(df, column))
    return df.select(*keep, F.posexplode(F.slice(arr, 1, n)).alias("ord", "node")).select(*keep, "ord", "node.pointer", "node.value")


def exists(df: DataFrame, path: Path, column: str | None = None) -> Column:
    return F.size(path.array(root(df, column)).col) > 0


def count(df: DataFrame, path: Path, column: str | None = None) -> Column:
    return F.size(path.array(root(df, column)).col).cast("long")


def first(df: DataFrame, path: Path, column: str | None = None) -> Column:
    return path.array(root(df, column))[0].col


def last(df: DataFrame, path: Path, column: str | None = None) -> Column:
    return path.array(root(df, column))[-1].col


def normalized(segments: Column) -> Column:
    """The normalized path of a node's segments; a member named 0 stays a name."""
    quoted = lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    step = lambda s: F.coalesce(F.concat(F.lit("['"), quoted(s["name"]), F.lit("']")), F.concat(F.lit("["), s["index"].cast("string"), F.lit("]")))
    return F.concat(F.lit("$"), F.array_join(F.transform(segments, step), ""))


def pointer_of(segments: Column) -> Column:
    """The pointer of a node's segments."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.lit("/"), F.coalesce(escape(s["name"]), s["index"].cast("string")))), "")


def parents(nodes: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The distinct parents' pointers of nodes, with ord, the place at which each is first seen; a root has none."""
    parent = F.regexp_replace("pointer", r"/[^/]*\z", "")
    return nodes.where("pointer <> ''").groupBy(*keep, parent.alias("pointer")).agg(F.min("ord").alias("ord"))


def query_set(df: DataFrame, paths: dict[str, Path], column: str | None = None) -> DataFrame:
    """df with an array of values for each named path, all from one scan."""
    return df.withColumns({name: p.array(root(df, column)).col for name, p in paths.items()})


def query_set_nodes(df: DataFrame, paths: dict[str, Path], column: str | None = None, segments: bool = False) -> DataFrame:
    """As query_set, with the nodes' pointers (or segments) beside their values."""
    return df.withColumns({name: p.nodes(root(df, column), segments)[0] for name, p in paths.items()})


def pattern(path: Path) -> str:
    """The regular expression of the pointers that a path of names, indexes, each() and descend() takes in."""
    out = ""
    for kind, *args in path.steps:
        if kind == "name" or kind == "index" and args[0] >= 0:
            out += "/" + re.sub(r"([^\w/~])", r"\\\1", escape(str(args[0])))
        elif kind == "each":
            out += "/[^/]+"
        elif kind == "descend":
            out += "(/[^/]+)*/" + ("[^/]+" if args[0] is None else re.sub(r"([^\w/~])", r"\\\1", escape(args[0])))
        else:
            raise PathError(f"a pattern can't have a step {kind}")
    return rf"\A{out}\z"
