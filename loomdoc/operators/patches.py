"""JSON Patch and Merge Patch over typed columns.

A patch is known when the plan is built, so each operation becomes a column expression and a
whole patch one projection. Columns are immutable: a failed row leaves nothing half done.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions.paths import Path, escape
from loomdoc.functions.values import Value, literal

from . import pointers as P
from . import reshape

#: The operations and what each must have besides op and path.
NEEDS = {"add": ("value",), "remove": (), "replace": ("value",), "move": ("from",), "copy": ("from",), "test": ("value",)}


#: Operations of a builder on all nodes of a path.
ALL = {"replace_all": ("value",), "remove_all": (), "add_all": ("value",)}


class PatchError(ValueError):
    """An operation that is malformed, or names a place that the column does not have."""


def validate(patch: list[dict]) -> None:
    for i, op in enumerate(patch):
        needs = (NEEDS | ALL).get(op.get("op"))
        if needs is None or "path" not in op or any(k not in op for k in needs):
            raise PatchError(f"operation {i} is malformed: {op}")


def _value(x) -> Column:
    return x if isinstance(x, Column) else literal(x).col


def apply_patch(df: DataFrame, column: str, patch: list[dict]) -> DataFrame:
    """df with the patched column. A row that fails a test, or lacks what an operation needs, stops the query."""
    validate(patch)
    if any("when" in op for op in patch):
        return _apply_where(df, column, patch)
    for op in patch:
        v = Value(F.col(column), df.schema[column].dataType)
        kind, path = op["op"], op["path"]
        if kind in ALL:
            change = {"remove_all": lambda v, p: reshape.omit(v, p)}.get(kind, lambda v, p, x=op.get("value"): reshape.transform(v, p, lambda _: _value(x)))
            df = df.withColumn(column, change(v, path))
            continue
        if kind == "test":
            new = F.when(P.get(v, path) == Value(_value(op["value"]), _typed(op["value"])), v.col).otherwise(F.raise_error(F.lit(f"test failed at {path}")).cast(v.dtype))
        elif kind == "add":
            new = P.set_at(v, path, _value(op["value"]), insert=True)
        elif kind == "replace":
            new = _need(v, path, P.set_at(v, path, _value(op["value"])))
        elif kind == "remove":
            new = _need(v, path, P.remove_at(v, path))
        else:
            moved = P.get(v, op["from"]).col
            if kind == "move" and path == op["from"]:
                continue
            if kind == "move" and path.startswith(op["from"] + "/"):
                raise PatchError(f"{op['from']} can't move into itself")
            df = df.withColumn("_moved", moved)
            new = v.col if kind == "copy" else _need(v, op["from"], P.remove_at(v, op["from"]))
            df = df.withColumn(column, new)
            v = Value(F.col(column), df.schema[column].dataType)
            df = df.withColumn(column, P.set_at(v, path, F.col("_moved"), insert=True)).drop("_moved")
            continue
        df = df.withColumn(column, new)
    return df


def _apply_where(df: DataFrame, column: str, patch: list[dict]) -> DataFrame:
    """As apply_patch, with operations that hold in some rows only: those where `when` holds of the unpatched document."""
    start = Value(F.col(column), df.schema[column].dataType)
    df = df.withColumns({f"_when{i}": op["when"](start) for i, op in enumerate(patch) if "when" in op})
    for i, op in enumerate(patch):
        plain = {k: x for k, x in op.items() if k != "when"}
        if "when" not in op:
            df = apply_patch(df, column, [plain])
            continue
        old = df.schema[column].dataType
        # a row in which the operation does not hold must not fail for it
        done = apply_patch(df.withColumn("_done", F.when(F.col(f"_when{i}"), F.col(column))), "_done", [plain])
        df = done.withColumn(column, F.when(F.col(f"_when{i}"), F.col("_done")).otherwise(_fitted(F.col(column), old, done.schema["_done"].dataType))).drop("_done", f"_when{i}")
    return df


def _typed(x) -> T.DataType | None:
    return None if isinstance(x, Column) else literal(x).dtype


def _need(v: Value, path: str, new: Column) -> Column:
    """new where the document has something at path, else an error."""
    return F.when(P.exists(v, path), new).otherwise(F.raise_error(F.lit(f"nothing at {path}")))


#: A row's failed operations.
ERRORS = "array<struct<index:int,op:string,message:string>>"


def patch_with_errors(df: DataFrame, column: str, patch: list[dict], atomic: bool = False, errors: str = "errors") -> DataFrame:
    """df with the patched column and, in `errors`, what failed in each row; no row stops the query.

    An operation that fails in a row leaves that row as it was, and later ones go on; atomic:
    a row with any failure keeps its old document, in the new type. The type is the same for all
    rows, so a removed member becomes null, which counts as absent, and one that only some rows
    gained is null in the others. Operations may not name places that the type lacks.
    """
    validate(patch)
    df = df.withColumns({"_old": F.col(column), errors: F.array().cast(ERRORS)})
    for i, op in enumerate(patch):
        v = Value(F.col(column), df.schema[column].dataType)
        kind, path = op["op"], op["path"]
        if kind == "test":
            ok, new = P.get(v, path) == Value(_value(op["value"]), _typed(op["value"])), None
        elif kind in ("remove", "replace"):
            ok, new = P.exists(v, path), _gone(v, path) if kind == "remove" else P.set_at(v, path, _value(op["value"]))
        else:
            value = _value(op["value"]) if kind == "add" else P.get(v, op["from"]).col
            ok = _takes(v, path) if kind == "add" else P.exists(v, op["from"]) & _takes(v, path)
            if kind == "move" and path != op["from"]:
                if path.startswith(op["from"] + "/"):
                    raise PatchError(f"{op['from']} can't move into itself")
                v = Value(_gone(v, op["from"]), v.dtype)
            new = v.col if kind == "move" and path == op["from"] else P.set_at(v, path, value, insert=True)
        df = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
        if new is not None:
            df = df.withColumn("_new", new)
            df = df.withColumn(column, F.when(F.col("_ok"), F.col("_new")).otherwise(_fitted(F.col(column), v.dtype, df.schema["_new"].dataType))).drop("_new")
        failed = F.struct(F.lit(i).alias("index"), F.lit(kind).alias("op"), F.lit(f"{kind} fails at {path}").alias("message"))
        df = df.withColumn(errors, F.when(F.col("_ok"), F.col(errors)).otherwise(F.array_append(errors, failed))).drop("_ok")
    if atomic:
        old = Value(F.col("_old"), df.schema["_old"].dataType)
        df = df.withColumn(column, F.when(F.size(errors) == 0, F.col(column)).otherwise(_fitted(old.col, old.dtype, df.schema[column].dataType)))
    return df.drop("_old")


def _takes(v: Value, path: str) -> Column:
    """Whether something can be added at path: its container is there and, in an array, the index within it."""
    value, holder, key = P.with_parent(v, path)
    if holder.kind == "array" and key != "-":
        return F.coalesce(F.size(holder.col) >= int(key), F.lit(False)) if key.isdigit() else F.lit(False)
    return value.exists() if key is None else holder.exists()


def _gone(v: Value, path: str) -> Column:
    """v's column without what is at path, of the same type."""
    value, holder, _ = P.with_parent(v, path)
    if isinstance(holder.dtype, T.StructType):
        return P.set_at(v, path, F.lit(None).cast(value.dtype))
    return P.remove_at(v, path)


def _fitted(col: Column, given: T.DataType, wanted: T.DataType) -> Column:
    """A document as a type with other members: those it lacks are null."""
    if given == wanted:
        return col
    if isinstance(given, T.StructType) and isinstance(wanted, T.StructType):
        parts = [_fitted(col[f.name], given[f.name].dataType, f.dataType) if f.name in given.names else F.lit(None).cast(f.dataType) for f in wanted]
        return F.when(col.isNotNull(), F.struct(*(p.alias(f.name) for p, f in zip(parts, wanted))))
    if isinstance(given, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return F.transform(col, lambda x: _fitted(x, given.elementType, wanted.elementType))
    return col.cast(wanted)


def operations(v: Value, path: Path, op: str, value=None) -> Column:
    """A row's operations of one kind at all nodes of a path, as an array of (op, path, value), value as JSON text.

    Removals come in reverse order, so that positions in arrays hold until they are used.
    """
    nodes, _ = path.nodes(v)
    text = F.lit(None).cast("string") if op == "remove" else _json(Value(_value(value), _typed(value), F.lit(True)))
    made = F.transform(nodes, lambda n: F.struct(F.lit(op).alias("op"), n["pointer"].alias("path"), text.alias("value")))
    return F.reverse(made) if op == "remove" else made


class PatchBuilder:
    """Builds a patch step by step; when, if_exists and if_not_exists decide on the next operation alone."""

    def __init__(self) -> None:
        self.ops: list[dict] = []
        self._next: bool | Callable[[Value], Column] = True

    def when(self, condition: bool) -> PatchBuilder:
        self._next = condition
        return self

    def if_exists(self, path: str) -> PatchBuilder:
        """The next operation holds in rows whose unpatched document has something at path."""
        self._next = lambda v: P.exists(v, path)
        return self

    def if_not_exists(self, path: str) -> PatchBuilder:
        self._next = lambda v: ~P.exists(v, path)
        return self

    def _op(self, **op) -> PatchBuilder:
        on, self._next = self._next, True
        if on is not False:
            self.ops.append(op if on is True else op | {"when": on})
        return self

    def replace_all(self, path: Path, value) -> PatchBuilder:
        return self._op(op="replace_all", path=path, value=value)

    def add_all(self, path: Path, value) -> PatchBuilder:
        """Adds at every node of a path that ends in a name, which replaces it."""
        if path.steps[-1][0] != "name":
            raise PatchError("add_all wants a path that ends in a name; operations() gives insertions into arrays")
        return self._op(op="add_all", path=path, value=value)

    def remove_all(self, path: Path) -> PatchBuilder:
        return self._op(op="remove_all", path=path)

    def add(self, path: str, value) -> PatchBuilder:
        return self._op(op="add", path=path, value=value)

    def remove(self, path: str) -> PatchBuilder:
        return self._op(op="remove", path=path)

    def replace(self, path: str, value) -> PatchBuilder:
        return self._op(op="replace", path=path, value=value)

    def move(self, start: str, path: str) -> PatchBuilder:
        return self._op(op="move", path=path, **{"from": start})

    def copy(self, start: str, path: str) -> PatchBuilder:
        return self._op(op="copy", path=path, **{"from": start})

    def test(self, path: str, value) -> PatchBuilder:
        return self._op(op="test", path=path, value=value)

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        return apply_patch(df, column, self.ops)


def holds(df: DataFrame, column: str, tests: dict[str, object]) -> Column:
    """Whether every pointer of tests holds its value."""
    v = Value(F.col(column), df.schema[column].dataType)
    out = F.lit(True)
    for path, want in tests.items():
        out = out & (P.get(v, path) == Value(_value(want), _typed(want)))
    return out


def inverse(df: DataFrame, column: str, patch: list[dict]) -> list[dict]:
    """Operations that undo a patch, with the old values as columns of the unpatched df.

    Additions to an object undo by removing, or by replacing if the type has the member;
    insertions into an array by removing the element.
    """
    v, undo = Value(F.col(column), df.schema[column].dataType), []
    for op in patch:
        holder = P.get(v, P.parent(op["path"])) if op["path"] else v
        old = P.get(v, op["path"])
        if op["op"] == "add" and (holder.kind == "array" or old.kind == "nothing"):
            undo.insert(0, {"op": "remove", "path": op["path"]})
        elif op["op"] in ("add", "replace"):
            undo.insert(0, {"op": "replace", "path": op["path"], "value": old.col})
        elif op["op"] == "remove":
            undo.insert(0, {"op": "add", "path": op["path"], "value": old.col})
        elif op["op"] == "move":
            undo.insert(0, {"op": "move", "from": op["path"], "path": op["from"]})
        elif op["op"] == "copy":
            undo.insert(0, {"op": "remove", "path": op["path"]})
    return undo


def merge_patch(target: Value, patch: dict) -> Column:
    """A merge patch over a struct or map: None removes, dicts go deeper, all else replaces."""
    col, t = target.col, target.dtype
    for key, new in patch.items():
        v = Value(col, t)
        if isinstance(t, T.MapType):
            kept = F.map_filter(col, lambda k, _: k != key)
            col = kept if new is None else F.map_concat(kept, F.create_map(F.lit(key), _value(new)))
            continue
        has = isinstance(t, T.StructType) and key in t.names
        if new is None:
            # a typed null is an absent member
            col = col.withField(P._quoted(key), F.lit(None).cast(t[key].dataType)) if has else col
        elif isinstance(new, dict):
            inner = merge_patch(v[key], new) if has and v[key].kind == "object" else _from_dict(new)
            col = col.withField(P._quoted(key), inner)
        else:
            col = col.withField(P._quoted(key), _value(new))
    return col


def _from_dict(d: dict) -> Column:
    return F.struct(*((_from_dict(x) if isinstance(x, dict) else _value(x)).alias(k) for k, x in d.items() if x is not None))


def patch_of(merge: dict, at: str = "") -> list[dict]:
    """A merge patch as operations: null removes, dicts go deeper, all else is added."""
    ops = []
    for key, new in merge.items():
        path = at + P.pointer(key)
        ops += [{"op": "remove", "path": path}] if new is None else patch_of(new, path) if isinstance(new, dict) and new else [{"op": "add", "path": path, "value": new}]
    return ops


def merge_of(patch: list[dict]) -> dict:
    """The merge patch of a patch's additions, replacements and removals of object members; other operations say nothing."""
    out: dict = {}
    for op in patch:
        path = P.tokens(op["path"])
        if op["op"] not in ("add", "replace", "remove") or not path:
            continue
        inner = out
        for t in path[:-1]:
            if not isinstance(inner.get(t), dict):
                inner[t] = {}
            inner = inner[t]
        inner[path[-1]] = op.get("value") if op["op"] != "remove" else None
    return out


def merge_trace(target: Value, patch: dict, at: str = "") -> Column:
    """What a merge patch does to each row: an array of (op, pointer, old), old as JSON text."""
    out = [F.array().cast("array<struct<op:string,pointer:string,old:string>>")]
    for key, new in patch.items():
        old, path = target[key], at + P.pointer(key)
        if isinstance(new, dict) and old.kind == "object":
            out.append(merge_trace(old, new, path))
            continue
        entry = F.array(F.struct(F.lit("delete" if new is None else "set").alias("op"), F.lit(path).alias("pointer"), _json(old).alias("old")))
        out.append(F.when(old.exists(), entry).otherwise(out[0]) if new is None else entry)
    return F.concat(*out)


def _json(v: Value) -> Column:
    """A value as JSON text; null where it is absent."""
    if v.dtype is None:
        return F.lit(None).cast("string")
    one = F.to_json(F.array(v.col))
    return F.when(v.exists(), F.substring(one, F.lit(2), F.length(one) - 2))


def create_merge_patch(old: Value, new: Value) -> Column:
    """The merge patch, as JSON text, that leads from one document to another; "{}" where they are alike.

    Objects are compared member by member, arrays and scalars as wholes; members that are gone are null.
    """
    return F.coalesce(_changes(old, new), F.lit("{}"))


def _changes(a: Value, b: Value) -> Column:
    """JSON text of what changes from a to b, null where nothing does."""
    if not (isinstance(a.dtype, T.StructType) and isinstance(b.dtype, T.StructType)):
        return F.when(~(a == b), F.coalesce(_json(b), F.lit("null")))
    named = []
    for n in dict.fromkeys([*a.dtype.names, *b.dtype.names]):
        key = F.substring(F.to_json(F.array(F.lit(n))), F.lit(2), F.length(F.to_json(F.array(F.lit(n)))) - 2)
        named.append(F.concat(key, F.lit(":"), _changes(a[n], b[n])))
    inner = F.array_join(F.array(*named), ",")
    whole = F.coalesce(_json(b), F.lit("null"))
    return F.when(a.exists() & b.exists(), F.when(inner != "", F.concat(F.lit("{"), inner, F.lit("}")))).when(a.exists() | b.exists(), whole)


def is_valid_merge_patch(patch) -> bool:
    """Whether a value can be written as JSON, which is all that a merge patch must be."""
    try:
        json.dumps(patch, allow_nan=False)
    except (TypeError, ValueError, RecursionError):
        return False
    return True


#: A row's differences; value is JSON text.
DIFF = "array<struct<op:string,pointer:string,value:string>>"


def diff(old: Value, new: Value, tests: bool = False, at: Column | None = None) -> Column:
    """The operations that lead from one document of a row to another, removals before additions in every object.

    Each is at the topmost place that differs and has the whole new value as JSON text. Arrays are
    compared element by element if they are of one size, else replaced. tests: before a removal or
    replacement comes a test of the old value. Both documents are in the row, so nothing is shuffled.
    """
    at = F.lit("") if at is None else at
    none = F.array().cast(DIFF)
    entry = lambda op, value, place: F.struct(F.lit(op).alias("op"), place.alias("pointer"), value.alias("value"))
    text = lambda v: F.when(v.exists(), _json(v))
    gone = lambda v, place: F.array(*[entry("test", text(v), place)] * tests, entry("remove", F.lit(None).cast("string"), place))
    added = lambda v, place: F.array(entry("add", text(v), place))
    replaced = F.array(*[entry("test", text(old), at)] * tests, entry("replace", text(new), at))
    whole = F.when(old == new, none).otherwise(replaced)
    both = old.exists() & new.exists() & old.col.isNotNull() & new.col.isNotNull()
    below = lambda n: F.concat(at, F.lit("/" + escape(n)))
    if isinstance(old.dtype, T.StructType) and isinstance(new.dtype, T.StructType):
        out = [F.when(old[n].exists() & ~new[n].exists(), gone(old[n], below(n))).otherwise(none) for n in old.dtype.names]
        for n in new.dtype.names:
            inner = diff(old[n], new[n], tests, below(n)) if n in old.dtype.names else none
            out.append(F.when(~new[n].exists(), none).when(old[n].exists(), inner).otherwise(added(new[n], below(n))))
        return F.when(both, F.concat(*out)).otherwise(whole)
    if isinstance(old.dtype, T.MapType) and isinstance(new.dtype, T.MapType):
        place = lambda k: F.concat(at, F.lit("/"), escape(k))
        member = lambda v, k: Value(F.try_element_at(v.col, k), v.dtype.valueType, F.lit(True))
        lost = F.transform(F.filter(F.map_keys(old.col), lambda k: ~F.map_contains_key(new.col, k)), lambda k: gone(member(old, k), place(k)))
        rest = F.transform(F.map_keys(new.col), lambda k: F.when(F.map_contains_key(old.col, k), diff(member(old, k), member(new, k), tests, place(k))).otherwise(added(member(new, k), place(k))))
        return F.when(both, F.flatten(F.concat(lost, rest))).otherwise(whole)
    if old.kind == new.kind == "array":
        pairs = F.zip_with(old.col, new.col, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        each = F.transform(pairs, lambda x, i: diff(Value(x["a"], old.dtype.elementType, F.lit(True)), Value(x["b"], new.dtype.elementType, F.lit(True)), tests, F.concat(at, F.lit("/"), i.cast("string"))))
        return F.when(both & (F.size(old.col) == F.size(new.col)), F.flatten(each)).otherwise(whole)
    return whole


def diff_frames(old: DataFrame, new: DataFrame, key: str, column: str, tests: bool = False) -> DataFrame:
    """key, op, pointer, value: the differences of the documents of two frames, which meet by one join on the key.

    A document that only one frame has is removed or added as a whole.
    """
    a, b = (df.select(key, F.struct(F.col(column).alias("doc")).alias(n)) for df, n in ((old, "_a"), (new, "_b")))
    both = a.join(b, key, "full")
    x, y = (Value(F.col(f"{n}.doc"), df.schema[column].dataType) for n, df in (("_a", old), ("_b", new)))
    whole = lambda op, v: F.array(F.struct(F.lit(op).alias("op"), F.lit("").alias("pointer"), v.alias("value")))
    ops = F.when(F.col("_a").isNull(), whole("add", _json(y))).when(F.col("_b").isNull(), whole("remove", F.lit(None).cast("string"))).otherwise(diff(x, y, tests))
    return both.select(key, F.explode(ops).alias("d")).select(key, "d.*")
