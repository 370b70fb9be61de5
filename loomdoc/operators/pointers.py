"""JSON Pointers over typed columns: get, test, set and remove, as column expressions."""

from __future__ import annotations

import re
from os.path import commonprefix
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions.paths import escape
from loomdoc.functions.values import Value


class PointerError(ValueError):
    """Text that is no pointer, or a place that a column's type does not have."""


def tokens(pointer: str) -> list[str]:
    """The tokens of a pointer; a leading # marks a percent-encoded fragment."""
    if pointer.startswith("#"):
        pointer = unquote(pointer[1:])
    if pointer and not pointer.startswith("/") or re.search("~(?![01])", pointer):
        raise PointerError(f"not a pointer: {pointer!r}")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]


def pointer(*parts: str | int) -> str:
    return "".join("/" + escape(str(p)) for p in parts)


def fragment(text: str) -> str:
    return "#" + quote(text, safe="/~!$&'()*+,;=:@?-._")


def parent(text: str) -> str:
    return pointer(*tokens(text)[:-1])


def concat(*texts: str) -> str:
    """Pointers one below the other."""
    return pointer(*(t for text in texts for t in tokens(text)))


def is_valid(text: str) -> bool:
    try:
        tokens(text)
    except PointerError:
        return False
    return True


def normalize(text: str | list) -> str:
    """A pointer in its plain form, of text, a fragment or a list of tokens."""
    return pointer(*(tokens(text) if isinstance(text, str) else text))


def relative_to(current: str, target: str) -> str:
    """The relative pointer that leads from one pointer to another."""
    here, there = tokens(current), tokens(target)
    shared = len(commonprefix([here, there]))
    return f"{len(here) - shared}{pointer(*there[shared:])}"


def relative(current: str, rel: str):
    """Where a relative pointer leads from current: a pointer, or with # the key's name."""
    m = re.fullmatch(r"(0|[1-9][0-9]*)(?:(#)|((?:/.*)?))", rel, re.S)
    here = tokens(current)
    if not m or int(m[1]) > len(here) or m[2] and int(m[1]) == len(here):
        raise PointerError(f"{rel!r} leads nowhere from {current!r}")
    up = here[: len(here) - int(m[1])]
    return up[-1] if m[2] else pointer(*up, *tokens(m[3]))


def _index(token: str) -> int | None:
    return int(token) if re.fullmatch("0|[1-9][0-9]*", token) else None


def get(v: Value, text: str) -> Value:
    """The value at a pointer; absent where there is none."""
    for t in tokens(text):
        v = v[t] if v.kind == "object" else v[_index(t)] if v.kind == "array" and _index(t) is not None else Value(F.lit(None), None)
    return v


def exists(v: Value, text: str) -> Column:
    return get(v, text).exists()


def get_or_raise(v: Value, text: str) -> Column:
    found = get(v, text)
    return F.coalesce(found.col, F.raise_error(F.lit(f"nothing at {text}")).cast(found.dtype or "string"))


def with_parent(v: Value, text: str) -> tuple[Value, Value, str | None]:
    """The value at a pointer, its container and its key there; the root has neither."""
    path = tokens(text)
    return (get(v, text), get(v, pointer(*path[:-1])), path[-1]) if path else (v, Value(F.lit(None), None), None)


def from_path(text: str) -> str:
    """The pointer of a normalized path, $['a'][0]."""
    step = r"\[(?:'((?:[^'\\]|\\.)*)'|(0|[1-9][0-9]*))\]"
    if not re.fullmatch(rf"\$(?:{step})*", text, re.S):
        raise PointerError(f"not a normalized path: {text!r}")
    return pointer(*(index or re.sub(r"\\(.)", r"\1", name) for name, index in re.findall(step, text, re.S)))


def to_path(text: str) -> str:
    """The normalized path of a pointer; digits alone are taken as an index."""
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "$" + "".join(f"[{t if _index(t) is not None else quoted(t)}]" for t in tokens(text))


def nested(path: list[str], value: Column) -> Column:
    """Containers around a value, from the outermost token on: arrays for 0 and -, else objects."""
    for t in reversed(path):
        value = F.array(value) if t in ("0", "-") else F.struct(value.alias(t))
    return value


def rewrite(v: Value, path: list[str], leaf, create: Column | None = None) -> Column:
    """v's column with what leaf(container, last token) gives in place of the last container.

    Members that the type lacks are made around create, if given; else they are an error.
    """
    if len(path) == 1:
        return leaf(v, path[0])
    head, rest = path[0], path[1:]
    if create is not None and isinstance(v.dtype, T.StructType):
        if head not in v.dtype.names:
            return F.when(v.exists(), v.col.withField(_quoted(head), nested(rest, create)))
        if isinstance(v.dtype[head].dataType, (T.StructType, T.MapType)):  # an absent one is made empty first
            t = v.dtype[head].dataType
            empty = F.from_json(F.lit("{}"), t)
            return F.when(v.exists(), v.col.withField(_quoted(head), rewrite(Value(F.coalesce(v[head].col, empty), t), rest, leaf, create)))
    if isinstance(v.dtype, T.StructType) and head in v.dtype.names:
        return F.when(v.exists(), v.col.withField(_quoted(head), rewrite(v[head], rest, leaf)))
    if isinstance(v.dtype, T.MapType):
        return F.transform_values(v.col, lambda k, x: F.when(k == head, rewrite(Value(x, v.dtype.valueType), rest, leaf)).otherwise(x))
    if v.kind == "array" and _index(head) is not None:
        return F.transform(v.col, lambda x, i: F.when(i == _index(head), rewrite(Value(x, v.dtype.elementType), rest, leaf)).otherwise(x))
    raise PointerError(f"{v.dtype} has no {head!r}")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _place(value: Column, insert: bool):
    def leaf(v: Value, t: str) -> Column:
        if isinstance(v.dtype, T.StructType):
            return F.when(v.exists(), v.col.withField(_quoted(t), value))
        if isinstance(v.dtype, T.MapType):
            return F.map_concat(F.map_filter(v.col, lambda k, _: k != t), F.create_map(F.lit(t), value))
        if v.kind == "array":
            if t == "-":
                return F.array_append(v.col, value)
            i = _index(t)
            if i is None:
                raise PointerError(f"{t!r} is no index")
            if insert:  # an index past the end is an error
                fits = F.concat(F.slice(v.col, 1, i), F.array(value), F.slice(v.col, i + 1, 1 << 30))
                return F.when(F.size(v.col) >= i, fits).otherwise(F.raise_error(F.lit(f"index {i} is past the end")).cast(v.dtype))
            return F.transform(v.col, lambda x, j: F.when(j == i, value).otherwise(x))
        raise PointerError(f"{v.dtype} holds nothing at {t!r}")

    return leaf


def set_at(v: Value, text: str, value: Column, insert: bool = False, create: bool = False) -> Column:
    """The document with value at a pointer.

    insert: array elements move up instead of going; create: containers on the way are made.
    """
    path = tokens(text)
    return rewrite(v, path, _place(value, insert), value if create else None) if path else value


def _drop(v: Value, t: str) -> Column:
    if isinstance(v.dtype, T.StructType) and t in v.dtype.names:
        return F.when(v.exists(), v.col.dropFields(_quoted(t)))
    if isinstance(v.dtype, T.MapType):
        return F.map_filter(v.col, lambda k, _: k != t)
    if v.kind == "array" and _index(t) is not None:
        return F.filter(v.col, lambda _, i: i != _index(t))
    raise PointerError(f"{v.dtype} has no {t!r}")


def remove_at(v: Value, text: str) -> Column:
    path = tokens(text)
    if not path:
        raise PointerError("the root can't be removed")
    return rewrite(v, path, _drop)
