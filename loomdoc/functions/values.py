"""Values inside a document and the comparisons and functions of path filters.

A Value is a column with its type. Every comparison gives a boolean that is never null:
an absent value equals only an absent one, types are never coerced, and an order exists only
between two numbers or two strings. A null of a struct's member is taken as absent; a null
element of an array or value of a map is a JSON null, which is there and equals null. In a
VARIANT absent members and JSON nulls differ by themselves.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def type_class(t: T.DataType | None) -> str:
    if t is None or isinstance(t, T.NullType):
        return "nothing"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.VariantType):
        return "variant"
    return "object" if isinstance(t, (T.StructType, T.MapType)) else "other"


def literal(x) -> Value:
    """A Python value as a constant; lists of one type become arrays, dicts objects, None a JSON null."""
    if isinstance(x, Value):
        return x
    if isinstance(x, list):
        items = [literal(i) for i in x]
        return Value(F.array(*(i.col for i in items)), T.ArrayType(items[0].dtype if items else T.StringType()))
    if isinstance(x, dict):
        made = {k: literal(i) for k, i in x.items()}
        return Value(F.struct(*(v.col.alias(k) for k, v in made.items())), T.StructType([T.StructField(k, v.dtype or T.NullType()) for k, v in made.items()]))
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    return Value(F.lit(x), kinds.get(type(x)), F.lit(True))


def absent() -> Value:
    return Value(F.lit(None), None)


class Value:
    """A single value: comparisons give columns, arithmetic and member access give values."""

    __hash__ = None

    def __init__(self, col: Column, dtype: T.DataType | None, present: Column | None = None):
        """present: whether the value is there, if that is not the same as being no null."""
        self.col, self.dtype, self.kind, self._present = col, dtype, type_class(dtype), present

    def __getitem__(self, key: str | int) -> Value:
        if self.kind == "variant":
            if isinstance(key, int) and key < 0:
                return Value(F.try_element_at(F.try_variant_get(self.col, "$", "array<variant>"), F.lit(key)), self.dtype)
            at = f"[{key}]" if isinstance(key, int) else '["{}"]'.format(key.replace("\\", "\\\\").replace('"', '\\"'))
            return Value(F.try_variant_get(self.col, "$" + at, "variant"), self.dtype)
        if isinstance(key, str) and isinstance(self.dtype, T.StructType) and key in self.dtype.names:
            return Value(self.col.getField(key), self.dtype[key].dataType)
        if isinstance(key, str) and isinstance(self.dtype, T.MapType):
            return Value(F.try_element_at(self.col, F.lit(key)), self.dtype.valueType, F.coalesce(F.map_contains_key(self.col, key), F.lit(False)))
        if isinstance(key, int) and isinstance(self.dtype, T.ArrayType):
            # get() counts from 0 and gives null outside; element_at counts back from -1
            found = F.get(self.col, F.lit(key)) if key >= 0 else F.try_element_at(self.col, F.lit(key))
            return Value(found, self.dtype.elementType, F.coalesce(F.size(self.col) >= (key + 1 if key >= 0 else -key), F.lit(False)))
        return absent()

    def exists(self) -> Column:
        return self.col.isNotNull() if self._present is None else self._present

    def as_variant(self) -> Column:
        """The value as VARIANT: SQL's null where it is absent."""
        if self.kind == "variant":
            return self.col
        made = F.to_variant_object(self.col) if self.kind in ("array", "object") else F.parse_json(F.lit("null")) if self.kind == "nothing" else self.col.cast("variant")
        return F.when(self.exists(), F.coalesce(made, F.parse_json(F.lit("null"))))

    def runtime_kind(self) -> Column:
        """The name of a value's type, null where it is absent; for VARIANT told row by row."""
        if self.kind != "variant":
            return F.when(self.exists(), F.when(self.col.isNull(), F.lit("null")).otherwise(F.lit(self.kind)))
        shape = F.schema_of_variant(self.col)
        kind = F.when(shape == "VOID", "null").when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").otherwise("number")
        return F.when(self.exists(), kind)

    def scalar(self, kind: T.DataType) -> Value:
        """What a VARIANT holds as a scalar of a type; absent where it holds something else."""
        name = {"number": "double"}.get(type_class(kind), kind.simpleString())
        return Value(F.when(self.runtime_kind() == type_class(kind), F.try_variant_get(self.col, "$", name)), kind)

    def __eq__(self, other) -> Column:  # type: ignore[override]
        o = literal(other)
        a, b = self.exists(), o.exists()
        if "variant" in (self.kind, o.kind):
            x, y = (Value(v.as_variant(), T.VariantType()) for v in (self, o))
            alike = F.when(x.runtime_kind() == "number", x.scalar(D).col == y.scalar(D).col).otherwise(x.col.cast("string") == y.col.cast("string"))
            same = (x.runtime_kind() == y.runtime_kind()) & ((x.runtime_kind() == "null") | F.coalesce(alike, F.lit(False)))
            return F.when(a & b, same).otherwise(~a & ~b)
        if self.kind != o.kind:
            same = F.lit(False)
        elif self.kind == "number":
            same = self.col.cast("double") == o.col.cast("double")
        elif self.kind in ("array", "object"):
            same = _same(self, o)
        else:
            same = self.col == o.col
        nulls = self.col.isNull() | o.col.isNull()
        return F.when(~a | ~b, ~a & ~b).when(nulls, self.col.isNull() & o.col.isNull()).otherwise(F.coalesce(same, F.lit(False)))

    def __ne__(self, other) -> Column:  # type: ignore[override]
        return ~(self == other)

    def _ordered(self, other: Value, test) -> Column:
        if "variant" in (self.kind, other.kind):
            x, y = (Value(v.as_variant(), T.VariantType()) for v in (self, other))
            either = F.when(x.runtime_kind() == "number", test(x.scalar(D).col, y.scalar(D).col)).otherwise(test(x.scalar(S).col, y.scalar(S).col))
            return F.coalesce(either, F.lit(False))
        if self.kind != other.kind or self.kind not in ("number", "string"):
            return F.lit(False)
        a, b = (v.col.cast("double") if self.kind == "number" else v.col for v in (self, other))
        return F.coalesce(test(a, b), F.lit(False))

    def __lt__(self, other) -> Column:
        return self._ordered(literal(other), lambda a, b: a < b)

    def __gt__(self, other) -> Column:
        return self._ordered(literal(other), lambda a, b: a > b)

    def __le__(self, other) -> Column:
        return (self < other) | (self == other)

    def __ge__(self, other) -> Column:
        return (self > other) | (self == other)

    def _number(self, other, op) -> Value:
        o = literal(other)
        if "variant" in (self.kind, o.kind):
            return Value((self.scalar(D) if self.kind == "variant" else self).col, self.dtype if self.kind != "variant" else D)._number(o.scalar(D) if o.kind == "variant" else o, op)
        if self.kind != "number" or o.kind != "number":
            return absent()
        return Value(op(self.col.cast("double"), o.col.cast("double")), T.DoubleType())

    def __add__(self, other) -> Value:
        return self._number(other, lambda a, b: a + b)

    def __sub__(self, other) -> Value:
        return self._number(other, lambda a, b: a - b)

    def __mul__(self, other) -> Value:
        return self._number(other, lambda a, b: a * b)

    def __truediv__(self, other) -> Value:
        return self._number(other, F.try_divide)

    def __mod__(self, other) -> Value:
        return self._number(other, lambda a, b: F.when(b != 0, a % b))

    def __neg__(self) -> Value:
        return self._number(0, lambda a, b: -a)


S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _same(a: Value, b: Value) -> Column:
    """Deep equality of two arrays or two objects that exist; the order of members is of no account."""
    if a.kind == "array":
        pairs = F.zip_with(a.col, b.col, lambda x, y: Value(x, a.dtype.elementType, F.lit(True)) == Value(y, b.dtype.elementType, F.lit(True)))
        return (F.size(a.col) == F.size(b.col)) & ((F.size(a.col) == 0) | F.forall(pairs, lambda p: p))
    if isinstance(a.dtype, T.StructType) and isinstance(b.dtype, T.StructType):
        return reduce(lambda x, y: x & y, (a[n] == b[n] for n in dict.fromkeys([*a.dtype.names, *b.dtype.names])), F.lit(True))
    if isinstance(a.dtype, T.MapType) and isinstance(b.dtype, T.MapType):
        inside = F.forall(F.map_keys(a.col), lambda k: F.map_contains_key(b.col, k) & (Value(F.try_element_at(a.col, k), a.dtype.valueType, F.lit(True)) == Value(F.try_element_at(b.col, k), b.dtype.valueType, F.lit(True))))
        return (F.size(a.col) == F.size(b.col)) & inside
    struct = a if isinstance(a.dtype, T.StructType) else b
    return reduce(lambda x, y: x & y, (a[n] == b[n] for n in struct.dtype.names), length(a) == length(b))


def _if(v: Value, kinds, make, dtype) -> Value:
    """make(column) if v is of one of kinds, else absent."""
    if v.kind == "variant" and kinds == ("string",):
        v = v.scalar(S)
    elif v.kind == "variant" and kinds == ("number",):
        v = v.scalar(D)
    return Value(make(v.col), dtype) if v.kind in kinds else absent()


def length(v: Value) -> Value:
    """Code points of a string, elements of an array, members of an object."""
    if v.kind == "variant":
        size = lambda t: F.size(F.try_variant_get(v.col, "$", t))
        kind = v.runtime_kind()
        return Value(F.when(kind == "string", F.length(v.scalar(S).col)).when(kind == "array", size("array<variant>")).when(kind == "object", size("map<string,variant>")).cast("long"), L)
    if isinstance(v.dtype, T.StructType):
        return Value(F.when(v.exists(), sum((v[n].exists().cast("long") for n in v.dtype.names), F.lit(0).cast("long"))), L)
    return _if(v, ("string", "array", "object"), lambda c: (F.length(c) if v.kind == "string" else F.when(c.isNotNull(), F.size(c))).cast("long"), L)


def type_of(v: Value) -> Value:
    return Value(v.runtime_kind(), S)


def keys(v: Value) -> Value:
    if isinstance(v.dtype, T.MapType):
        return Value(F.map_keys(v.col), T.ArrayType(S))
    if isinstance(v.dtype, T.StructType):
        return Value(F.when(v.exists(), F.array_compact(F.array(*(F.when(v[n].exists(), F.lit(n)) for n in v.dtype.names)))), T.ArrayType(S))
    return absent()


def values(v: Value) -> Value:
    if isinstance(v.dtype, T.MapType):
        return Value(F.map_values(v.col), T.ArrayType(v.dtype.valueType))
    if isinstance(v.dtype, T.StructType) and len({f.dataType.simpleString() for f in v.dtype}) == 1:
        return Value(F.when(v.exists(), F.array_compact(F.array(*(v[n].col for n in v.dtype.names)))), T.ArrayType(v.dtype[0].dataType))
    return absent()


def entries(v: Value) -> Value:
    """An object's members as (key, value) structs; members of one type only, as with values."""
    inner = values(v)
    if inner.dtype is None:
        return inner
    t = T.StructType([T.StructField("key", S), T.StructField("value", inner.dtype.elementType)])
    made = F.map_entries(v.col) if isinstance(v.dtype, T.MapType) else F.zip_with(keys(v).col, inner.col, lambda k, x: F.struct(k.alias("key"), x.alias("value")))
    return Value(made, T.ArrayType(t))


def value(v: Value) -> Value:
    """The one node of a node list, given as an array; absent if there are none or several."""
    return _if(v, ("array",), lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0))), v.dtype.elementType if v.kind == "array" else None)


#: What may follow a backslash, and the general categories of \\p and \\P.
ESCAPABLE = "()*+-.?[\\]^{|}nrt$"
CATEGORIES = "L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps Z Zl Zp Zs S Sc Sk Sm So C Cc Cf Cn Co".split()


def _regex(pattern: str) -> str | None:
    """An interoperable pattern as Java's: a dot takes no line ends. None if it is malformed or uses what these patterns lack."""
    out, plain, inside, i = [], [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            category = re.match(r"\\[pP]\{(\w+)\}", pattern[i:])
            if category and category[1] in CATEGORIES:
                out.append(category[0])
                plain.append("a")
                i += len(category[0])
                continue
            if i + 1 >= len(pattern) or pattern[i + 1] not in ESCAPABLE:
                return None
            out.append(pattern[i : i + 2])
            plain.append(pattern[i : i + 2])
            i += 2
            continue
        if pattern.startswith("(?", i) or inside and c == "[" or not inside and c == "}" and not re.search(r"\{[0-9]+(,[0-9]*)?\Z", pattern[:i]):
            return None
        if not inside and c == "{" and not re.match(r"\{[0-9]+(,[0-9]*)?\}", pattern[i:]):
            return None
        if not inside and c in "*+?{" and i and pattern[i - 1] in "*+?}" and not (i > 1 and pattern[i - 2] == "\\"):
            return None  # neither lazy nor possessive
        inside = c == "[" or inside and c != "]"
        out.append("[^\\n\\r]" if c == "." and not inside else "\\&" if c == "&" else c)
        plain.append(c)
        i += 1
    try:
        re.compile("".join(plain))
    except (re.error, OverflowError):
        return None
    return "".join(out)


def match(v: Value, pattern: str) -> Column:
    """Whether the whole string matches; false for others and for patterns that are not interoperable."""
    return _found(v, pattern, r"\A(?:%s)\z")


def search(v: Value, pattern: str) -> Column:
    return _found(v, pattern, "%s")


def _found(v: Value, pattern: str, frame: str) -> Column:
    p, v = _regex(pattern), v.scalar(S) if v.kind == "variant" else v
    return F.coalesce(v.col.rlike(frame % p), F.lit(False)) if v.kind == "string" and p is not None else F.lit(False)


def starts_with(v: Value, x: str) -> Column:
    return F.coalesce(v.col.startswith(x), F.lit(False)) if v.kind == "string" else F.lit(False)


def ends_with(v: Value, x: str) -> Column:
    return F.coalesce(v.col.endswith(x), F.lit(False)) if v.kind == "string" else F.lit(False)


def contains(v: Value, x) -> Column:
    """A part of a string, or an element of an array."""
    if v.kind == "array":
        return F.coalesce(F.exists(v.col, lambda e: Value(e, v.dtype.elementType) == x), F.lit(False))
    return F.coalesce(v.col.contains(x), F.lit(False)) if v.kind == "string" and isinstance(x, str) else F.lit(False)


def lower(v: Value) -> Value:
    return _if(v, ("string",), F.lower, S)


def upper(v: Value) -> Value:
    return _if(v, ("string",), F.upper, S)


def trim(v: Value) -> Value:
    return _if(v, ("string",), lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""), S)


def substring(v: Value, start: int, end: int) -> Value:
    """From start to end; both are clamped at 0 and swapped if out of order."""
    a, b = sorted((max(start, 0), max(end, 0)))
    return _if(v, ("string",), lambda c: F.substring(c, a + 1, b - a), S)


def split(v: Value, sep: str) -> Value:
    pattern = "(?!^)(?!$)" if sep == "" else re.sub(r"([^\w\s])", r"\\\1", sep)
    return _if(v, ("string",), lambda c: F.split(c, pattern, -1), T.ArrayType(S))


def first(v: Value) -> Value:
    return v[0]


def last(v: Value) -> Value:
    return v[-1]


def reverse(v: Value) -> Value:
    return _if(v, ("array",), F.reverse, v.dtype)


def sort(v: Value) -> Value:
    return _if(v, ("array",), F.array_sort, v.dtype)


def unique(v: Value) -> Value:
    return _if(v, ("array",), F.array_distinct, v.dtype)


def flatten(v: Value) -> Value:
    nested = v.kind == "array" and isinstance(v.dtype.elementType, T.ArrayType)
    return Value(F.flatten(v.col), v.dtype.elementType) if nested else _if(v, ("array",), lambda c: c, v.dtype)


def _numbers(v: Value) -> Column | None:
    if v.kind != "array" or type_class(v.dtype.elementType) != "number":
        return None
    return F.filter(F.transform(v.col, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _reduced(v: Value, make) -> Value:
    n = _numbers(v)
    return absent() if n is None else Value(make(n), D)


def minimum(v: Value) -> Value:
    return _reduced(v, F.array_min)


def maximum(v: Value) -> Value:
    return _reduced(v, F.array_max)


def total(v: Value) -> Value:
    return _reduced(v, lambda n: F.aggregate(n, F.lit(0.0), lambda a, x: a + x))


def average(v: Value) -> Value:
    return _reduced(v, lambda n: F.try_divide(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), F.size(n)))


def count(v: Value) -> Value:
    """Nodes of a node list, given as an array."""
    return _if(v, ("array",), lambda c: F.size(c).cast("long"), L)


def floor(v: Value) -> Value:
    return _if(v, ("number",), lambda c: F.floor(c.cast("double")).cast("double"), D)


def ceil(v: Value) -> Value:
    return _if(v, ("number",), lambda c: F.ceil(c.cast("double")).cast("double"), D)


def round_half_up(v: Value) -> Value:
    """Halves go towards plus infinity: -2.5 becomes -2."""
    return _if(v, ("number",), lambda c: F.floor(c.cast("double") + 0.5).cast("double"), D)


def absolute(v: Value) -> Value:
    return _if(v, ("number",), lambda c: F.abs(c.cast("double")), D)


def is_type(v: Value, kind: str) -> Column:
    return F.coalesce(v.runtime_kind() == kind, F.lit(False))


def to_string(v: Value) -> Value:
    """Containers become JSON text, a null the word null."""
    text = v.col if v.kind == "string" else F.to_json(v.col) if v.kind in ("array", "object") else v.col.cast("string")
    return Value(F.when(v.exists(), F.coalesce(text, F.lit("null"))), S)


def to_number(v: Value) -> Value:
    """Strings are trimmed, an empty one is 0, hexadecimal is read, anything else is absent; booleans are 1 and 0, a null 0."""
    if v.kind == "variant":
        kinds = F.when(v.runtime_kind() == "number", v.scalar(D).col).when(v.runtime_kind() == "boolean", v.scalar(B).col.cast("double")).when(v.runtime_kind() == "null", F.lit(0.0))
        return Value(F.coalesce(kinds, to_number(v.scalar(S)).col), D)
    if v.kind == "string":
        s = F.trim(v.col)
        return Value(F.when(s == "", F.lit(0.0)).when(s.rlike(r"\A0[xX][0-9a-fA-F]+\z"), _hexadecimal(F.ltrim(F.substring(s, F.lit(3), F.length(s)), F.lit("0")))).otherwise(s.try_cast("double")), D)
    return _if(v, ("number", "boolean"), lambda c: c.cast("double"), D)


def _hexadecimal(digits: Column) -> Column:
    """Hexadecimal digits without leading zeros as a double: 31 of them are held exactly, further ones scale."""
    n, kept = F.length(digits), F.substring(digits, 1, 31)
    exact = lambda part: F.coalesce(F.conv(part, 16, 10), F.lit("0")).cast("decimal(20,0)").cast("decimal(38,0)")
    low = F.least(F.length(kept), F.lit(16))
    head = exact(F.substring(kept, F.lit(1), F.length(kept) - low)) * F.lit(str(1 << 64)).cast("decimal(20,0)")
    value = head.cast("decimal(38,0)") + exact(F.substring(kept, F.length(kept) - low + 1, low))
    return value.cast("double") * F.pow(F.lit(16.0), F.greatest(n - 31, F.lit(0)))


def to_boolean(v: Value) -> Column:
    """False for what is absent, null, 0, not a number or empty."""
    if v.kind == "variant":
        kind = v.runtime_kind()
        return F.coalesce(F.when(kind == "boolean", v.scalar(B).col).when(kind == "number", to_boolean(v.scalar(D))).otherwise(length(v).col > 0), F.lit(False))
    if v.kind == "number":
        return F.coalesce((v.col != 0) & ~F.isnan(v.col.cast("double")), F.lit(False))
    if v.kind in ("string", "array", "object"):
        return F.coalesce(length(v).col > 0, F.lit(False))
    return F.coalesce(v.col, F.lit(False)) if v.kind == "boolean" else F.lit(False)


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)
