"""Reading documents and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions.paths import escape


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Documents of any format that Spark reads; JSON and CSV want a schema."""
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


def parsed(text: Column, schema: str | None = None) -> Column:
    """JSON text as a typed column, or as VARIANT without a schema; null where it is malformed."""
    return F.from_json(text, schema) if schema else F.try_parse_json(text)


def conforms(text: Column, schema: str) -> Column:
    """Whether JSON text is well formed and its values fit a schema's types; members that are missing or unknown do no harm."""
    marked = F.from_json(text, f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    return F.coalesce(marked.isNotNull() & marked["_bad"].isNull(), F.lit(False))


def variant_value(v: Column, *path: str | int, kind: str = "string") -> Column:
    """The value at a singular path of a VARIANT; null where it is absent or of another shape."""
    at = "$" + "".join(f"[{p}]" if isinstance(p, int) else '["{}"]'.format(p.replace('"', '\\"')) for p in path)
    return F.try_variant_get(v, at, kind)


def members(df: DataFrame, variant: str) -> DataFrame:
    """df with a row for each element or member of a VARIANT column: pos, key, value."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(variant).outer()))


_NODE = "array<struct<place:array<int>,pointer:string,depth:int,value:variant>>"


def _inside(n: Column) -> Column:
    """The members or elements of a node, as nodes."""
    node = lambda i, token, value: F.struct(F.array_append(n["place"], i).alias("place"), F.concat(n["pointer"], F.lit("/"), token).alias("pointer"), (n["depth"] + 1).alias("depth"), value.alias("value"))
    members = F.transform(F.map_entries(F.try_variant_get(n["value"], "$", "map<string,variant>")), lambda e, i: node(i, escape(e["key"]), e["value"]))
    elements = F.transform(F.try_variant_get(n["value"], "$", "array<variant>"), lambda e, i: node(i, i.cast("string"), e))
    return F.coalesce(members, elements, F.array().cast(_NODE))


def descendants(df: DataFrame, variant: str, keep: tuple[str, ...] = (), depth: int = 16) -> DataFrame:
    """keep, pointer, depth and value: a VARIANT and all that is below it, one row a node.

    Nodes come in document order. Each level is an array made of the level above inside the document's row, and all levels are
    exploded once, so every node is written once, in one stage without a shuffle or a cap: a
    document with values deeper than depth stops the query with an error.
    """
    root = F.array(F.struct(F.array().cast("array<int>").alias("place"), F.lit("").alias("pointer"), F.lit(0).alias("depth"), F.col(variant).alias("value"))).cast(_NODE)
    out = df.where(F.col(variant).isNotNull()).select(*keep, root.alias("_level0"))
    for k in range(depth + 1):
        out = out.withColumn(f"_level{k + 1}", F.flatten(F.transform(f"_level{k}", _inside)))
    fits = F.when(F.size(f"_level{depth + 1}") == 0, F.concat(*(f"_level{k}" for k in range(depth + 1)))).otherwise(F.raise_error(F.lit(f"values deeper than {depth}")))
    out = out.select(*keep, fits.alias("_all"))
    # in the order of the document, containers before what they hold; VARIANT itself has no order
    order = F.array_sort(F.transform("_all", lambda n, i: F.struct(n["place"].alias("place"), i.alias("i"))))
    return out.select(*keep, F.explode(F.transform(order, lambda s: F.get("_all", s["i"]))).alias("n")).select(*keep, "n.pointer", "n.depth", "n.value")


def descend(df: DataFrame, variant: str, name: str, keep: tuple[str, ...] = (), depth: int = 16) -> DataFrame:
    """keep, pointer, depth and value of the members of that name at any depth of a VARIANT."""
    token = "/" + name.replace("~", "~0").replace("/", "~1")
    return descendants(df, variant, keep, depth).where(F.col("pointer").endswith(token))


def variant_schema(df: DataFrame, variant: str) -> DataFrame:
    """One row: the schema that all of a VARIANT column's values share."""
    return df.agg(F.schema_of_variant_agg(F.col(variant)).alias("schema"))


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    df.write.format(kind).partitionBy(*partition_by).save(path)
