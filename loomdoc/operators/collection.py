"""Ordered collections: data frames with an explicit position column, pos, from 0.

Positions are dense within `by` (several collections in one frame) or within the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, *order, by: tuple[str, ...] = ()) -> DataFrame:
    """df with pos in that order. Without `by` the frame is numbered by a range sort and counts
    per partition, so no task sees all rows. Both read one sorted copy, checkpointed where the
    session names a folder for it (spark.checkpoint.dir), so ties can't fall differently."""
    if by:
        return df.withColumn("pos", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    part = df.sort(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        part = part.checkpoint()
    first = part.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("low"))
    first = first.withColumn("before", F.sum("n").over(Window.orderBy("_p")) - F.col("n")).select("_p", "low", "before")
    return part.join(F.broadcast(first), "_p").withColumn("pos", F.col("before") + F.col("_i") - F.col("low")).drop("_p", "_i", "low", "before")


def _from_end(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """df with _n, the size of the row's collection."""
    if by:
        return df.join(df.groupBy(*by).agg(F.count("*").alias("_n")), list(by))
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))


def at(df: DataFrame, *positions: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows at positions, from the end if negative; those that are not there are dropped."""
    low = [p for p in positions if p >= 0]
    if len(low) == len(positions):
        return df.where(F.col("pos").isin(*low))
    n = _from_end(df, by)
    return n.where(F.col("pos").isin(*low) | (F.col("pos") - F.col("_n")).isin(*(p for p in positions if p < 0))).drop("_n")


def chunk(df: DataFrame, size: int, *cols: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of `size` rows: chunk and rows (an array of cols in order)."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", *cols))), lambda r: F.struct(*(r[c].alias(c) for c in cols)))
    return df.groupBy(*by, F.floor(F.col("pos") / size).alias("chunk")).agg(rows.alias("rows"))


def find(df: DataFrame, test: Column, right: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """The first (or last) row for which test holds."""
    row = F.struct(*df.columns)
    return df.where(test).groupBy(*by).agg((F.max_by if right else F.min_by)(row, "pos").alias("r")).select("r.*")


def take(df: DataFrame, n: int, right: bool = False, offset: int = 0, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """n rows from the left (or right) end after an offset, and the rest."""
    if right:
        d = _from_end(df, by)
        inside = (F.col("pos") < F.col("_n") - offset) & (F.col("pos") >= F.col("_n") - offset - n)
        return d.where(inside).drop("_n"), d.where(~inside).drop("_n")
    inside = (F.col("pos") >= offset) & (F.col("pos") < offset + n)
    return df.where(inside), df.where(~inside)


def give(df: DataFrame, rows: DataFrame, offset: int = 0, by: tuple[str, ...] = (), right: bool = False) -> DataFrame:
    """df with rows (of the same columns, with a pos of their own) put in at offset from the left, or from the right end."""
    sized = lambda d, other, name: d.join(other.groupBy(*by).agg(F.count("*").alias(name)), list(by), "left") if by else d.crossJoin(F.broadcast(other.agg(F.count("*").alias(name))))
    both = lambda d: sized(sized(d, rows, "_m"), df, "_k").withColumns({"_m": F.coalesce("_m", F.lit(0)), "_k": F.coalesce("_k", F.lit(0))})
    at = F.greatest(F.col("_k") - offset, F.lit(0)) if right else F.least(F.lit(offset), F.col("_k"))
    old = both(df).withColumn("pos", F.col("pos") + F.when(F.col("pos") >= at, F.col("_m")).otherwise(0))
    return old.unionByName(both(rows).withColumn("pos", F.col("pos") + at)).drop("_m", "_k")


def group_lists(df: DataFrame, key: Column, *cols: str, size: int = 4096) -> DataFrame:
    """key, chunk and rows: each group's rows in order, in runs of at most `size` rows.

    A group's runs in the order of chunk make up the group; chunk ascends with it, with gaps. Rows
    are range-sorted by key, pos and cols, so a large group is dealt over tasks and no list grows with it.
    """
    names = [f"_c{i}" for i in range(len(cols))]
    part = df.select(key.alias("_key"), F.col("pos").alias("_pos"), *(F.col(c).alias(n) for c, n in zip(cols, names, strict=True))).sort("_key", "_pos", *names)
    part = part.withColumn("_i", F.monotonically_increasing_id())
    # the partition in the high bits, as in _i, and the run within it
    chunk = F.shiftleft(F.shiftright("_i", 33), 33) + F.floor(F.col("_i").bitwiseAND((1 << 33) - 1) / size)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("_i", *names))), lambda r: F.struct(*(r[n].alias(c) for c, n in zip(cols, names, strict=True))))
    return part.groupBy(F.col("_key").alias("key"), chunk.alias("chunk")).agg(rows.alias("rows"))


def has_any(df: DataFrame, test: Column, by: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("has"))


def has_all(df: DataFrame, tests: list[Column], by: tuple[str, ...]) -> DataFrame:
    """Whether each test holds for some row."""
    every = [F.coalesce(F.bool_or(t), F.lit(False)).alias(f"t{i}") for i, t in enumerate(tests)]
    return df.groupBy(*by).agg(*every).select(*by, F.array_min(F.array(*(F.col(f"t{i}") for i in range(len(tests))))).alias("has"))


def reverse(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _from_end(df, by).withColumn("pos", F.col("_n") - 1 - F.col("pos")).drop("_n")


def sort_by(df: DataFrame, *order, by: tuple[str, ...] = ()) -> DataFrame:
    """Renumbered by order; ties keep their order."""
    return numbered(df.withColumnRenamed("pos", "_pos"), *order, F.col("_pos"), by=by).drop("_pos")


def shuffle(df: DataFrame, seed: int, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Renumbered in a random order that seed and key decide, alike in every run."""
    return sort_by(df, F.xxhash64(F.lit(seed), F.col(key)), by=by)


def take_random(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n distinct rows that seed and key decide."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def cross(a: DataFrame, b: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The product of two small enumerations, such as suits and ranks; an error if it has over `most` rows."""
    if a.limit(most + 1).count() * b.limit(most + 1).count() > most:
        raise ValueError(f"a product of over {most} rows")
    return a.crossJoin(b)


def clamped_score(start: float, changes: Column, low: float, high: float) -> Column:
    """The score after an array of changes, each clamped to the bounds."""
    return F.aggregate(changes, F.lit(float(start)), lambda s, c: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), s + c)))


def packed_id(fields: dict[str, int]) -> Column:
    """Byte fields, each a column name with its shift in bits, as one bigint."""
    return sum((F.shiftleft(F.col(c).cast("long"), s) for c, s in fields.items()), F.lit(0).cast("long"))


def field_of_id(packed: Column, shift: int, bits: int = 8) -> Column:
    """A field of a packed id."""
    return F.shiftright(packed, shift).bitwiseAND((1 << bits) - 1)


def hex_id(packed: Column, digits: int = 8) -> Column:
    """A packed id as lower-case hexadecimal, filled with zeros."""
    return F.lower(F.lpad(F.hex(packed), digits, "0"))


def named(code: Column, names: dict[int, str]) -> Column:
    """The name of a code; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code)


def fold(df: DataFrame, start: Column, step, *cols: str, by: tuple[str, ...], right: bool = False) -> DataFrame:
    """value: step(total, row) over each collection's rows in order, for folds that no aggregate says.

    A collection's rows meet in one row of the plan, so it is for collections that fit there.
    """
    rows = F.sort_array(F.collect_list(F.struct("pos", *cols)))
    return df.groupBy(*by).agg(rows.alias("rows")).select(*by, F.aggregate(F.reverse("rows") if right else F.col("rows"), start, step).alias("value"))


def ancestors(df: DataFrame, key: str, parent: str, depth: int = 8) -> DataFrame:
    """key, ancestor, distance: every ancestor of every row of a table of parents.

    One join a level, each over the rows alone: a row carries its line of ancestors. Lines longer
    than depth, and so all cycles, stop the query with an error.
    """
    up = df.where(F.col(parent).isNotNull()).select(F.col(key).alias("_at"), F.col(parent).alias("_up"))
    lines = up.select(F.col("_at").alias("key"), F.array("_up").alias("line"))
    for _ in range(depth):
        last = F.try_element_at("line", F.lit(-1))
        lines = lines.join(up, last == F.col("_at"), "left").select("key", F.when(F.col("_up").isNull(), F.col("line")).otherwise(F.array_append("line", F.col("_up"))).alias("line"))
    short = F.when(F.size("line") <= depth, True).otherwise(F.raise_error(F.lit(f"more than {depth} ancestors")).cast("boolean"))
    return lines.where(short).select("key", F.posexplode("line").alias("_i", "ancestor")).select("key", "ancestor", (F.col("_i") + 1).alias("distance"))
