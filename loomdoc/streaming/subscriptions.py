"""Subscriptions to changes of documents, for batch and streaming frames alike.

A change has seq, ts, pointer, value and previous_value. Patterns are paths of names, indexes
and stars; they become regular expressions over pointers, and many subscriptions become one
join with a small table of patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdoc.functions.paths import Path, pattern


def on_pointer(changes: DataFrame, pointer: str, deep: bool = False) -> DataFrame:
    """Changes at a pointer, and below it if deep."""
    here = F.col("pointer") == pointer
    return changes.where(here | F.col("pointer").startswith(pointer + "/") if deep else here)


def immediately(changes: DataFrame, state: DataFrame, pointer: str, deep: bool = False) -> DataFrame:
    """As on_pointer, with what the state has there already as first changes, which have no seq."""
    now = on_pointer(state, pointer, deep).select([F.col(c) if c in state.columns else F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in changes.columns if c != "seq"])
    return on_pointer(changes, pointer, deep).unionByName(now.withColumn("seq", F.lit(None).cast(changes.schema["seq"].dataType)))


def on_pattern(changes: DataFrame, path: Path) -> DataFrame:
    return changes.where(F.col("pointer").rlike(pattern(path)))


def deliver(changes: DataFrame, subscriptions: dict[str, Path]) -> DataFrame:
    """subscriber with each change that its path takes in.

    The table of subscriptions is a literal of the plan, so it is as small as the caller's dict.
    """
    hits = F.filter(F.array(*(F.when(F.col("pointer").rlike(pattern(p)), F.lit(s)) for s, p in subscriptions.items())), lambda s: s.isNotNull())
    return changes.select(F.explode(hits).alias("subscriber"), "*")


def last_per_subscriber(delivered: DataFrame) -> DataFrame:
    """What is left of a batch: each subscriber's last change."""
    rest = [c for c in delivered.columns if c != "subscriber"]
    return delivered.groupBy("subscriber").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("subscriber", "e.*")


def coalesce_pointers(changes: DataFrame) -> DataFrame:
    """A batch with one change a pointer: its last value, and what was there before the batch."""
    return changes.groupBy("pointer").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"), F.min_by("previous_value", "seq").alias("previous_value"))


def debounce(changes: DataFrame, gap: str, watermark: str | None = None, keys: tuple[str, ...] = ("pointer",)) -> DataFrame:
    """The last change of each run of changes that are less than gap apart."""
    d = changes.withWatermark("ts", watermark) if watermark else changes
    return d.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.max_by("value", F.struct("ts", "seq")).alias("value"), F.max("ts").alias("ts"), F.count("*").alias("changes")).drop("w")


def changed(changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A batch without changes that leave the value as it was."""
    w = Window.partitionBy(*keys).orderBy("seq")
    before = F.lag(F.struct("value")).over(w)
    return changes.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before.value").eqNullSafe(F.col("value"))).drop("_before")


def computed(state: DataFrame, key: str, pointers: dict[str, str], make: Callable[..., Column]) -> DataFrame:
    """key and value: a value derived from the latest values at several pointers.

    state has one row for each key and pointer; one grouping gathers what the value needs.
    """
    wanted = state.where(F.col("pointer").isin(*pointers.values()))
    cols = [F.max(F.when(F.col("pointer") == p, F.col("value"))).alias(n) for n, p in pointers.items()]
    return wanted.groupBy(key).agg(*cols).select(key, make(*(F.col(n) for n in pointers)).alias("value"))


def query_computed(state: DataFrame, key: str, path: Path, make: Callable[[Column], Column]) -> DataFrame:
    """key and value: a value derived from the array of (pointer, value) at all pointers that a path takes in.

    Which pointers there are may change with the state; they are ordered as text.
    """
    found = state.where(F.col("pointer").rlike(pattern(path)))
    return found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pointer", "value"))).alias("found")).select(key, make(F.col("found")).alias("value"))


def attach(changes: DataFrame, on: Callable[[DataFrame], None], checkpoint: str, before: Callable[[DataFrame], DataFrame] | None = None, after: Callable[[DataFrame], None] | None = None, once: bool = True) -> StreamingQuery:
    """Runs a stream of changes through before (which may drop some), on and after, batch by batch."""

    def batch(df: DataFrame, _: int) -> None:
        df = (before(df) if before else df).persist()
        try:
            on(df)
            if after:
                after(df)
        finally:
            df.unpersist()

    w = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
