"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each document has a hash of its id and text. Of each source the words are summed by the hash's
leading digits; the running sum over those digits gives nested thresholds: a threshold for
a smaller budget takes a subset of what a larger one takes. The digit in which the budget
runs out is refined by the next digit, for that digit's documents alone, and so on. A plain
filter on the hash then takes the documents; nothing is sorted but the histograms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Bits of the hash that one pass looks at, and passes.
DIGIT, PASSES = 10, 4


def n_words(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """source, source_size, target: total x all sizes shared by weight, at most `most` x a source's size.

    A source is full if the common level (words a unit of weight) passes most x size / weight.
    In the order of that quotient the full sources come first, so running sums find the level
    at which what the others share just uses up what the full ones leave.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_code_point) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("fills_at", F.col("most") / F.col("w"))
    w = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    upto, every = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({"full": F.coalesce(F.sum("most").over(upto), F.lit(0.0)), "rest_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)), "budget": F.sum("source_size").over(every) * F.lit(float(total))})
    # with all earlier sources full, the level that uses the budget up; the first that does not fill its own source is the one
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / F.col("rest_w"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", F.col("source").isNull(), "source", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("w")), F.col("most")).alias("target"))


def _digit(k: int) -> Column:
    return F.shiftrightunsigned("h", 64 - DIGIT * (k + 1)).bitwiseAND((1 << DIGIT) - 1)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, repeats, taken.

    A document is taken whole, `repeats` times: as often as its source's target holds the
    whole source, and once more if its hash is below the source's threshold. The last digit
    to be refined is taken if that comes nearer to the target than leaving it, so a source
    misses its target by half a document or so. Rows that repeat both id and text share a hash
    and are taken alike. A null text has no words, a null source is a source of its own (the
    last), a null id hashes like any other value. An empty input gives no rows. Other columns
    of docs, whatever their names, are not read.
    """
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h")), "sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most)
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")
    state = written(goal.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("at", F.array().cast("array<long>")), "targets")
    # at: the digits of the boundary so far; left: the budget that is to be spent behind it
    for k in range(PASSES):
        inside = reduce(lambda c, i: c & (_digit(i) == F.col("at")[i]), range(k), F.col("left") > 0)
        sums = sized.join(state.select("source", "at", "left").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where(inside).groupBy("source", "at", "left", _digit(k).alias("digit")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        # the first digit whose running sum reaches the budget; there is one, as the budget is at most the words behind `at`
        edge = sums.withColumn("upto", run).where(F.col("upto") >= F.col("left")).groupBy("source").agg(F.min(F.struct("digit", "words", "upto")).alias("e"))
        cut = edge.select(F.col("source").alias("s"), "e")
        last = k == PASSES - 1
        behind = F.col("left") - (F.col("e.upto") - F.col("e.words"))
        # at the last pass the boundary digit is taken whole or not at all, whichever comes nearer
        step = F.when(behind * 2 >= F.col("e.words"), F.col("e.digit") + 1).otherwise(F.col("e.digit")) if last else F.col("e.digit")
        state = state.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", F.when(F.col("e").isNull(), F.lit(0.0)).otherwise(behind).alias("left"), F.when(F.col("e").isNull(), F.concat("at", F.array(F.lit(0).cast("long")))).otherwise(F.concat("at", F.array(step.cast("long")))).alias("at"))
        state = written(state, f"threshold{k}")
    # digits are compared as one number, so a carry of the last digit needs no care
    value = sum((_digit(i) * (1 << DIGIT * (PASSES - 1 - i)) for i in range(PASSES)), F.lit(0).cast("long"))
    limit = sum((F.col("at")[i] * (1 << DIGIT * (PASSES - 1 - i)) for i in range(PASSES)), F.lit(0).cast("long"))
    cuts = state.select(F.col("source").alias("s"), "source_size", "target", "whole", limit.alias("below"))
    out = sized.join(cuts, F.col("source").eqNullSafe(F.col("s"))).withColumn("repeats", F.col("whole") + (value < F.col("below")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
