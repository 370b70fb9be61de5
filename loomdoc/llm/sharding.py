"""Sharding by a two-pass external shuffle.

Pass one scatters whole records by a seeded hash of all they hold into buckets of about
bucket_bytes, one Spark partition a bucket. Pass two loads one bucket a task, orders it
canonically, so that reruns agree, Fisher-Yates shuffles it with a generator seeded by the
bucket, and writes it. With the buckets laid end to end, record number p goes to shard
p mod shards, slot p div shards: counts are at most one apart, and each shard draws evenly on
every bucket.

Identical rows hash alike. A group of them that would fill a bucket is counted first, and its
copies are numbered and scattered by their number, so that no bucket holds more than a few
bucket_bytes whatever the table repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def fisher_yates(n: int, seed: tuple[int, ...]):
    """A permutation of range(n), by numpy's Fisher-Yates shuffle with a seeded generator."""
    import numpy as np

    order = np.arange(n)
    np.random.Generator(np.random.PCG64(seed)).shuffle(order)
    return order


def _scattered(docs: DataFrame, buckets: int, seed: int, bucket_bytes: int, weight) -> DataFrame:
    """docs with _h, the hash of a whole row, _nth, its number in a large group of equal rows, and its bucket."""
    plain = [f.name for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    hashed = docs.withColumn("_h", F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in plain)))
    # a group weighs over bucket_bytes at most `buckets` times, so this is small enough to be sent
    groups = hashed.groupBy("_h").agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    large = F.broadcast(groups.where((F.col("_w") > bucket_bytes) & (F.col("_n") > 1)).select("_h"))
    apart = hashed.join(large, "_h", "left_anti").withColumn("_nth", F.lit(0).cast("long"))
    folded = hashed.join(large, "_h", "left_semi").groupBy(*hashed.columns).agg(F.count("*").alias("_n"))
    copies = folded.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    return apart.unionByName(copies).withColumn("_bucket", F.pmod(F.xxhash64("_h", "_nth"), F.lit(buckets)).cast("int"))


def external_shuffle(docs: DataFrame, shards: int = 40, seed: int = 11, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' own columns, then shard (int) and slot (long, gapless from 0 in each shard).

    Nulls in any column are kept; a null text weighs 16 bytes like an empty one. Rows that
    repeat an id are scattered by what else they hold; identical rows may trade places, which
    no one can tell. A text longer than bucket_bytes makes its bucket that much larger. An
    empty input gives no rows. Columns named shard or slot are replaced; those named _h, _n,
    _nth, _bucket or _first, which are this operator's own, are dropped.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot", "_h", "_n", "_nth", "_bucket", "_first")]
    weight = F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(16)
    total = docs.agg(F.sum(weight).alias("b")).first()["b"] or 0
    buckets = int(max(1, -(-total // bucket_bytes)))
    records = _scattered(docs.select(*(F.col(f"`{c}`") for c in own)), buckets, seed, bucket_bytes, weight)
    count = records.groupBy("_bucket").count()
    first = count.select("_bucket", (F.sum("count").over(Window.orderBy("_bucket")) - F.col("count")).alias("_first"))

    def shuffled(rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        head = pc.is_valid(rows.column("_first"))
        first = rows.filter(head).column("_first")[0].as_py()
        bucket = rows.column("_bucket")[0].as_py()
        # the canonical order: by the hash of all that a row holds, then by id and text
        rows = rows.filter(pc.invert(head)).sort_by([("_h", "ascending"), (id_col, "ascending"), (text_col, "ascending")]).drop_columns(["_h", "_nth", "_bucket", "_first"])
        rows = rows.take(pa.array(fisher_yates(len(rows), (seed, bucket))))
        place = first + np.arange(len(rows))
        return rows.append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))

    # a bucket's first record number travels with it, as a row of its own; records are shuffled once, a bucket to a partition
    schema = docs.select(*(F.col(f"`{c}`") for c in own)).schema.add("shard", "integer").add("slot", "long")
    dealt = records.withColumn("_first", F.lit(None).cast("long")).unionByName(first, allowMissingColumns=True).repartitionById(buckets, "_bucket")
    return dealt.groupBy("_bucket").applyInArrow(shuffled, schema)


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 11, bucket_bytes: int = 32 << 20) -> None:
    """Writes the shuffled records as Parquet, one folder a shard.

    Pass two writes what it shuffled: each bucket adds a file to every shard, its records in slot
    order, and no record is shuffled again.
    """
    external_shuffle(docs, shards, seed, bucket_bytes).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return external_shuffle(table(spark, sf_dir, "documents")).select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
