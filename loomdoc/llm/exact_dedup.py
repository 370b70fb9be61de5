"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each input partition cuts its rows into blocks of about block_bytes of text, folds equal
   texts of a block into one row and writes them to a table that is bucketed by block. With
   it go, for each owner of a range of fingerprints, the block's sorted fingerprints as
   Golomb-Rice coded gaps. Fingerprints have SPARE bits more than the rows need to be told
   apart, so a gap costs about SPARE + 2 + log2(blocks) bits and one text in 2**SPARE is
   suspected in vain.
2. Owners decode the fingerprints of all blocks and answer each block with a bitmap: which of
   its fingerprints are held more than once, in the block itself or elsewhere.
3. The bitmaps return to the blocks (the table is bucketed by block, so no text moves).
   Only suspects are shuffled, and verified by grouping on their bytes; texts that only
   share a fingerprint fall apart again there.

A hot text costs one row a block, not one a copy, in every shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, byte_texts, parts, table, written

#: Bytes of text that a block holds, but for its last batch; a task holds one block.
BLOCK_BYTES = 32 << 20
#: Rows that a bucket of blocks holds about; Spark allows 100,000 buckets.
BUCKET_ROWS = 100_000
#: Bits of a fingerprint beyond those that number the rows.
SPARE = 8
_BLOCKS = "block long, owner int, rank int, text_sha256 string, body binary, ids array<long>, nulls int, coded binary"


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code with parameter 2**k of sorted, distinct uint64 values.

    Layout: count (4 bytes), k (1 byte), then each gap less one (of the first value: the value
    itself) as a unary quotient ended by a 0 bit and k bits of remainder, lowest first.
    """
    head = len(values).to_bytes(4, "little") + bytes([k])
    if not len(values):
        return head
    gaps = np.concatenate([values[:1], np.diff(values) - np.uint64(1)])
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1 + k)
    starts = ends - (quotient + 1 + k)
    bits = np.zeros(int(ends[-1]), np.uint8)
    within = np.arange(int(quotient.sum())) - np.repeat(np.cumsum(quotient) - quotient, quotient)
    bits[np.repeat(starts, quotient) + within] = 1
    for b in range(k):
        bits[starts + quotient + 1 + b] = ((gaps >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
    return head + np.packbits(bits).tobytes()


def golomb_decode(coded: bytes) -> np.ndarray:
    """The values of golomb_encode.

    Each code starts k bits after the zero that ends the unary part before it, so the starts
    follow from a jump table over the zeros. The table is applied to itself until it spans the
    whole row of codes: every doubling fills in twice as many starts at once.
    """
    n, k = int.from_bytes(coded[:4], "little"), coded[4]
    if n == 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(coded, np.uint8, offset=5))
    zeros = np.flatnonzero(bits == 0)
    # from the zero that ends one unary part to the zero that ends the next, as numbers into zeros
    jump = np.minimum(np.searchsorted(zeros, zeros + k + 1), len(zeros) - 1)
    at, known = np.zeros(n, np.int64), 1
    while known < n:
        more = min(known, n - known)
        at[known : known + more] = jump[at[:more]]
        known += more
        if known < n:
            jump = jump[jump]
    ends = zeros[at]
    starts = np.concatenate([[0], ends[:-1] + 1 + k])
    gaps = (ends - starts).astype(np.uint64) << np.uint64(k)
    for b in range(k):
        gaps |= bits[ends + 1 + b].astype(np.uint64) << np.uint64(b)
    gaps[1:] += np.uint64(1)
    return np.cumsum(gaps, dtype=np.uint64)


def rice_parameter(n: int, span: int) -> int:
    """k for which 2**k is near ln 2 times the mean gap of n values over span."""
    return max(0, int(span * 0.69 / max(n, 1)).bit_length() - 1)


def _block(rows: dict[bytes, list], block: int, owners: int, bits: int):
    """The rows of one block: folded texts, the first of each owner with the owner's coded message."""
    import pyarrow as pa
    import xxhash

    span = (1 << bits) // owners + 1
    bodies = list(rows)
    prints = np.array([xxhash.xxh64_intdigest(b) >> (64 - bits) for b in bodies], np.uint64)
    order = np.argsort(prints, kind="stable")
    prints, bodies = prints[order], [bodies[i] for i in order]
    size = np.array([len(rows[b]) for b in bodies], np.int64)
    fresh = np.concatenate([[True], prints[1:] != prints[:-1]])  # the first row of each distinct fingerprint
    distinct, number = prints[fresh], np.cumsum(fresh) - 1
    twice = np.bincount(number, size) > 1  # whether the block itself holds a fingerprint twice
    bounds = np.searchsorted(distinct, np.arange(owners, dtype=np.uint64) * np.uint64(span))
    whose = np.searchsorted(bounds, np.arange(len(distinct)), side="right") - 1
    first_row = np.flatnonzero(fresh)
    coded: list[bytes | None] = [None] * len(bodies)
    for owner in np.unique(whose):
        lo, hi = int(bounds[owner]), int(bounds[owner + 1]) if owner + 1 < owners else len(distinct)
        code = golomb_encode(distinct[lo:hi] - np.uint64(int(owner) * span), rice_parameter(hi - lo, span))
        coded[first_row[lo]] = len(code).to_bytes(4, "little") + code + np.packbits(twice[lo:hi]).tobytes()
    ids = [[x for x in rows[b] if x is not None] for b in bodies]
    owner = whose[number]
    columns = [
        pa.array(np.full(len(bodies), block)), pa.array(owner.astype(np.int32)), pa.array((number - bounds[owner]).astype(np.int32)),
        pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()), pa.array(bodies, pa.binary()), pa.array(ids, pa.list_(pa.int64())),
        pa.array((size - np.array([len(x) for x in ids])).astype(np.int32)), pa.array(coded, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _BLOCKS.split(", ")])


def _blocks(owners: int, bits: int, block_bytes: int):
    def cut(batches):
        from pyspark import TaskContext

        block, rows, held = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                body = body.lower()
                if body not in rows:
                    rows[body] = []
                    held += len(body)
                rows[body].append(doc_id)
                held += 8
                if held >= block_bytes:
                    yield _block(rows, block, owners, bits)
                    block, rows, held = block + 1, {}, 0
        if rows:
            yield _block(rows, block, owners, bits)

    return cut


def _answers(sent):
    """Of one owner: for each block the bitmap of its fingerprints that are held twice or more."""
    import pandas as pd

    codes = [bytes(x) for x in sent.coded]
    cuts = [int.from_bytes(x[:4], "little") for x in codes]
    held = [golomb_decode(x[4 : 4 + n]) for x, n in zip(codes, cuts, strict=True)]
    distinct, counts = np.unique(np.concatenate(held), return_counts=True)
    flags = [np.unpackbits(np.frombuffer(x, np.uint8, offset=4 + n))[: len(h)].astype(bool) for x, n, h in zip(codes, cuts, held, strict=True)]
    answers = [np.packbits((counts[np.searchsorted(distinct, h)] > 1) | f).tobytes() for h, f in zip(held, flags, strict=True)]
    return pd.DataFrame({"block": sent.block, "owner": sent.owner, "bitmap": answers})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_rows: int = 4_000_000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null text is an empty
    one, and empty texts form a group like others. The row with the largest id stays, and
    rows that repeat its id stay with it; a null id stays only if its group has no other.
    An empty input gives no rows. Other columns of docs, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    n = rows.count()
    owners, bits = max(parts(spark), n // owner_rows + 1), min(60, n.bit_length() + SPARE)
    buckets = min(max(parts(spark), n // BUCKET_ROWS, 8), 100_000)
    blocks = bucketed(rows.mapInArrow(_blocks(owners, bits, block_bytes), _BLOCKS), "block", buckets, "blocks")
    bitmaps = blocks.where("coded IS NOT NULL").select("block", "owner", "coded").groupBy("owner").applyInPandas(_answers, "block long, owner int, bitmap binary")
    # one row for each block, so that the text side is joined in place on its bucket column alone
    bitmaps = written(bitmaps.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("owner", F.hex("bitmap").alias("bitmap")))).alias("bitmaps")), "bitmaps")
    suspect = F.expr("(cast(conv(substring(bitmaps[owner], cast(floor(rank / 4) as int) + 1, 1), 16, 10) as int) & shiftleft(1, 3 - rank % 4)) != 0")
    seen = blocks.drop("coded").join(bitmaps, "block").withColumn("suspect", suspect)
    size = (F.size("ids") + F.col("nulls")).cast("long")
    one = seen.where(~F.col("suspect")).select("text_sha256", F.array_max("ids").alias("keep_id"), size.alias("group_size"), "ids", "nulls")
    some = seen.where("suspect").withColumn("n", size).withColumn("top", F.array_max("ids"))
    groups = some.groupBy("body").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size")).select(F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    many = some.select("text_sha256", "ids", "nulls").join(groups, "text_sha256").select(*one.columns)
    every = one.unionByName(many).withColumn("doc_id", F.explode(F.concat("ids", F.array_repeat(F.lit(None).cast("long"), F.col("nulls")))))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return every.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
