"""SimHash near-dedup on a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits; a segment's coordinate is its popcount,
0, 1 or 2. The Manhattan distance of two such points never exceeds the Hamming distance of
the fingerprints, so points further apart than the limit d need no look. The grid: the
segments form d + 3 groups; if the Manhattan distance is at most d, at most d groups differ,
and some choice of three groups agrees in every coordinate. Each choice spans a grid over 16 of
the 32 coordinates, and a point stands in one cell of each grid; the range join pairs cell
mates that the Manhattan bound over all coordinates (a XOR of the unary coded ones) lets
through, and verifies those exactly. Probing the cells at distance one in two halves would
pair the same points at the same cell sizes, for 52 rows a point instead of 20.

Cells hold distinct fingerprints, never copies. A cell over cell_rows is cut into chunks and
every pair of chunks becomes a cell of its own, which is exact. Cells with over RUN members
give a spanning forest of their links instead of all of them: components come out the same.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, parts, table, written

#: Cells up to this many members are compared by shifts over whole batches.
RUN = 32


def fingerprint(text: bytes, n: int = 3) -> int:
    """The 64-bit SimHash of a text's word n-grams, repeats counted; 0 without a word."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -n] + 1]).tolist()
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long); a null text is an empty one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t) for t in byte_texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Each two-bit segment's popcount in unary code (00, 01, 11): XOR counts Manhattan distance."""
    odd = np.uint64(0x5555555555555555)
    high, low = (fp >> np.uint64(1)) & odd, fp & odd
    return ((high & low) << np.uint64(1)) | (high | low)


def masks(distance: int) -> list[int]:
    """The bits of each choice of three out of distance + 3 groups of segments."""
    cut = np.array_split(np.arange(32), distance + 3)
    group = [sum(3 << (2 * int(i)) for i in g) for g in cut]
    return [sum(c) for c in itertools.combinations(group, 3)]


def _cells(distance: int):
    chosen = np.array(masks(distance), np.uint64)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            cells = embed(fp)[:, None] & chosen[None, :]
            kind = np.broadcast_to(np.arange(len(chosen), dtype=np.int32), cells.shape)
            yield pa.RecordBatch.from_arrays([pa.array(kind.ravel()), pa.array(cells.ravel().view(np.int64)), pa.array(np.repeat(fp.view(np.int64), len(chosen)))], ["kind", "cell", "fp"])

    return run


def _near(a, b, distance: int):
    """Whether pairs pass the Manhattan bound and then the exact test."""
    close = np.bitwise_count(embed(a) ^ embed(b)) <= distance
    close[close] = np.bitwise_count((a ^ b)[close]) <= distance
    return close


def _forest(members: np.ndarray, distance: int):
    """Links that connect all of members that links connect: a breadth-first search over blocks."""
    rest, found = np.unique(members), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = _near(np.full(len(rest), x), rest, distance)
            if hit.any():
                found.append(np.stack([np.full(int(hit.sum()), x), rest[hit]], 1))
                front.extend(rest[hit])
                rest = rest[~hit]
    return found


def _links(distance: int):
    def inside(keys, fps):
        """Links within runs of equal keys; keys: a structured array, sorted."""
        bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        length = np.diff(bounds)
        found = [x for s, n in zip(bounds[:-1][length > RUN], length[length > RUN], strict=True) for x in _forest(fps[s : s + n], distance)]
        run = np.repeat(np.where(length <= RUN, np.arange(len(length)), -1), length)
        for step in range(1, min(RUN, int(length.max(initial=0)))):
            at = np.flatnonzero((run[step:] == run[:-step]) & (run[step:] >= 0))
            at = at[_near(fps[at], fps[at + step], distance)]
            found.append(np.stack([fps[at], fps[at + step]], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]].view(np.int64)
        return np.unique(np.sort(pairs, 1), axis=0)

    def run(batches):
        import pyarrow as pa

        held_keys, held_fps = None, None
        kind = [("kind", np.int32), ("cell", np.int64), ("chunk", np.int64)]

        def out(keys, fps):
            pairs = inside(keys, fps)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.empty(len(batch), kind)
            for name, _ in kind:
                keys[name] = batch.column(name).to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if held_keys is not None:
                keys, fps = np.concatenate([held_keys, keys]), np.concatenate([held_fps, fps])
            tail = int(np.flatnonzero(keys != keys[-1])[-1] + 1) if (keys != keys[-1]).any() else 0
            if tail:
                yield out(keys[:tail], fps[:tail])
            held_keys, held_fps = keys[tail:], fps[tail:]
        if held_keys is not None:
            yield out(held_keys, held_fps)

    return run


def links(points: DataFrame, distance: int = 3, cell_rows: int = 8192) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp of points) that span every component."""
    cells = points.mapInArrow(_cells(distance), "kind int, cell long, fp long")
    count = cells.groupBy("kind", "cell").count()
    hot = written(count.where(F.col("count") > cell_rows).withColumn("chunks", F.ceil(F.col("count") / cell_rows).cast("long")).drop("count"), "hot")
    if hot.isEmpty():
        dealt = cells.withColumn("chunk", F.lit(0).cast("long"))
    else:
        n, mine = F.col("chunks"), F.pmod(F.xxhash64("fp"), F.col("chunks"))
        pair = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.least(mine, j) * n + F.greatest(mine, j))
        dealt = cells.join(hot, ["kind", "cell"], "left").withColumn("chunk", F.explode(F.when(n.isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair))).drop("chunks")
    dealt = dealt.repartition(parts(points.sparkSession), "kind", "cell", "chunk").sortWithinPartitions("kind", "cell", "chunk")
    return dealt.mapInArrow(_links(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it reaches) for the nodes of edges, by large-star and small-star rounds.

    Each round is a grouping and a join on the node, written to the shared folder; it ends
    when a round changes nothing, as then every node hangs on its root. Rounds grow with the
    square of the logarithm of the nodes at most; there is no cap.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    mark, now = None, edges.agg(F.count("*").alias("n"), F.lit(None).cast("decimal(38,0)").alias("s")).first()
    while mark != now and now.n:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
        mark, now = now, edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_dedup(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", hot_share: float = 0.001, cell_rows: int = 8192) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the least id it reaches).

    Null and empty texts have the fingerprint zero, which links like any other. Repeated
    rows stay; a null id is no component's least id unless it has no other, then null. An
    empty input gives no rows. Other columns of docs are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "points")
    roots = components(links(points.select("fp"), distance, cell_rows))
    rooted = points.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "component_id", "n"), "named")
    # a fingerprint with over hot_share of all rows (at most 1 / hot_share of them) is sent to its rows, not its rows to it
    least_hot = max(1.0, hot_share * (prints.count() or 1))
    hot = F.broadcast(named.where(F.col("n") > least_hot).select("fp", "component_id"))
    rest = prints.join(hot.select("fp"), "fp", "left_anti").join(named.where(F.col("n") <= least_hot).select("fp", "component_id"), "fp")
    every = prints.join(hot, "fp").unionByName(rest)
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
