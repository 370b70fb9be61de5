import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomdoc.llm import exact_dedup as E
from loomdoc.llm import simhash as S

SF = "/root/testdata/sf0.001"


def fold(t):
    return (t or "").encode().lower()


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[fold(t)].append(i)
    return {(i, max(g), len(g), i == max(g), hashlib.sha256(b).hexdigest()) for b, g in groups.items() for i in g}


def brute_print(text):
    words = fold(text).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(prints):
    """prints: id -> fingerprint."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_golomb_round_trip(n):
    span = (1 << 40) // 3
    values = np.unique(np.random.default_rng(n).integers(0, span, n, dtype=np.uint64))
    best = E.rice_parameter(max(n, 1), span)
    for k in (best - 3, best, best + 2):
        coded = E.golomb_encode(values, k)
        assert (E.golomb_decode(coded) == values).all()
    if n > 100:
        assert len(coded) < 4 * n
    dense = np.arange(n, dtype=np.uint64)
    assert (E.golomb_decode(E.golomb_encode(dense, 0)) == dense).all()


@pytest.mark.parametrize("bits", [3, 9, 60])
def test_blocks_tell_owners_all_fingerprints(bits):
    """Few bits: many texts share a fingerprint. Every row finds its own bit in its owner's bitmap."""
    import xxhash

    rows = {b"text %d" % i: [i] * (1 + i % 2) for i in range(300)}
    for owners in (1, 5, 700):
        block = E._block(rows, 7, owners, bits).to_pylist()
        span = (1 << bits) // owners + 1
        told = {}
        for r in block:
            if r["coded"]:
                n = int.from_bytes(r["coded"][:4], "little")
                told[r["owner"]] = E.golomb_decode(r["coded"][4 : 4 + n]) + np.uint64(r["owner"] * span)
        for r in block:
            assert int(told[r["owner"]][r["rank"]]) == xxhash.xxh64_intdigest(r["body"]) >> (64 - bits)
        assert sorted(r["body"] for r in block) == sorted(rows)


def test_exact_dedup(docs, rows):
    for block_bytes in (50, 1 << 25):
        got = {tuple(r) for r in E.exact_dedup(docs, owner_rows=10, block_bytes=block_bytes).collect()}
        assert got == brute_exact(rows)


def test_exact_dedup_sf(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {tuple(r) for r in E.op2_exact_dedup(spark, SF).collect()} == brute_exact([(r.doc_id, r.text) for r in docs.collect()])


def test_exact_dedup_odd(odd, empty):
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(odd).collect())
    assert got == sorted([("None", 7, 5, False)] * 2 + [("5", 7, 5, False)] * 2 + [("6", 6, 1, True), ("7", 7, 5, True)])
    assert E.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("cell_rows", [3, 8192])
def test_simhash(docs, rows, cell_rows):
    prints = {i: brute_print(t) for i, t, *_ in rows}
    roots = brute_components(prints)
    for hot_share in (0.001, 0.4):
        got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.near_dedup(docs, cell_rows=cell_rows, hot_share=hot_share).collect()}
        assert got == {i: (prints[i], roots[i]) for i in prints}


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in S.components(edges).collect()} == {(i, 0) for i in range(1, 301)}
    assert S.components(edges.limit(0)).count() == 0


def test_simhash_sf(spark):
    docs = {r.doc_id: brute_print(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    roots = brute_components(docs)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.op10_simhash(spark, SF).collect()}
    assert got == {i: (docs[i], roots[i]) for i in docs}


@pytest.mark.parametrize("cell_rows", [40, 8192])
def test_links_of_dense_clusters(spark, cell_rows):
    """Balls of near fingerprints, chains and strangers; cells above and below the chunk limit."""
    r = np.random.default_rng(3)
    points = set(map(int, r.integers(0, 1 << 63, 400)))
    for centre in list(points)[:3]:
        for _ in range(150):
            x = centre
            for b in r.integers(0, 63, r.integers(1, 6)):
                x ^= 1 << int(b)
            points.add(x)
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    roots = {x.node: x.root for x in S.components(S.links(df, cell_rows=cell_rows)).collect()}
    want = brute_components({p: p for p in points})
    assert {p: roots.get(p, p) for p in points} == want


def test_embedding_is_a_lower_bound():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 63, 10000, dtype=np.uint64) for _ in range(2))
    assert (np.bitwise_count(S.embed(a) ^ S.embed(b)) <= np.bitwise_count(a ^ b)).all()


def test_simhash_odd(odd, empty):
    got = sorted((str(r.doc_id), r.component_id) for r in S.near_dedup(odd).collect())
    assert got == sorted([("None", 5), ("None", 5), ("5", 5), ("5", 5), ("6", 6), ("7", 5)])
    assert S.near_dedup(empty).count() == 0
