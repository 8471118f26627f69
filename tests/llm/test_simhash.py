"""Fingerprints, the tree's links and the components against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomgrid.llm import vptree
from fathomgrid.llm.components import connected_components
from fathomgrid.llm.simhash import simhash_components


def brute_fp(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) / 2)


def brute_roots(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(1000 + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "two words", "a b c", "a b c d " * 5000, " x　y z", docs[0][1], docs[0][1].upper()])]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, fp string, root int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(df, leaf=16).collect()}
    fps = {i: brute_fp(t) for i, t in docs}
    ids = sorted(fps)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (fps[a] ^ fps[b]).bit_count() <= 2]
    root = brute_roots(pairs, ids)
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in ids}


def test_null_ids_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "quite another text")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in simhash_components(df).collect() if r.component_id) == [(-1, 4), (4, 4), (4, 4)]
    assert simhash_components(df).count() == 4 and simhash_components(df.limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 4), st.integers(0, 5))
def test_no_pair_is_lost(seed, radius, depth):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 12), dtype=np.uint64)
    values = np.unique(np.concatenate([base, np.bitwise_xor.accumulate(flips, axis=1).ravel() ^ np.repeat(base, 12)]))
    tree = vptree.build(values[::3], depth, radius)
    rows, shard = vptree.route(values, tree, radius)
    together = {(s, r) for s, r in zip(shard.tolist(), rows.tolist(), strict=True)}
    of = {}
    for s, r in together:
        of.setdefault(r, set()).add(s)
    a, b = np.nonzero(vptree.distance(values[:, None], values[None]) <= radius)
    assert all(of[x] & of[y] for x, y in zip(a.tolist(), b.tolist(), strict=True))
    want = brute_roots(zip(a.tolist(), b.tolist(), strict=True), range(len(values)))
    assert vptree.components_of(values, radius).tolist() == [want[i] for i in range(len(values))]


def test_blocks_of_a_large_shard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    values = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64))]))
    label = vptree.components_of(values, 2)
    a, b = np.nonzero(vptree.distance(values[:, None], values[None]) <= 2)
    want = brute_roots(zip(a.tolist(), b.tolist(), strict=True), range(len(values)))
    assert label.tolist() == [want[i] for i in range(len(values))]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 3), (3, 5), (9, 8), (8, 3), (20, 21)]])
def test_connected_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges for n in e}
    want = {n: r for n, r in brute_roots(edges, nodes).items() if n != r}
    assert got == want


def test_a_crowd_about_one_value_is_split(spark):
    """Half of the fingerprints lie within five flips of one value: groups stay bounded, components equal brute force."""
    rng = np.random.default_rng(6)
    centre = np.uint64(rng.integers(0, 1 << 63))
    crowd = np.array([np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)] + [centre]) for _ in range(1500)], np.uint64)
    fps = np.unique(np.concatenate([crowd, rng.integers(0, 1 << 63, 1500).astype(np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    sizes = vptree.paired(vptree.shards(df, 2, leaf=256), 200).groupBy("shard", "i", "j").count().collect()
    assert max(r["count"] for r in sizes) <= 2 * 200 * 1.4 and len({r.shard for r in sizes if r.j}) >= 1
    label = vptree.components_of(fps, 2)
    a, b = np.nonzero(vptree.distance(fps[:, None], fps[None]) <= 2)
    whole = vptree.Forest(len(fps))
    whole.join(a, b)
    assert (label == whole.label).all()
    edges = vptree.links(df, 2, block=200, leaf=256).collect()
    at = {int(v): i for i, v in enumerate(fps.view(np.int64))}
    got = vptree.Forest(len(fps))
    got.join(np.array([at[r.u] for r in edges]), np.array([at[r.v] for r in edges]))
    assert (got.label == whole.label).all()
