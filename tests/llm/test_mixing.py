"""Budgets against every subset, and the mix's rules on tables."""

import itertools
import re
from collections import defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from fathomgrid.llm.mixing import fit, mix_sources, targets


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 4), min_size=1, max_size=5), st.floats(0, 0.999))
def test_fit_finds_the_nearest_sum(histogram, part):
    lengths, counts = list(histogram), list(histogram.values())
    total = sum(n * c for n, c in histogram.items())
    rest = int(total * part)
    got = fit(lengths, counts, rest)
    assert all(0 <= g <= c for g, c in zip(got, counts, strict=True))
    sums = {sum(n * k for n, k in zip(lengths, ks, strict=True)) for ks in itertools.product(*(range(c + 1) for c in counts))}
    assert abs(sum(n * g for n, g in zip(lengths, got, strict=True)) - rest) == min(abs(s - rest) for s in sums)


def test_fit_of_many_lengths_keeps_their_shares():
    lengths, counts = list(range(1, 3000)), [3000 - n for n in range(1, 3000)]
    rest = sum(n * c for n, c in zip(lengths, counts, strict=True)) * 2 // 5 + 7
    got = fit(lengths, counts, rest)
    assert sum(n * g for n, g in zip(lengths, got, strict=True)) == rest
    assert all(0 <= g <= c for g, c in zip(got, counts, strict=True))
    assert all(g >= c * 2 // 5 - 1 for g, c in zip(got, counts, strict=True))


def reshared(sizes, weights, total, most):
    """The rule as it is worded: share by weight, cut, share the excess again."""
    out, free, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(total)
    while free and left:
        weight = sum(weights[i] for i in free)
        for i in free:
            out[i] += left * weights[i] / weight
        over = {i for i in free if out[i] > most * sizes[i]}
        left = sum((out[i] - most * sizes[i] for i in over), Fraction(0))
        for i in over:
            out[i] = Fraction(most * sizes[i])
        free -= over
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8))
def test_targets_reshare_the_excess(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total = Fraction(3 * sum(sizes), 2)
    assert targets(sizes, weights, total, 2) == reshared(sizes, weights, total, 2)


def words(text):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])


def nearest(sizes, want):
    """The least distance from ``want`` of the words of a subset, the documents being taken whole as often as fits."""
    whole, goal = sum(sizes), int(want + Fraction(1, 2))
    rest, sums = goal % whole if whole else 0, 1
    for n in sizes:
        sums |= sums << n
    return min(abs(i - rest) for i in range(whole + 1) if sums >> i & 1)


def check(docs, rows):
    """``docs`` are (id, text, source) rows without repeats of an id."""
    size, source = {d[0]: words(d[1]) for d in docs}, {d[0]: d[2] for d in docs}
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[2]] += size[d[0]]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, reshared([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], Fraction(3 * sum(sizes.values()), 2), 2), strict=True))
    taken = defaultdict(int)
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and abs(r.target - float(want[s])) <= 1e-9 * max(1, r.target)
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - int(want[s] + Fraction(1, 2))) == nearest([size[d] for d in size if source[d] == s], want[s])


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given_ = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    first = mix_sources(docs).collect()
    check(given_, first)
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(first) == sorted(again)
    assert sorted(mix_sources(docs, shard_rows=10, weights=(1,)).collect()) == sorted(mix_sources(docs.repartition(3), shard_rows=10, weights=(1,)).collect())


def test_shards_take_the_smallest_hashes(spark):
    """One length holds nearly all rows; how it is sharded doesn't change how many are taken."""
    docs = [(i, "a b c", "big") for i in range(500)] + [(1000 + i, "x " * i, "other") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    one = mix_sources(df, weights=(1, 1)).collect()
    many = mix_sources(df, weights=(1, 1), shard_rows=7).collect()
    assert sorted(one) == sorted(many)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "a b", None), (1, "", "s"), (1, "x y z", "s"), (1, "x y z", "s"), (2, "w " * 70_000, ""), (3, "q " * 900, "s"), (4, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as n", "'h' as hash", "true as named")
    got = mix_sources(df).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == 70_000 + 900 + 8
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.source_size for r in got if r.doc_id is None} == {2}
    assert [(r.size, r.target, r.taken) for r in got if r.doc_id == 4] == [(0, 0.0, 0)]
    assert mix_sources(df.limit(0)).count() == 0
    assert mix_sources(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()[0].taken == 0
