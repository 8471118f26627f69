"""Boundaries against every choice of boundaries, and the batches' invariants."""

import itertools
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomgrid.llm.packing import boundaries, pack


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_boundaries_are_optimal(histogram, buckets):
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths.tolist()])
    got = boundaries(lengths, counts, buckets)
    tried = [(*c, lengths[-1]) for k in range(buckets) for c in itertools.combinations(lengths[:-1].tolist(), k)]
    assert len(got) <= buckets
    assert padding(lengths, counts, got) == min(padding(lengths, counts, t) for t in tried)


def check(rows, docs, max_len, budget):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        assert r.n_tokens <= r.bucket <= max_len and r.n_slots == max(1, budget // max(r.bucket, 1)) and 0 <= r.slot < r.n_slots
    for i, n in docs.items():
        got = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(max(1, -(-n // max_len)))) and sum(r.n_tokens for r in got) == n
        assert [r.first_token for r in got] == [r.piece * max_len for r in got]
    batches = defaultdict(list)
    for r in rows:
        batches[r.bucket, r.batch].append(r.slot)
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or len(slots) == max(1, budget // max(bucket, 1))


def test_batches_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r.text) if w]) for r in docs.collect()}
    for shard_rows in (20_000, 7):
        rows = pack(docs, max_len=256, budget=1024, buckets=5, shard_rows=shard_rows).collect()
        check(rows, want, 256, 1024)
        lengths = Counter(r.n_tokens for r in rows)
        x = np.array(sorted(lengths))
        assert sorted({r.bucket for r in rows}) == boundaries(x, np.array([lengths[i] for i in x.tolist()]), 5)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None), (None, "a b"), (1, ""), (1, ""), (2, "x " * 70_000)], "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as n")
    rows = pack(df).collect()
    assert len(rows) == 4 + -(-70_000 // 2048)
    assert sum(r.n_tokens for r in rows) == 70_002
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    assert pack(df.limit(0)).count() == 0
