"""Codes against plain Lloyd rounds in integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomgrid.llm.vector_codes import assign, cuts, vector_codes


def plain(rows, parts=16, entries=64, rounds=2):
    """(id, code, error, label_error, sha) of each row kept, by full comparison; rows are (id, vector, label)."""
    kept = [(i, [min(max(math.floor(256 * np.float64(v)), -(1 << 24)), 1 << 24) for v in x], y) for i, x, y in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    at = cuts(len(kept[0][1]), parts)
    cut = [[tuple(x[at[p] : at[p + 1]]) for p in range(parts)] for _, x, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def far(a, b):
        return sum((u - v) ** 2 for u, v in zip(a, b, strict=True))

    def nearest():
        return [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        sums = defaultdict(list)
        for c, codes in zip(cut, nearest(), strict=True):
            for p, (_, k) in enumerate(codes):
                sums[p, k].append(c[p])
        for (p, k), members in sums.items():
            books[p][k] = tuple(sum(v) // len(members) for v in zip(*members, strict=True))
    found, label = nearest(), defaultdict(int)
    for (_, _, y), codes in zip(kept, found, strict=True):
        label[y] += sum(d for d, _ in codes)
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in codes), sum(d for d, _ in codes), label[y], sha) for (i, _, y), codes in zip(kept, found, strict=True)), key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in vector_codes(df, **options).collect()), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.integers(1, 9), st.integers(1, 4), st.integers(0, 4), st.randoms(use_true_random=False))
def test_bounds_never_lose_the_nearest(n, k, size, spread, rng):
    """Small integers make many ties; bounds are those of a book that has moved."""
    draw = lambda rows: np.array([[rng.randint(-spread, spread) for _ in range(size)] for _ in range(rows)], np.int64)
    x, old = draw(n), draw(k)
    code, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
    for book in (old, old + draw(k) // 2, old + draw(k)):
        moved = np.sqrt(((book - old) ** 2).sum(1)) * (1 + 1e-6)
        upper, lower, old = upper + moved[code], np.maximum(lower - moved, 0), book
        best = assign(x, book, code, upper, lower)
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == full.argmin(1)).all() and (best == full.min(1)).all()
        assert (upper >= np.sqrt(best)).all() and (lower <= np.sqrt(full)).all()


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert got(df.repartition(3)) == plain(rows)
    assert got(df, rounds=3, entries=9, parts=5) == plain(rows, 5, 9, 3)


def test_most_entries_are_pruned():
    """Later rounds compare a small part of all entries."""
    rng = np.random.default_rng(1)
    x, book = rng.integers(-60, 60, (4000, 4)), rng.integers(-60, 60, (64, 4))
    code, upper, lower = np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros((4000, 64))
    assign(x, book, code, upper, lower)
    exact = lower.copy()
    moved = np.full(64, 0.5)
    lower = np.maximum(lower - moved, 0)
    before = lower.copy()
    assign(x, book, code, upper + moved[code], lower)
    assert (exact > 0).sum() < exact.size and (lower != before).mean() < 0.2


def test_odd_rows(spark):
    rng = random.Random(3)
    inf, nan = math.inf, math.nan
    rows = [(i, [rng.choice((-0.25, 0.0, 0.25, 1e30)) for _ in range(18)], rng.choice((None, "a", "b"))) for i in range(90)]
    rows += rows[:5] + [(None, [0.5] * 18, "a"), (None, [0.25] * 18, None), (7, None, "a"), (8, [], "a"), (9, [0.0] * 17 + [None], "a"), (10, [nan] * 18, "b"), (11, [inf] + [0.0] * 17, None), (200, [0.0] * 17, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").selectExpr("*", "1 as x", "2 as code", "3 as row", "4 as error", "5 as same")
    assert got(df) == plain(rows)
    assert vector_codes(df.limit(0)).count() == 0 and vector_codes(df.filter("size(embedding) = 0")).count() == 0
    assert got(df.filter("vec_id = 3")) == plain([r for r in rows if r[0] == 3])
