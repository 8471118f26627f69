"""Stupid backoff against plain counting."""

import math
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fathomgrid.llm.lm_score import _send, backoff_scores, pack_counts, pack_grams, unpack_counts, unpack_grams
from fathomgrid.llm.queries import op9_lm_score, oracle_sql


def brute(texts, order=3, alpha=0.4):
    split = [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]

    def grams(words):
        padded = ["\n"] * (order - 1) + words
        found = Counter()
        for i in range(order - 1, len(padded)):
            found.update(tuple(padded[i - k + 1 : i + 1]) for k in range(1, order + 1))
        found.update(("\n",) * k for k in range(1, order) if words)
        return found

    each = [grams(w) for w in split]
    every = Counter()
    for g in each:
        every.update(g)
    total, out = sum(map(len, split)), []
    for words, own in zip(split, each, strict=True):
        c = lambda g: every[g] - own[g]  # noqa: E731, B023
        n = max(total - len(words), 1)
        padded, score, known = ["\n"] * (order - 1) + words, 0.0, 0
        for i in range(order - 1, len(padded)):
            for k in range(order, -1, -1):
                gram = tuple(padded[i - k + 1 : i + 1])
                if k == 0:
                    score += order * math.log10(alpha) - math.log10(n)
                elif c(gram):
                    score += math.log10(c(gram) / (c(gram[:-1]) if k > 1 else n)) + (order - k) * math.log10(alpha)
                    known += k == order
                    break
        out.append((len(words), known, score))
    return out


@pytest.mark.parametrize("options", [{}, {"order": 2}, {"order": 1, "alpha": 0.5}, {"order": 4, "share": 20}, {"share": 1}])
def test_equals_counting(spark, options):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", " \n", "one", "One one ONE", "a b " * 30_000, texts[0], texts[0].upper()]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = {r.doc_id: r for r in backoff_scores(df, **options).collect()}
    assert len(got) == len(texts)
    share = {k: v for k, v in options.items() if k != "share"}
    for i, (n, known, score) in enumerate(brute(texts, **share)):
        assert (got[i].n_words, got[i].n_known) == (n, known), i
        assert got[i].log10_score == pytest.approx(score, abs=1e-6)
        assert got[i].mean_log10 == (pytest.approx(score / n) if n else None)


def test_repeated_rows_and_no_rows(spark):
    texts = ["a b c", "a b c", "a b d", "a b d", "A b d"]
    df = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (2, texts[2]), (3, texts[3]), (3, texts[4])], "doc_id long, text string")
    got = sorted((r.n_words, r.n_known, round(r.log10_score, 9)) for r in backoff_scores(df).collect())
    assert got == sorted((n, k, round(s, 9)) for n, k, s in brute(texts))
    assert backoff_scores(df.limit(0)).count() == 0


def test_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = op9_lm_score(spark, d)
    want = duck.sql(oracle_sql()["op9_lm_score"])
    assert sorted(map(tuple, got.collect())) == sorted(want.select(*got.columns).fetchall())


def test_packed_grams():
    rng = np.random.default_rng(1)
    for size in (1, 2, 1000):
        for grams in (np.unique(rng.integers(0, 2**64, size, np.uint64)), np.arange(size, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(size, dtype=np.uint64)[::-1]):
            assert (unpack_grams(pack_grams(grams), len(grams)) == grams).all()
            assert (unpack_counts(pack_counts(grams.view(np.int64)), len(grams)) == grams.view(np.int64)).all()


def test_blocks_send_packed_grams(spark):
    """Texts in several blocks; a block sends each of its n-grams once in under seven bytes, not rows of a document and an n-gram."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    got = {r.doc_id: r for r in backoff_scores(df, block_bytes=20_000).collect()}
    for i, (n, known, score) in enumerate(brute(texts + texts[:20])):
        assert (got[i].n_words, got[i].n_known) == (n, known)
        assert got[i].log10_score == pytest.approx(score, abs=1e-6)
    rows = pa.table({"doc": list(range(len(texts))), "copies": [1] * len(texts), "text": texts})
    sent = _send(3, 7)((pa.scalar(0),), rows)
    grams = np.concatenate([unpack_grams(g, n) for g, n in zip(sent["grams"].to_pylist(), sent["size"].to_pylist(), strict=True)])
    assert (grams[1:] > grams[:-1]).all()
    assert sum(map(len, sent["grams"].to_pylist())) < 7 * len(grams) + 100
