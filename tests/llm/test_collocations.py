"""Phrases against counting them all."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fathomgrid.llm import collocations as C
from fathomgrid.llm.collocations import Block, collocations, frequent_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest):
    found, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    found[lang][tuple(w[i : i + k])] += 1
    return found, total


def plain(rows, least=100, longest=5, top=2000):
    found, total = counted(rows, longest)
    out = []
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in candidates.items():
            gone |= {q for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (q := p[i:j]) != p and a >= f[q]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def made(seed, n=400):
    rng = random.Random(seed)
    words = ["The", "of", "é", "New", "york", "a-b", "x y", "São", "b"]
    said = ["new YORK city. of", "the  the the the the", "out of the\tbox", "a-b, a-b"]
    return [(" ".join(rng.choice(said) if rng.random() < 0.3 else rng.choice(words) + rng.choice(["", "", ".", "!\n", "\r"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "fr", None, "und", ""])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


def found(df, **options):
    return sorted(tuple(r) for r in collocations(df, **options).collect())


def test_made_texts(spark):
    rows = made(1)
    df = frame(spark, rows).repartition(3)
    assert found(df, least=20) == plain(rows, 20)
    assert found(df, least=3, longest=4, top=7, shard_rows=5) == plain(rows, 3, 4, 7)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.text, r.lang) for r in df.select("text", "lang").collect()]
    assert found(df, least=25) == plain(rows, 25)


def test_few_buckets_change_nothing(spark):
    """Bitmaps in which nearly all bits are set, and bounds beyond a byte."""
    rows = made(2)
    df = frame(spark, rows)
    want, _ = counted(rows, 5)
    want = sorted((x or "", " ".join(p), len(p), n) for x, f in want.items() for p, n in f.items() if len(p) == 1 or n >= 8)
    for buckets in (8, 64, 1 << 15, 1 << 16):
        assert sorted(tuple(r) for r in frequent_phrases(df.na.fill("und", ["lang"]), 8, 5, buckets).collect()) == want
    assert found(df, least=300) == plain(rows, 300)


def test_equal_hashes_are_told_apart():
    block = Block(pa.array(["a b c a b", "b c"]), pa.array(["en", "fr"]))
    first, n = block.distinct(np.array([0, 1, 3]), np.zeros(3, np.uint64), 2)
    assert sorted(zip(block.spelled(first, 2).to_pylist(), n.tolist(), strict=True)) == [("a b", 2), ("b c", 1)]
    assert block.follows.tolist() == [True, True, True, True, False, True, False]


@pytest.mark.parametrize("least", [100, 2])
def test_odd_rows(spark, least):
    rows = [(None, None), (None, "en"), ("", "en"), ("?!,\n\t ", "fr"), ("a b " * 30_000, "en"), ("A\tb.c", "en"), ("A\tb.c", "en"), ("x\x00y z\x0b" * 300, None), ("x\x00y z\x0b" * 300, "und"), ("end", "aa"), ("start end", "aa")]
    df = frame(spark, rows).selectExpr("*", "1 as n", "2 as phrase", "3 as size", "4 as hash", "5 as a", "6 as total")
    assert found(df, least=least) == plain(rows, least)
    assert collocations(df.limit(0)).count() == 0
    assert collocations(frame(spark, [("", "en"), (None, None)])).count() == 0


class Texts:
    """Stands for a table; gives the function of a task."""

    def mapInArrow(self, task, schema):
        return task


def test_what_a_task_sends_is_bounded():
    """Counts of 2**22 buckets, and a block of many phrases, go in batches; whole they are 4 MB and more."""
    rng = random.Random(3)
    texts = pa.array([" ".join(f"w{rng.randrange(300_000)}" for _ in range(300)) for _ in range(800)])
    batch = pa.record_batch([pa.array(["en"] * len(texts)), texts], names=["lang", "text"])
    sent = list(C._pass(Texts(), 1, 2, 2, 1 << 22, [])(iter([batch])))
    assert max(len(b) for b in sent) <= 32_768
    assert max(sum(len(x) for x in b.column("counts").drop_null().to_pylist()) for b in sent) == 1 << 20
    assert sum(n for b in sent for n in b.column("n").drop_null().to_pylist()) == 300 * len(texts)


def test_what_a_task_gets_is_bounded(spark):
    """Long texts come a few at a time, and the session's own bound is back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    seen = lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches)
    df = spark.range(100).selectExpr("repeat('a b ', 50000) as text").coalesce(1).mapInArrow(seen, "n long")
    with C._bounded_batches(spark):
        assert max(r.n for r in df.collect()) < 4_500_000
    assert spark.conf.get(key) == before


def test_blocks_are_of_like_size():
    rows = lambda sizes: pa.record_batch([pa.array(["x" * n for n in sizes], pa.string())], names=["text"])
    cut = lambda sizes, limit: [len(b) for b in C._blocks([rows(sizes)], limit)]
    assert cut([10] * 21, 100) == [11, 10]
    assert cut([0] * 5, 100) == [5]
    assert cut([500, 1, 1], 100) == [1, 2]
    assert cut([1, 1, 500], 100) == [3]
