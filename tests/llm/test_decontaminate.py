"""The inverted index against a scan of every window."""

import hashlib
import re

from fathomgrid.llm.decontaminate import decontaminate, find_items


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, names = words(text), set(), set()
        for name, body in items:
            v = words(body)
            if name is None or not v:
                continue
            n = min(10, len(v))
            grams = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    names.add(str(name))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, term int, item int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return decontaminate(d, b, **options)


def cases():
    item = " ".join(f"Wort{i} the" for i in range(12))
    repeated = "a a a a b a a a a a a a a a"
    items = [(3, item), (20, "the quick brown"), (20, "lazy dog"), (None, "lost words here"), (5, None), (6, " ,. "), (7, repeated), (8, "é ü ß " * 5)]
    docs = [
        (1, "x " + item + " y"), (2, item[:40]), (3, None), (4, ""), (5, "The QUICK, brown; fox lazy-dog"), (6, repeated + " " + repeated), (7, "a " * 500), (8, "É ü ß é ü ß é ü ß é ü ß é"),
        (9, " ".join(item.split()[4:16]) + " gap " + " ".join(item.split()[8:19])), (9, "dup id the quick brown"), (None, "the quick brown"), (None, "the quick brown"), (10, "lost words here"), (11, "z " * 30_000 + item),
    ]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = cases()
    got = sorted(map(tuple, run(spark, docs, items).drop("n_near").collect()), key=str)
    assert got == brute(docs, items)
    assert got == sorted(map(tuple, run(spark, docs, items, vocabulary_words=5).drop("n_near").collect()), key=str)


def test_on_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = sorted(map(tuple, run(spark, docs, items).drop("n_near").collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[5] for r in got)


def test_near_and_empty(spark):
    docs, items = [(1, "rare1 filler filler rare2 common"), (2, "rare1 rare2"), (3, "common")], [(1, "rare1 rare2 common")]
    near = find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))[2]
    assert {r.doc_id for r in near.collect()} == {1, 2}
    assert run(spark, [], items).count() == 0
    assert {r.n_hit for r in run(spark, docs, []).collect()} == {0}
