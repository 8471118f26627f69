"""Near copies against all pairs, and the pipeline's stages on the small tables."""

import numpy as np

import corpus_pipeline
from fathomgrid.llm.decontaminate import drop_contaminated
from fathomgrid.llm.line_dedup import dedup_lines
from fathomgrid.llm.near_dedup import _blocked, _Tree, drop_near_duplicates, near_duplicates
from fathomgrid.llm.packing import pack
from fathomgrid.llm.toxicity import drop_toxic
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import brute as deduped
from tests.llm.test_simhash import brute_roots


def grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(docs):
    sets = {i: grams(t) for i, t in docs}
    ids = sorted(sets)
    alike = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)
    near = lambda a, b: (not a and not b) or (a and b and alike(a, b))
    return brute_roots([(a, b) for n, a in enumerate(ids) for b in ids[:n] if near(sets[a], sets[b])], ids)


def made(seed=3):
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % rng.integers(0, 3000)
    docs, base = [], [[word() for _ in range(rng.integers(60, 400))] for _ in range(40)]
    for w in base:
        docs.append(" ".join(w))
        for share in (0.004, 0.01, 0.018, 0.03, 0.1):
            docs.append(" ".join(word() if rng.random() < share else x for x in w))
        cut = int(len(w) * 0.9)
        docs += [" ".join(w[:cut]), " ".join(w[: len(w) // 2])]
    return [(i, docs[j]) for i, j in enumerate(rng.permutation(len(docs)))]


def test_near_copies(spark):
    docs = [*made(), (900, ""), (901, None), (902, " \n "), (903, "one two"), (904, "ONE  two"), (905, "z " * 50_000), (906, "z " * 50_001)]
    want = groups(docs)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, node string, size int")
    gone = {r.owner: r.kept_owner for r in near_duplicates(df, leaf=16).collect()}
    due = {i for i, r in want.items() if i != r}
    assert set(gone) <= due
    assert len(gone) >= 0.97 * len(due)
    assert {902, 901, 904, 906} <= set(gone)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(docs) - len(gone)


def test_recall_on_the_table(spark):
    """All pairs of a whole table: no document goes without a near copy, and no copy stays."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = groups([(r.doc_id, r.text) for r in df.collect()])
    due = {i for i, r in want.items() if i != r}
    gone = {r.owner for r in near_duplicates(df).collect()}
    assert len(due) > 50 and gone <= due and len(gone) >= 0.99 * len(due), (len(gone), len(due))


def starred(copies, seed=5):
    """One original and copies that are near it, but not near each other."""
    rng = np.random.default_rng(seed)
    words = ["w%d" % x for x in rng.integers(0, 3000, 300)]
    docs = [(0, " ".join(words))]
    for i in range(1, copies + 1):
        w = list(words)
        for n, at in enumerate(rng.choice(58, 5, replace=False)):
            w[5 + 5 * at] = f"e{i}x{n}"
        docs.append((i, " ".join(w)))
    return docs


def test_an_original_keeps_all_its_copies(spark):
    docs = starred(600)
    sets = [grams(t) for _, t in docs]
    assert all(len(sets[0] & s) >= 0.8 * len(sets[0] | s) for s in sets)
    siblings = [len(a & b) / len(a | b) for n, a in enumerate(sets[1:60]) for b in sets[1 : n + 1]]
    assert np.median(siblings) < 0.75
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for options in ({}, {"leaf": 16, "block": 100, "shingles": 20_000}):
        assert [r.doc_id for r in drop_near_duplicates(df, **options).collect()] == [0], options


def test_large_shards_are_split_into_block_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(1, 0, int(s), True, i, 100, rng.integers(0, 256, 24, dtype=np.uint8).tobytes()) for i, s in enumerate([0] * 1000 + [1] * 5)]
    df = spark.createDataFrame(rows, "band int, part int, shard int, home boolean, node long, size int, sig binary")
    tasks = {}
    for r in _blocked(df, 100).collect():
        tasks.setdefault((r.shard, r.i, r.j), set()).add(r.node)
    assert tasks.pop((1, 0, 0)) == set(range(1000, 1005))
    assert len(tasks) == 55 and max(map(len, tasks.values())) < 350
    met = np.eye(1000, dtype=bool)
    for nodes in tasks.values():
        met[np.ix_(list(nodes), list(nodes))] = True
    assert met.all()


def test_null_ids_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "quite another text")], "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_duplicates(df).collect()) == [5, 6]
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_forest_connects_what_is_linked():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 900, 2000), rng.integers(0, 900, 2000)
    tree = _Tree(900)
    taken = tree.offer(a, b)
    want = brute_roots(zip(a.tolist(), b.tolist(), strict=True), range(900))
    assert taken.sum() == 900 - len(set(want.values()))
    got = brute_roots(zip(a[taken].tolist(), b[taken].tolist(), strict=True), range(900))
    assert got == want


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    by = dict(corpus_pipeline.STAGES)
    toxic = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").filter("toxic = 1").collect()}

    clean = by["toxicity"](spark, docs, d)
    assert clean.columns == docs.columns
    gone = text(docs).keys() - text(clean).keys()
    assert gone and len(gone & toxic) >= 0.5 * len(toxic)

    lines = by["line_dedup"](spark, clean, d)
    assert lines.columns == docs.columns
    assert text(lines) == deduped(list(text(clean).items()), 1, 2)

    single = by["simhash_near_dedup"](spark, lines, d)
    want = groups(list(text(lines).items()))
    assert {i for i, r in want.items() if i == r} <= text(single).keys()

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    safe = by["decontamination"](spark, single, d)
    assert safe.columns == docs.columns
    assert text(safe).keys() == {r[0] for r in contaminated(list(text(single).items()), items) if not r[5]}

    packed = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == text(safe).keys()


def test_clashing_and_odd_columns(spark):
    names = ["_owner", "_hash", "_text", "_drop", "_kept", "_key", "near", "line", "node", "size", "a.b", "fp", "term", "item", "n", "score", "bucket", "shard"]
    df = spark.createDataFrame([(i, f"document number {i} has some words of its own {i * i}", *range(len(names))) for i in range(4)], ["doc_id", "text", *names])
    empty = spark.createDataFrame([], "item_id long, text string, doc_id long, toxic int")
    for out in (drop_near_duplicates(df), dedup_lines(df), drop_contaminated(df, empty), drop_toxic(df, empty)):
        assert out.columns == df.columns
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert pack(df).count() == 4


def test_stages_take_nulls_repeats_and_nothing(spark):
    d = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, None, "en", "s", 0), (2, "", None, "s", 0), (3, "one plain text of a few words", "en", None, 5), (3, "one plain text of a few words", "en", None, 5), (None, "another plain text that stands alone here", "en", "s", None), (4, "w " * 50_000, "en", "s", 1)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
            kept = docs.collect()
            assert len(kept) == (0 if not some else 4 if name in ("simhash_near_dedup", "decontamination") else 7), name
            docs = spark.createDataFrame(kept, schema)
        assert corpus_pipeline.packing(spark, docs, d).count() >= len(kept)
