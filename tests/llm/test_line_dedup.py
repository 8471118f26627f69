"""Line dedup against a comparison of every two lines."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomgrid.llm.line_dedup import Powers, dedup_lines, halves, variants, within_one


def edit(a, b):
    """The edit distance of two word lists, or 2 where it is plainly larger than 1."""
    if abs(len(a) - len(b)) > 1 or len(set(a) ^ set(b)) > 2:
        return 2
    d = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(d[j] + 1, row[-1] + 1, d[j - 1] + (x != y)))
        d = row
    return d[-1]


def brute(docs, least, fuzzy):
    seen, out = [], {}
    for i, text in sorted(docs, key=lambda r: r[0]):
        kept = []
        for line in (text or "").split("\n"):
            w = "".join(c.lower() if c.isascii() else c for c in line).split(" ")
            w = [x for x in w if x]
            again = len(w) >= least and any(v == w or (min(len(w), len(v)) >= fuzzy and edit(v, w) <= 1) for v in seen)
            if len(w) >= least:
                seen.append(w)
            if not again:
                kept.append(line)
        out[i] = None if text is None else "\n".join(kept)
    return out


words = st.lists(st.sampled_from("abc"), min_size=1, max_size=9)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_near_lines_share_a_half_and_a_variant(a, b):
    p, x, y = Powers(), [w.encode() for w in a], [w.encode() for w in b]
    near = edit(a, b) <= 1
    assert within_one(a, b) == near
    (ka, ga), (kb, gb) = variants(x, p), variants(y, p)
    whole = ka[0] in kb[1:].tolist() or kb[0] in ka[1:].tolist()
    meet = a == b or whole or bool(set(zip(ka[1:].tolist(), ga[1:].tolist(), strict=True)) & set(zip(kb[1:].tolist(), gb[1:].tolist(), strict=True)))
    assert meet == near
    if near and min(len(a), len(b)) >= 2:
        assert set(halves(x)) & set(halves(y))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[vocabulary[j] for j in rng.integers(0, 40, rng.integers(1, 14))] for _ in range(60)]
    docs = []
    for i in range(70):
        lines = []
        for _ in range(rng.integers(1, 7)):
            w = list(base[rng.integers(0, 60)])
            how = rng.integers(0, 5)
            at = rng.integers(0, len(w))
            if how == 1:
                w[at] = f"n{rng.integers(0, 300)}"
            elif how == 2:
                w.pop(at)
            elif how == 3:
                w.insert(at, f"n{rng.integers(0, 300)}")
            lines.append("  ".join(w).upper() if how == 4 else " ".join(w))
        docs.append((i, "\n".join(lines)))
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, "k " * 200), (504, "k " * 201), (505, "ü ß é ñ ö ä ç è one"), (506, "ü ß é ñ ö ä ç è two"), (507, "Ü ß é ñ ö ä ç è one")]
    docs += [(508, "one\none\ntwo"), (509, "red sun"), (510, "red moon\nblue sky now"), (511, "blue now\nONE")]
    df = spark.createDataFrame([(i, t, "x", 1, 7) for i, t in docs], "doc_id long, text string, line string, near int, n_lines int")
    plain = {r.doc_id: r for r in dedup_lines(df).collect()}
    got = {r.doc_id: r for r in dedup_lines(df, counts=True).collect()}
    want = brute(docs, 1, 2)
    assert {i: r.text for i, r in plain.items()} == want and list(plain[0].asDict()) == df.columns
    assert {i: r.text for i, r in got.items()} == want
    assert plain[0].line == "x" and plain[0].near == 1 and plain[0].n_lines == 7
    assert all(r.n_lines - r.n_dropped == (len(r.text.split("\n")) if r.text else 0) for r in got.values() if r.text)
    assert sum(r.n_near for r in got.values()) > 10
    assert (got[508].text, got[510].text, got[511].text) == ("one\ntwo", "blue sky now", "")


def test_null_ids_repeats_and_no_rows(spark):
    line = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(None, line), (2, line), (2, line), (1, line.replace("five", "5") + "\nshort one\n\nshort one\n"), (2, "other words here\nother words here")], "doc_id long, text string")
    got = sorted(((r.doc_id or 99), r.text) for r in dedup_lines(df).collect())
    assert got == [(1, line.replace("five", "5") + "\nshort one\n\n"), (2, ""), (2, ""), (2, "other words here"), (99, "")]
    assert dedup_lines(df.limit(0)).count() == 0


def test_very_long_lines(spark):
    df = spark.createDataFrame([(1, "k " * 60_000), (2, "k " * 60_001), (3, "k " * 60_003), (4, "\n".join(f"line {i % 900} of many" for i in range(3000)))], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(df, counts=True).collect()}
    assert (got[2].text, got[2].n_near, got[3].n_dropped) == ("", 1, 0)
    assert (got[4].text, got[4].n_dropped) == ("line 0 of many", 2999)
