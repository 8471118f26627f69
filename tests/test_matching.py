"""Phrases found by the automaton against trying each of them at each place."""

import random
import re

import pytest

from fathomgrid.operators.matching import find_phrases

VOCABULARY = {"v": {"one": ["ab", "abab", "B a"], "two": ["ab", "", "é"]}, "w": {"one": ["AB", "x_y"], "none": []}}


def brute(rows, whole):
    out = []
    for i, text in rows:
        low = (text or "").lower()
        for v, terms in VOCABULARY.items():
            for t, phrases in terms.items():
                for p in {p.lower() for p in phrases if p}:
                    at = [m.start() for m in re.finditer(f"(?={re.escape(p)})", low)]
                    if whole:
                        at = [a for a in at if not re.match(r"\w", low[a - 1 : a]) and not re.match(r"\w", low[a + len(p) : a + len(p) + 1])]
                    if at:
                        out.append((i, v, t, p, len(at), at[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("whole", [False, True])
def test_phrases(spark, whole):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("aAbB é_xy,", k=rng.randint(0, 60)))) for i in range(300)] + [(None, "ab ab"), (1, None), (2, ""), (3, "ab " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as id", "3 as term")
    assert sorted((tuple(r) for r in find_phrases(df, "doc_id", "text", VOCABULARY, whole).collect()), key=repr) == brute(rows, whole)
    assert find_phrases(df, "doc_id", "text", {}).count() == 0 and find_phrases(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0
