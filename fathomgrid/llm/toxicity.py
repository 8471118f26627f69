"""Toxicity by weak supervision.

Many voters look at a text: words of fixed lexicons, writing patterns, and words or
word beginnings of the labelled texts, of which those are chosen that stand in toxic
ones far more often. A generative label model explains the voters' firing by a hidden
class: it estimates each voter's accuracy and, in a tree of the strongest pairs, how
voters depend on each other within a class. Apart from the choice of voters and the
share of the toxic class it never sees a label. A linear classifier is then trained on
the model's posterior labels, and scores texts.

The fit uses at most ``per_class`` labelled rows of either class and ``chosen`` chosen
voters, both parameters; counting words runs on Spark. Scoring is one narrow pass over
whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WORDS = re.compile(r"[^\W\d_]+")

#: Insults, threats and abuse by theme.
LEXICONS = {
    "insult": "idiot moron stupid imbecile dumb fool clown loser pathetic worthless dimwit halfwit",
    "contempt": "disgusting scum trash vermin filth garbage parasite subhuman",
    "threat": "kill murder hang shoot stab burn beat",
    "abuse": "bastard bitch whore slut damn crap shit fuck fucking asshole",
}
#: Texts in which these are found get a toxic vote, or a clean one where the name says so.
PATTERNS = {
    "you_are": re.compile(r"\byou(?:'re| are)\s+(?:a|an|so|such)\s+\w+", re.I),
    "go_away": re.compile(r"\b(?:shut up|get lost|go away|drop dead)\b", re.I),
    "exclaim": re.compile(r"[!?]{3,}"),
    "masked": re.compile(r"\b[a-z]+[*@#$]{2,}[a-z]*\b", re.I),
    "clean_link": re.compile(r"https?://"),
    "clean_quote": re.compile(r"[\"“][^\"”]{40,}[\"”]"),
}
#: A pattern is looked for only in lower-cased texts that hold one of these.
HINTS = {"you_are": ("you",), "go_away": ("shut", "lost", "away", "dead"), "exclaim": ("!", "?"), "masked": ("*", "@", "#", "$"), "clean_link": ("http",), "clean_quote": ('"', "“")}
_BEGINNINGS = (4, 5, 6, 7, 8)
_OFTEN = (2, 4)  # a beginning that ordinary words share may still mark a text that is full of it


def _beginnings(words: set[str]) -> Counter:
    """How many distinct words have each beginning."""
    return Counter(w[:k] for w in words for k in _BEGINNINGS if len(w) >= k)


def features(text: str | None) -> set[str]:
    """The distinct lower-case words; beginnings as ``^abcd``, and as ``^abcd*2`` if two words or more share it."""
    words = set(WORDS.findall(text.lower())) if text else set()
    found = _beginnings(words)
    return words.union("^" + b for b in found).union(f"^{b}*{n}" for b, times in found.items() for n in _OFTEN if times >= n)


@dataclass
class Model:
    """Voters by name, and the classifier's weights."""

    words: dict[str, int]  # a word and the number of its voter
    stems: dict[str, list[tuple[int, int]]]  # a beginning: how many words must share it, and the voter
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.heads = {stem[: _BEGINNINGS[0]] for stem in self.stems}

    def votes(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(self.weights), np.int8)
        if text:
            low = text.lower()
            words = set(WORDS.findall(low))
            for w in words & self.words.keys():
                out[self.words[w]] = 1
            stems, heads = self.stems, self.heads
            begun = [w for w in words if w[: _BEGINNINGS[0]] in heads]
            for stem, times in Counter(w[:k] for w in begun for k in _BEGINNINGS if len(w) >= k and w[:k] in stems).items():
                for least, i in stems[stem]:
                    if times >= least:
                        out[i] = 1
            for i, (name, pattern) in enumerate(PATTERNS.items()):
                if any(hint in low for hint in HINTS[name]) and pattern.search(text):
                    out[i] = -1 if name.startswith("clean") else 1
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.votes(text) @ self.weights, -40, 40))))


def _blank(chosen: list[str]) -> Model:
    """All voters, without weights."""
    words, stems = {w: 0 for group in LEXICONS.values() for w in group.split()}, {}
    for f in chosen:
        if f[0] != "^":
            words[f] = 0
    at = len(PATTERNS)
    for w in words:
        words[w], at = at, at + 1
    for f in chosen:
        if f[0] == "^":
            stem, _, least = f[1:].partition("*")
            stems.setdefault(stem, []).append((int(least or 1), at))
            at += 1
    return Model(words, stems, np.zeros(at), 0.0)


def _dependence(hot: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mutual information of every two voters among the rows of one class, times their weight."""
    n, total = max(weight.sum(), 1e-9), np.zeros((hot.shape[2],) * 2)
    share = [(weight @ h + 1e-3) / (n + 3e-3) for h in hot]
    for a in range(3):
        weighted = hot[a].T * weight
        for b in range(3):
            both = (weighted @ hot[b] + 1e-6) / n
            total += both * np.log(both / np.outer(share[a], share[b]))
    return n * total


def _forest(gain: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent in a maximum spanning forest of gains of ``least`` or more; -1 for a root."""
    m = len(gain)
    parent, best, near, done = np.full(m, -1), np.full(m, -1.0), np.full(m, -1), np.zeros(m, bool)
    for _ in range(m):
        j = int(np.where(done, -np.inf, best).argmax())
        done[j] = True
        if best[j] >= least:
            parent[j] = near[j]
        closer = (gain[j] > best) & ~done
        best[closer], near[closer] = gain[j][closer], j
    return parent


def _table(hot: np.ndarray, weight: np.ndarray, parent: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(vote | parent's vote) in one class, of shape (voters, parent's vote, vote); alike for all parent's votes of a root."""
    alone = np.stack([weight @ h for h in hot], 1) + prior
    alone /= alone.sum(1, keepdims=True)
    out = np.repeat(alone[:, None, :], 3, 1)
    child = np.flatnonzero(parent >= 0)
    for b in range(3):
        weighted = hot[b][:, parent[child]] * weight[:, None]
        counts = np.stack([(weighted * h[:, child]).sum(0) for h in hot], 1)
        out[child, b] = (counts + alone[child] * prior.sum()) / (counts.sum(1, keepdims=True) + prior.sum())
    return out


def label_model(votes: np.ndarray, times: np.ndarray, share: float = 0.1, rounds: int = 40, strength: float = 5.0, least: float = 100.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class, each voter's parent, and log P(vote | parent's vote, class) of shape (2, voters, 3, 3).

    ``votes`` holds -1, 0 or 1, each row standing for ``times`` texts. Expectation
    maximisation over a hidden class of which ``share`` is toxic. Within a class a voter
    depends on its parent in a forest of the pairs whose mutual information within the
    classes, times the texts, is ``least`` or more; at first only of pairs that fire on
    the same texts by a Jaccard similarity of 0.8, then, as the posterior settles and
    what the class explains is known, of all. At first a voter is expected to fire in one toxic text of twenty
    and in one clean text of six hundred, which weighs ``strength`` times four texts.
    """
    hot, at = np.stack([votes == x for x in (-1, 0, 1)]).astype(float), votes.astype(int) + 1
    n, m = votes.shape
    prior = np.array([[0.02, 5.97, 0.01], [0.01, 3.79, 0.2]]) * strength
    parent = np.full(m, -1)
    log = np.log(np.stack([np.broadcast_to(p / p.sum(), (m, 3, 3)) for p in prior]))
    every = np.arange(m)[None, :]
    both = (hot[2].T * times) @ hot[2]
    echo = both / np.maximum(np.diag(both)[:, None] + np.diag(both) - both, 1)
    for turn in range(rounds + 1):
        above = np.where(parent >= 0, at[:, parent], 0)
        gap = np.log(share / (1 - share)) + (log[1] - log[0])[every, above, at].sum(1)
        post = 1 / (1 + np.exp(-np.clip(gap, -40, 40)))
        if turn == rounds:
            break
        weights = ((1 - post) * times, post * times)
        if turn in (0, 3, 10, 20):
            gain = sum(_dependence(hot, w) for w in weights)
            parent = _forest(gain if turn else np.where(echo >= 0.8, gain, 0), least)
        log = np.log(np.stack([_table(hot, w, parent, p) for w, p in zip(weights, prior, strict=True)]))
    return post, parent, log


def _linear(x: np.ndarray, times: np.ndarray, target: np.ndarray, centre: np.ndarray, ridge: float = 0.02, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; weights shrink to ``centre``, the bias doesn't."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    shrink, centre = np.append(np.full(x.shape[1] - 1, ridge), 1e-3), np.append(centre, 0.0)
    w = centre.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(shrink), x.T @ (times * (target - p)) - shrink * (w - centre))
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from training; null ids aren't."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """``text, toxic`` of training rows; ids are picked by hash where a class has too many."""
    given = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    sizes = {r.toxic: r.n for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = lambda c: min(1.0, per_class / max(sizes.get(c, 0), 1))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    picked = given.filter(F.when(F.col("toxic") == 1, unit < part(1)).otherwise(unit < part(0)))
    picked = F.broadcast(picked.withColumnRenamed("doc_id", "labelled"))  # about 2 * per_class rows at most
    return docs.join(picked, docs["doc_id"] == picked["labelled"]).select("text", F.col("toxic").cast("int").alias("toxic"))


def _choose(sample: DataFrame, n_toxic: int, n_clean: int, chosen: int, purity: float) -> list[str]:
    """The ``chosen`` words and beginnings that best tell toxic training rows from clean ones, by a log-odds of ``purity`` or more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(features(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    def total(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(counted, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    toxic = total(sample.filter("toxic = 1")).filter(F.col("n") >= max(3, 0.01 * n_toxic)).withColumnRenamed("n", "t")
    clean = total(sample.filter("toxic <> 1")).withColumnsRenamed({"feature": "other", "n": "c"})
    both = toxic.join(clean, F.col("feature") == F.col("other"), "left").select("feature", "t", F.coalesce("c", F.lit(0)).alias("c"))
    odds = F.log((F.col("t") + 0.1) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    strong = both.filter(odds >= purity).orderBy((F.col("t") * odds).desc(), F.length("feature"), "feature").limit(5 * chosen)
    seen, kept = set(), []
    for r in strong.collect():
        alike = (r.feature[: 1 + _BEGINNINGS[0]].strip("^")[: _BEGINNINGS[0]], r.t, r.c)  # the same texts, by a longer beginning
        if alike not in seen:
            seen.add(alike)
            kept.append(r.feature)
    return kept[:chosen]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 10_000, chosen: int = 300, purity: float = 3.5) -> Model:
    """Train on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, without held-out ids.

    Labels choose voters and give the toxic share; the classifier's targets are the label
    model's posteriors. Without labels of both classes the fixed voters alone make the
    model.
    """
    sample = materialise(_sample(docs, labels, per_class))
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0)
    blank = _blank(_choose(sample, n_toxic, n_clean, chosen, purity) if n_toxic and n_clean else [])
    size = len(blank.weights)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([blank.votes(t).tobytes() for t in batch.column(0).to_pylist()], pa.binary())], names=["votes"])

    if n_toxic and n_clean:
        rows = sample.select("text").mapInArrow(voted, "votes binary").groupBy("votes").agg(F.count("*").alias("times")).orderBy("votes").toPandas()  # bounded by per_class
        votes, times, share = np.frombuffer(b"".join(rows.votes), np.int8).reshape(-1, size), rows.times.to_numpy(float), n_toxic / (n_toxic + n_clean)
    else:  # a made-up row for each voter, and ten times as many without votes
        votes = np.concatenate([np.eye(size, dtype=np.int8), np.zeros((1, size), np.int8)])
        times, share = np.append(np.ones(size), 10.0 * size), 0.1
    post = label_model(votes, times, share)[0]
    fired = lambda w: (w * times) @ (votes == 1)
    trust = np.log((fired(post) + 0.5) / (post @ times + 1)) - np.log((fired(1 - post) + 0.5) / ((1 - post) @ times + 1))
    blank.weights, blank.bias = _linear(votes, times, post, np.clip(trust, 0, 4))
    return blank


def toxicity_score(model: Model) -> Column:
    """A column function's factory: ``toxicity_score(model)(text)`` is the score."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return scored


def score_toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= ``cut``).

    Null and empty texts get the score of a text without votes. Null ids are never
    used for training. Labels that are null are ignored; of several for an id the
    largest counts. No documents give no rows, no labels the fixed voters' model. Other
    columns of either table are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    score = toxicity_score(fit(docs, labels.select("doc_id", "toxic"), **options))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.select("*", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more; columns stay as they are."""
    score = toxicity_score(fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels.select("doc_id", "toxic"), **options))
    return docs.filter(score(F.col(text_col)) < cut)
