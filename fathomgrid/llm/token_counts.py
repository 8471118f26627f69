"""Token counts through a finite-state transducer compiled from a byte-pair model.

The model's pieces and merge ranks are compiled; the tokenizer library only reads them
from the file. Reading a text from left to right, the last token of every prefix is the
one piece that ends there and that the merges would leave beside the last token of the
prefix before it. What later characters can still change is bounded by the longest
piece, so a state is a node of the pieces' suffix automaton with, for each piece begun
but not ended, the token before it and the tokens emitted since. States and
transitions are made as they are met, each transition annotated with the tokens it
emits (a character that completes a longer piece may take some back), and kept in a
bounded table.

Between two characters that no piece holds side by side the transducer is back in its
start state. A text is cut there into segments, whose walks are composed once and kept.
A chunk of a long text has a *state map*: for each state in which it may be entered the
tokens emitted over it and the state in which it is left. The states of entry are those
that the characters before the chunk leave: one where a segment begins among them, else
those left when the reading begins at any of as many places as the longest piece has
characters, most of which are the same by then. State maps compose associatively: chunks of
long texts are rows of their own, mapped apart, and joined level by level, without their
texts. Should a chunk be entered in a state that its map lacks, it is mapped again with it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SPACE = "▁"

#: State of entry -> tokens emitted and state of exit, states as their keys.
StateMap = dict[str, tuple[int, str]]


class State:
    """A node of the suffix automaton; ``open`` gives for each length of a piece begun the token before it and the tokens emitted since."""

    __slots__ = ("node", "next", "open")

    def __init__(self, node: int, begun: dict[int, tuple[str | None, int]]) -> None:
        self.node, self.open, self.next = node, begun, {}

    def key(self) -> str:
        """The state as text, alike in every worker that reads the same model."""
        return json.dumps([self.node, *((n, *seen) for n, seen in self.open.items())])


START = State(0, {0: (None, 0)}).key()


def read_pieces(model: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece model and their scores; the model falls back to bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): sp.get_score(i) for i in ids}


class Transducer:
    """Transitions between states, and ``known``: segment -> tokens of its whole walk.

    ``limit`` bounds the states and the segments that are kept; beyond it they are made
    again as they are met.
    """

    def __init__(self, pieces: dict[str, float], limit: int = 200_000) -> None:
        self.pieces, self.limit, self.longest = pieces, limit, max(map(len, pieces))
        self.beside = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
        self._automaton()
        self.start = State(0, {0: (None, 0)})
        self.states: dict[tuple, State] = {}
        order = sorted(set(pieces.values()), reverse=True)
        at = {score: i for i, score in enumerate(order)}
        self.rank = {p: at[score] for p, score in pieces.items()}
        self.halves = _Halves(self)
        self.known = _Known(self)
        cut = all(a == SPACE for a, b in self.beside if b == SPACE) and not any("\n" in p for p in pieces)
        self.segments = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n+|[^{SPACE}\n]+" if cut else r"(?s:.+)").findall

    def _automaton(self) -> None:
        """Nodes of the pieces' beginnings: children, link to the longest proper suffix, lengths of pieces that end there, lengths of beginnings."""
        self.children: list[dict[str, int]] = [{}]
        depth, char, ends = [0], [""], [False]
        for piece in self.pieces:
            at = 0
            for c in piece:
                if c not in self.children[at]:
                    self.children[at][c] = len(depth)
                    self.children.append({})
                    depth.append(depth[at] + 1)
                    char.append(c)
                    ends.append(False)
                at = self.children[at][c]
            ends[at] = True
        self.char, self.link = char, [0] * len(depth)
        self.ending: list[tuple[int, ...]] = [()] * len(depth)
        self.begun: list[tuple[int, ...]] = [()] * len(depth)
        queue = [0]
        for node in queue:
            for c, child in self.children[node].items():
                queue.append(child)
                link = self.link[node]
                while link and c not in self.children[link]:
                    link = self.link[link]
                self.link[child] = link = self.children[link].get(c, 0) if node else 0
                self.ending[child] = ((depth[child],) if ends[child] else ()) + self.ending[link]
                self.begun[child] = ((depth[child],) if self.children[child] else ()) + self.begun[link]
        self.spelled = [""] * len(depth)
        for node in queue:
            for c, child in self.children[node].items():
                self.spelled[child] = self.spelled[node] + c

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The tokens of a short text of known characters: the best adjacent pair is merged, the leftmost of equals, until none is a piece or ``least`` are left."""
        parts = list(text)
        while len(parts) > least:
            score, at = max((self.pieces.get(parts[i] + parts[i + 1], -float("inf")), -i) for i in range(len(parts) - 1))
            if score == -float("inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def _fits(self, a: str, b: str) -> bool:
        """Whether the merges leave ``b`` beside ``a``.

        The merges that made the two are taken back, the latest first; they don't fit if
        the parts that then touch would have been merged earlier than that one.
        """
        if a[-1] == b[0] == SPACE:  # runs of spaces share a rank
            return self.merged(a + b) == [a, b]
        rank, halves, bound = self.rank, self.halves, float("inf")
        while True:
            if rank.get(a + b, bound) < bound:
                return False
            in_a, in_b = rank[a] if len(a) > 1 else -1, rank[b] if len(b) > 1 else -1
            if in_a == in_b == -1:
                return True
            if in_a > in_b:  # of equal merges the left one comes first
                bound, a = in_a, halves[a][1]
            else:
                bound, b = in_b + 1, halves[b][0]

    def _compile(self, state: State, c: str) -> tuple[State, int]:
        """The transition for ``c``: the next state and the tokens emitted."""
        if state.node and (self.char[state.node], c) not in self.beside:
            state = self.start
        node = state.node
        while node and c not in self.children[node]:
            node = self.link[node]
        node = self.children[node].get(c, 0)
        if not node:  # no piece holds it: a token for each byte
            return self.start, len(c.encode())
        for length in self.ending[node]:
            before, since = state.open[length - 1]
            token = self.spelled[node][-length:]
            if before is None or self._fits(before, token):
                break
        emitted = since + 1
        begun = {0: (token, 0)}
        for length in self.begun[node]:
            before, since = state.open[length - 1]
            begun[length] = (before, since - emitted)
        key = (node, *begun.items())
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= self.limit:
                self.states.clear()
                self.start.next.clear()
            found = self.states[key] = State(node, begun)
        return found, emitted

    def advance(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text and the tokens emitted over it."""
        n = 0
        for c in text:
            step = state.next.get(c)
            if step is None:
                step = state.next[c] = self._compile(state, c)
            state, emitted = step
            n += emitted
        return state, n

    def walk(self, text: str) -> int:
        """Tokens emitted from the start state over a whole text."""
        return self.advance(self.start, text)[1]

    def state(self, key: str) -> State:
        node, *begun = json.loads(key)
        return self.start if key == START else State(node, {n: (before, since) for n, before, since in begun})

    def entries(self, before: str, whole: bool) -> list[State]:
        """States that the characters ``before`` a chunk may leave; ``whole`` if they are all of them."""
        if whole:
            return [self.advance(self.start, before)[0]]
        found = self.segments(before)
        if len(found) > 1:
            return [self.advance(self.start, found[-1])[0]]
        left = (self.advance(self.start, before[i:])[0] for i in range(min(self.longest, len(before))))
        return list({s.key(): s for s in left}.values())

    def map(self, before: str, chunk: str, whole: bool, more: Iterable[str] = (), block: int = 1024) -> StateMap:
        """The state map of a chunk, with the states ``more`` among those of entry.

        States are followed a ``block`` at a time, those that have become one only once.
        """
        states = {s.key(): s for s in [*self.entries(before, whole), *map(self.state, more)]}
        found = self.segments(chunk)
        head = found[0] if len(found) > 1 else chunk
        fates = {key: (0, key) for key in states}
        for at in range(0, len(head), block):
            after = {key: self.advance(s, head[at : at + block]) for key, s in states.items()}
            keys = {key: s.key() for key, (s, _) in after.items()}
            fates = {entry: (n + after[key][1], keys[key]) for entry, (n, key) in fates.items()}
            states = {keys[key]: s for key, (s, _) in after.items()}
        if len(found) < 2:
            return fates
        last, n_last = self.advance(self.start, found[-1])
        n_rest = sum(map(self.known.__getitem__, found[1:-1])) + n_last
        return {entry: (n + n_rest, last.key()) for entry, (n, _) in fates.items()}

    def count(self, text: str | None) -> int:
        return sum(map(self.known.__getitem__, self.segments(spaced(text)))) if text else 0


def joined(a: StateMap, b: StateMap) -> StateMap:
    """The map of two neighbouring chunks; without the entries that leave ``a`` in a state that ``b`` lacks."""
    return {entry: (n + b[key][0], b[key][1]) for entry, (n, key) in a.items() if key in b}


def scan(maps: list[StateMap]) -> StateMap:
    """The map of a whole text, its chunks' maps joined level by level."""
    while len(maps) > 1:
        maps = [joined(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def lacking(maps: list[StateMap]) -> tuple[int, str] | None:
    """The first chunk that is entered in a state its map lacks, and that state."""
    key = START
    for i, found in enumerate(maps):
        if key not in found:
            return i, key
        key = found[key][1]
    return None


class _Halves(dict):
    """Piece -> the two parts that its last merge joins."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.merged = transducer.merged

    def __missing__(self, piece: str) -> tuple[str, str]:
        found = self[piece] = tuple(self.merged(piece, 2))
        return found


class _Known(dict):
    """Segment -> tokens of its walk."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.walk, self.limit = transducer.walk, 2 * transducer.limit

    def __missing__(self, segment: str) -> int:
        n = self.walk(segment)
        if len(segment) <= 256:  # a longer one would hardly come again
            if len(self) >= self.limit:
                self.clear()
            self[segment] = n
        return n


def spaced(text: str) -> str:
    """The text as the model reads it: with a leading space, spaces as a visible mark."""
    return SPACE + text.replace(" ", SPACE)


@lru_cache(maxsize=1)
def transducer(model: str) -> Transducer:
    """The transducer of a model file, kept by a Python worker."""
    return Transducer(read_pieces(model))


def token_count(text: Column, model: str) -> Column:
    """Tokens of ``text`` without begin, end or added special tokens; null counts as empty."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = transducer(model).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return counted(text)


def _long_counts(docs: DataFrame, model: str, chunk: int, context: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of long texts: a row a chunk, mapped apart, the maps joined for each text.

    No row or group holds more of a text than a chunk and the ``context`` characters
    before it. Texts of which a chunk is entered in a state that its map lacks are mapped
    again with it, until none is left; each round settles a chunk more of each.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(3).to_pylist()):
                text = spaced(text)
                for at in range(0, len(text), chunk):
                    parts = [pa.array([at // chunk], pa.int64()), pa.array([text[max(0, at - context) : at]]), pa.array([text[at : at + chunk]]), pa.array([at <= context])]
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 1) for j in range(3)), *parts], names=["row", "doc_id", "n_bytes", "at", "before", "part", "whole"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, part, whole, more = (batch.column(j).to_pylist() for j in range(4, 8))
            maps = [transducer(model).map(*row) for row in zip(before, part, whole, more, strict=True)]
            fates = [pa.array([list(m) for m in maps], pa.list_(pa.string())), *(pa.array([[f[i] for f in m.values()] for m in maps], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.string())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(4)), *fates], names=["row", "doc_id", "n_bytes", "at", "entered", "emitted", "left"])

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        maps = [dict(zip(e, zip(map(int, n), x, strict=True), strict=True)) for e, n, x in zip(rows["entered"], rows["emitted"], rows["left"], strict=True)]
        n, (at, key) = scan(maps).get(START, (None, None))[0], lacking(maps) or (None, None)
        one = rows.iloc[:1]
        return pd.DataFrame({"row": one["row"], "doc_id": one["doc_id"].astype("Int64"), "n_bytes": one["n_bytes"], "n_tokens": pd.array([n], "Int64"), "at": pd.array([at], "Int64"), "state": [key]})

    row, more = "row long, doc_id long, n_bytes long, at long", F.array().cast("array<string>").alias("more")
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text")
    chunks = materialise(keyed.mapInArrow(cut, f"{row}, before string, part string, whole boolean").repartition("row", "at")).withColumn("more", more)
    settled = []
    while True:
        maps = chunks.mapInArrow(mapped, f"{row}, entered array<string>, emitted array<long>, left array<string>")
        found = materialise(maps.groupBy("row").applyInPandas(counted, "row long, doc_id long, n_bytes long, n_tokens long, at long, state string"))
        settled.append(found.filter("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens"))
        open_ = found.filter("n_tokens IS NULL")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        again = chunks.join(open_.select("row", F.col("at").alias("_at"), "state"), "row")
        added = F.when(F.col("at") == F.col("_at"), F.array_append("more", F.col("state"))).otherwise(F.col("more"))
        chunks = materialise(again.withColumn("more", added).select(*chunks.columns))


def token_counts(docs: DataFrame, model: str, limit: int = 4096, chunk: int = 262_144, context: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A null or empty text has no bytes and no tokens; a null id and repeated rows are
    kept as they come; no rows give no rows; other columns are ignored. Texts of up to
    ``chunk`` characters are counted in one narrow pass; longer ones are cut into chunks
    that are dealt anew, each with the ``context`` characters before it; ``context`` and
    ``chunk`` change no result. ``model``, a byte-pair model with byte fallback, must be
    readable at the same path on every executor.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(text, F.lit("")).alias("text"))
    short = F.length("text") <= chunk
    counted = rows.filter(short).select("doc_id", "n_bytes", token_count(F.col("text"), model).alias("n_tokens"))
    counted = counted.unionByName(_long_counts(rows.filter(~short), model, chunk, context))
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
