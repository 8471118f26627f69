"""Secret scan: fixed patterns, and guess costs of the values in credential contexts.

A value's guess cost is the smallest sum, over all ways to segment it, of the log10
guesses of its parts: dictionary words, dates and years, keyboard walks, repeats of what
stands anywhere before and brute-forced characters. Every part but words and dates is
paid by the character once begun, so all sub-spans of walks and repeats, of any period and length, are
weighed in n log n steps: values of any length are scored whole. The dictionary is a
short fixed list and the corpus's own frequent words.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 24 or more is a match of [0-9a-f]+ that is long enough, and the reverse.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Credential contexts that the fixed patterns don't know; the value is judged by its cost.
CONTEXT = re.compile(r"""(?ai:\b(?:pwd|pass|passphrase|passcode|credentials?|auth|authorization|bearer|private[_-]?key|access[_-]?key|client[_-]?key|login|pin))["']?(?:\x20*[:=]\x20*|\x20+is\x20+)["']?([^\s"'<>,;]+)""")

KINDS = ("assign", "access", "hex", "credential")

#: Words that guessing programs try first, most common first.
COMMON = """password admin welcome letmein dragon monkey master login princess qwerty football baseball shadow michael
superman batman trustno access hello charlie donald freedom whatever starwars secret summer winter spring autumn
flower hottie loveme jordan hunter ranger buster soccer hockey killer george andrew thomas jessica jennifer pepper
daniel ginger cookie orange banana computer internet server system root user test guest default changeme public
private token key data base backup office company service manager support google apple windows linux love money
the and you for with this that have from your""".split()
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp")
_DAY, _MONTH, _YEAR, _GAP = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9]{2}", "[-/._]?"
#: Dates, and the log10 guesses of each.
DATES = tuple((re.compile(p), cost) for p, cost in ((_YEAR, 2.1), (_YEAR + _GAP + _MONTH, 3.3), (_YEAR + _GAP + _MONTH + _GAP + _DAY, 4.6), (_DAY + _GAP + _MONTH + _GAP + _YEAR, 4.6), (_MONTH + _GAP + _DAY + _GAP + _YEAR, 4.6)))
CHANGED = 0.3  # for capitals, and for characters that stand for others
WALK_START, WALK_STEP = 3.1, 0.2  # a row, a place and a direction; each further key
REPEAT_START, REPEAT_STEP = 1.0, 0.1  # how much is repeated; each repeated character

_STEP = {pair for row in WALKS for line in (row, row[::-1]) for pair in zip(line, line[1:], strict=False)}
_LEET = str.maketrans("@4301$57!", "aaeolssti")


class Words(dict):
    """Word -> log10 of its rank, the cheapest first."""

    def __init__(self, words: Iterable[str]) -> None:
        super().__init__()
        for word in words:
            self.setdefault(word, math.log10(len(self) + 2))
        self.longest = max(map(len, self), default=0)


_COMMON = Words(COMMON)


def _alphabet(value: str) -> float:
    size = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value)
    return math.log10(max(size, 10))


def _plain(value: str) -> tuple[str, str]:
    """The value in lower case, and with characters that stand for letters replaced; both as long as it is."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return low, low.translate(_LEET)


def longest_before(text: str) -> list[int]:
    """For each place the length of the longest run from there that also begins at an earlier place; the two may overlap.

    A suffix automaton of the text knows where a run first ends. The run of a place is that of the place
    before without its first character, made longer as far as it goes, so all of them take linear time.
    """
    after: list[dict[str, int]] = [{}]
    link, size, ends = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(text):
        new, at = len(after), last
        after.append({})
        link.append(0)
        size.append(i + 1)
        ends.append(i)
        while at >= 0 and c not in after[at]:
            after[at][c] = new
            at = link[at]
        if at >= 0:
            known = after[at][c]
            if size[known] == size[at] + 1:
                link[new] = known
            else:
                copy = len(after)
                after.append(dict(after[known]))
                link.append(link[known])
                size.append(size[at] + 1)
                ends.append(ends[known])
                link[known] = link[new] = copy
                while at >= 0 and after[at].get(c) == known:
                    after[at][c] = copy
                    at = link[at]
        last = new
    out, at, length = [], 0, 0
    for i in range(len(text)):
        if length:  # drop the first character
            length -= 1
            if length == size[link[at]]:
                at = link[at]
        while i + length < len(text) and (more := after[at].get(text[i + length])) is not None and ends[more] < i + length:
            at, length = more, length + 1
        out.append(length)
    return out


def guess_cost(value: str, words: Words = _COMMON) -> float:
    """log10 of the guesses of the cheapest segmentation; 0 for an empty value.

    ``best[i]`` is the least cost of the first i characters and ``walk`` that of those whose last part is a
    walk that may go on. A repeat that begins at i may end at any place up to ``last``; what it
    costs beside the place of its end is kept in ``repeats``, the cheapest first.
    """
    n, one = len(value), _alphabet(value)
    low, plain = _plain(value)
    run = longest_before(low)
    best = [0.0] + [math.inf] * n
    walk, repeats = math.inf, []
    for i in range(n):
        here = best[i]
        cost = here + one
        walk = min(walk, best[i - 1] + WALK_START) + WALK_STEP if i and (low[i - 1], low[i]) in _STEP else math.inf
        cost = min(cost, walk)
        if run[i]:
            heapq.heappush(repeats, (here + REPEAT_START - REPEAT_STEP * i, i + run[i]))
        while repeats and repeats[0][1] <= i:
            heapq.heappop(repeats)
        if repeats:
            cost = min(cost, repeats[0][0] + REPEAT_STEP * (i + 1))
        best[i + 1] = min(best[i + 1], cost)
        for j in range(i + 2, min(n, i + words.longest) + 1):
            for spelled in {low[i:j], plain[i:j]}:
                rank = words.get(spelled)
                if rank is not None:
                    best[j] = min(best[j], here + rank + CHANGED * (value[i:j] != low[i:j]) + CHANGED * (spelled != low[i:j]))
        if low[i].isdigit():
            for pattern, guesses in DATES:
                date = pattern.match(value, i)
                if date:
                    best[date.end()] = min(best[date.end()], here + guesses)
    return best[n]


def scan(text: str, strong: float = 8.0, words: Words = _COMMON) -> tuple[list[tuple[int, int, int]], float | None]:
    """Spans ``(start, kind, end)`` in order, and the largest guess cost of a value."""
    spans, costs, taken = [], [], set()
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                spans.append((m.start(), 0, m.end()))
                costs.append(guess_cost(m[2], words))
                taken.add(m.start(2))
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        if m.start(1) not in taken and m.end() - m.start(1) >= 6:
            cost = guess_cost(m[1], words)
            if cost >= strong:
                costs.append(cost)
                spans.append((m.start(1), 3, m.end(1)))
    return sorted(spans), max(costs, default=None)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_credential long, max_guess_log10 double"


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = 65_536, share: int = 1_048_576, least: int = 20) -> list[str]:
    """The words of 4 to 24 lower-case letters that stand ``least`` times and are at least one in ``share`` of all such words of the corpus, ``most`` at most, the most frequent first.

    The list is a parameter of the costs and is sent to every task, so its size is bounded; ``least`` keeps words
    that few texts hold, such as passwords, out of it in a small corpus. Counting covers all rows.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{4,}"), 0)).alias("word")).filter(F.length("word") <= 24)
    counts = materialise(words.groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r.word for r in counts.filter((F.col("n") * share >= total) & (F.col("n") >= least)).orderBy(F.col("n").desc(), "word").limit(most).collect()]


def scan_secrets(docs: DataFrame, strong: float = 8.0, dictionary: Iterable[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the secrets of the whole text; positions are code points.

    Kinds assign, access and hex are the fixed patterns. Kind credential is the value
    alone, in a context such as ``pwd=`` or ``passphrase is``, of six characters or more
    whose guess cost is ``strong`` or above. max_guess_log10 is the largest cost among
    assign and credential values, null without any. ``dictionary`` lists words from the
    most common on; by default `frequent_words` of ``docs``, after a fixed list. A null
    text is an empty one; null ids and repeated rows stay; no rows give no rows; other
    columns are ignored. The scan is one narrow pass, no shuffle.
    """
    words = docs.sparkSession.sparkContext.broadcast(Words([*COMMON, *(frequent_words(docs, text_col) if dictionary is None else dictionary)]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                spans, cost = scan(text or "", strong, words.value)
                names = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                base = ",".join(name for name, (_, k, _) in zip(names, spans, strict=True) if k < 3)
                kinds = [k for _, k, _ in spans]
                row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), ",".join(names), kinds.count(3), cost)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds_of, strict=True))], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scanned, _SCHEMA)
