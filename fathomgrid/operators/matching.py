"""All phrases of several vocabularies found in one pass over the texts.

An Aho-Corasick automaton of all phrases reads each text once, whatever the number of
phrases; a task builds it once and sees Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASES, PHRASE_BYTES = 200_000, 64_000_000  # an automaton has no more of either


def find_phrases(texts: DataFrame, id_col: str, text_col: str, vocabularies: Mapping[str, Mapping[str, Sequence[str]]], whole_words: bool = False) -> DataFrame:
    """``id, vocabulary, term, phrase, n, first``: how often each phrase of ``vocabularies`` (name -> term -> phrases) stands in a text, and where first.

    Case is put aside; occurrences may overlap, and places count characters from 0. With ``whole_words`` a
    letter, digit or underscore may not stand beside an occurrence. A phrase of several terms or vocabularies is found for each;
    an empty one for none. Null texts hold none. The phrases are sent to every task: more than ``PHRASES``, or
    ``PHRASE_BYTES`` of them, are an error.
    """
    owners: dict[str, list[tuple[str, str]]] = {}
    for name, terms in vocabularies.items():
        for term, phrases in terms.items():
            for phrase in dict.fromkeys(p.lower() for p in phrases if p):
                owners.setdefault(phrase, []).append((name, term))
    if len(owners) > PHRASES or sum(map(len, owners)) > PHRASE_BYTES:
        raise ValueError(f"more than {PHRASES} phrases or {PHRASE_BYTES} bytes: deal the vocabulary to several passes")
    kind = texts.schema[id_col].dataType
    names = ["id", "vocabulary", "term", "phrase", "n", "first"]
    word = lambda c: c.isalnum() or c == "_"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for phrase in owners:
            machine.add_word(phrase, phrase)
        if owners:
            machine.make_automaton()
        for batch in batches:
            rows: list[tuple[int, str, str, str, int, int]] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                n, first = Counter(), {}
                for end, phrase in machine.iter(text) if text and owners else ():
                    start = end - len(phrase) + 1
                    if not whole_words or not (start and word(text[start - 1]) or end + 1 < len(text) and word(text[end + 1])):
                        n[phrase] += 1
                        first.setdefault(phrase, start)
                rows += [(i, *owner, phrase, count, first[phrase]) for phrase, count in n.items() for owner in owners[phrase]]
            row, *rest = zip(*rows, strict=True) if rows else [()] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))], names=names)

    found = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).mapInArrow(scan, f"id {kind.simpleString()}, vocabulary string, term string, phrase string, n long, first long")
    return found
