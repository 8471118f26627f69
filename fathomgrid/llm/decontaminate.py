"""Benchmark decontamination through a distributed positional inverted index.

The index is built once and holds, for every document and every term of the test items,
the positions at which the term stands. Test windows are looked up from their rarest
terms: the offset-adjusted position lists of a window's rarest term name candidate
alignments, its next rarest term confirms or (within a few words) nearly confirms them,
and the lists of all the item's terms settle which words are part of an exact phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, materialise, plain_words, sized_join, small

KEY = ["doc_id", "text_hash"]
_INDEX = "doc_id long, text_hash long, term long, positions array<int>"
_OTHER = {"doc_id": "other_id", "text_hash": "other_hash", "term": "other_term"}
_SAME = "doc_id <=> other_id AND text_hash = other_hash AND term = other_term"


class Terms(dict):
    """Word -> its term, the XXH64 of the word; -1 for words outside a vocabulary, if there is one."""

    def __init__(self, vocabulary: list[str] | None) -> None:
        super().__init__((w.encode(), _term(w.encode())) for w in vocabulary or ())
        self.open = vocabulary is None

    def __missing__(self, word: bytes) -> int:
        return _term(word) if self.open else -1


def _term(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)  # as the SQL function xxhash64 has it
    return h - 2**64 if h >= 2**63 else h


def build_index(docs: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Postings ``doc_id, text_hash, term, positions`` of ``docs(doc_id, text_hash, text)``; those of a null term hold the number of words.

    With a ``vocabulary``, which is sent to the executors, only its terms are indexed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(sent.value)
        term_of = terms.__getitem__
        for batch in batches:
            rows, found, starts, places, at = [], [], [0], [], 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = WORD_BYTES.findall(text.encode().lower()) if text else []
                ids = np.fromiter(map(term_of, words), np.int64, len(words))
                where = np.arange(len(ids)) if terms.open else np.flatnonzero(ids != -1)
                order = where[np.argsort(ids[where], kind="stable")]
                cut = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0])) if len(order) else np.array([], int)
                rows.append(np.full(len(cut) + 1, i))
                found += [None, *ids[order[cut]].tolist()]
                starts += [at + 1, *(at + 1 + np.append(cut[1:], len(order))).tolist()] if len(cut) else [at + 1]
                places += [np.array([len(ids)], np.int32), order.astype(np.int32)]
                at += 1 + len(order)
            take = pa.array(np.concatenate(rows) if rows else np.array([], int))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(places) if places else np.array([], np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found, pa.int64()), lists], names=[*KEY, "term", "positions"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(posted, _INDEX)


def _anchors(spelled: DataFrame, postings: DataFrame, window: int) -> DataFrame:
    """The two rarest terms of every window that can occur: item, n, o1, term, o2, term2 (offsets in the item)."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    n = F.least(F.lit(window), F.col("size"))
    ranked = spelled.join(df, "term", "left").withColumns({"n": n, "df": F.coalesce("df", F.lit(0))})
    each = ranked.withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("o") - F.col("n") + 1), F.least("o", F.col("size") - F.col("n")))))
    rarest = each.groupBy("item", "n", "s").agg(F.array_sort(F.collect_list(F.struct("df", "o", "term"))).alias("terms"))  # a window's, n at most
    one, two = F.col("terms")[0], F.when(F.size("terms") > 1, F.col("terms")[1]).otherwise(F.col("terms")[0])
    return rarest.filter(one["df"] > 0).select("item", "n", one["o"].alias("o1"), one["term"].alias("term"), two["o"].alias("o2"), two["term"].alias("term2")).distinct()


def find_items(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 3, vocabulary_words: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(lengths, phrases, near)`` for ``docs(doc_id, text)`` and ``items(item_id, text)``.

    lengths: one row per document row, with n_words. phrases: doc_id, text_hash, item_id,
    start, end, every maximal run of document words that is made of whole windows of an
    item. near: doc_id, text_hash, item_id where the two rarest terms of a window stand
    within ``slop`` words of their distance in the window. Items of more than
    ``vocabulary_words`` different words have all the documents' terms indexed instead.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    named = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("string").alias("item_id"), plain_words(F.col("text")).alias("w"))
    words = materialise(named.distinct().select("item", "item_id", F.size("w").alias("size"), F.posexplode("w").alias("o", "word")))
    spelled = materialise(words.select("item", "size", "o", F.xxhash64("word").alias("term")))
    names = materialise(words.select("item", "item_id").distinct())
    distinct = words.select("word").distinct()
    bounded = small(distinct, vocabulary_words, 64 * vocabulary_words)
    index = materialise(build_index(keyed, [r.word for r in distinct.collect()] if bounded else None))
    lengths = index.filter("term IS NULL").select(*KEY, F.element_at("positions", 1).cast("long").alias("n_words"))
    postings = index.filter("term IS NOT NULL")
    anchors = materialise(_anchors(spelled, postings, window))
    first = sized_join(postings, anchors, ["term"], "inner").select(*KEY, "item", "o2", F.col("term2").alias("term"), "n", F.explode("positions").alias("p"), "o1")
    first = first.select(*KEY, "item", "o2", "term", "n", (F.col("p") - F.col("o1")).alias("delta"))
    listed = postings.withColumnsRenamed(_OTHER)
    second = sized_join(listed, anchors.select(F.col("term2").alias("other_term")).distinct(), ["other_term"], "left_semi")
    both = materialise(
        first.join(second, F.expr(_SAME))
        .select(*KEY, "item", "n", "delta", F.array_contains("positions", F.col("delta") + F.col("o2")).alias("exact"), F.exists("positions", lambda p: F.abs(p - F.col("delta") - F.col("o2")) <= slop).alias("close"))
        .filter("close")
        .groupBy(*KEY, "item", "n", "delta")
        .agg(F.max("exact").alias("exact"))
    )
    near = sized_join(both.select(*KEY, "item").distinct(), names, ["item"], "inner").select(*KEY, "item_id").distinct()
    asked = sized_join(both.filter("exact"), spelled.select("item", "o", "term"), ["item"], "inner")
    hit = both.filter("exact").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    of_hit = sized_join(listed, hit, F.expr("other_id <=> hit_id AND other_hash = hit_hash"), "left_semi")  # so that only these documents' lists are shuffled
    held = asked.join(of_hit, F.expr(_SAME)).filter(F.array_contains("positions", F.col("delta") + F.col("o"))).select(*KEY, "item", "n", "delta", "o").distinct()
    line = Window.partitionBy(*KEY, "item", "n", "delta")
    runs = held.withColumn("run", F.col("o") - F.row_number().over(line.orderBy("o"))).groupBy(*KEY, "item", "n", "delta", "run").agg((F.min("o") + F.col("delta")).alias("start"), (F.max("o") + F.col("delta")).alias("end"))
    phrases = sized_join(runs.filter(F.col("end") - F.col("start") + 1 >= F.col("n")), names, ["item"], "inner").select(*KEY, "item_id", "start", "end")
    return lengths, phrases, near


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    A null or empty document has no words and no hits. Items that are null, that have a
    null id or no words are ignored; items that share an id count as one. Null ids and
    repeated rows of ``docs`` are kept, and rows that share id and text get the same
    result. Empty tables give no rows, or no hits. Other columns are ignored. n_near
    counts items found by proximity, exact ones included.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lengths, phrases, near = find_items(docs, benchmark.select("item_id", "text"), window, **options)
    phrases = materialise(phrases)
    words = phrases.select(*KEY, F.explode(F.sequence("start", "end")).alias("p")).distinct().groupBy(*KEY).agg(F.count("*").alias("hit"))
    items = phrases.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    close = near.groupBy(*KEY).agg(F.count_distinct("item_id").alias("close"))
    out = lengths
    for side in (words, items, close):
        out = out.join(side.withColumnsRenamed(_OTHER), F.expr("doc_id <=> other_id AND text_hash = other_hash"), "left").drop("other_id", "other_hash")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("hit", zero).alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("hit", zero) > 0).alias("contaminated"),
        F.coalesce("close", zero).alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; columns stay as they are."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hit = find_items(plain, benchmark.select("item_id", "text"), window, **options)[1].select(F.col("doc_id").alias("__fg_hit_id"), F.col("text_hash").alias("__fg_hit_hash")).distinct()
    keyed = docs.withColumns({"__fg_key": F.col(id_col).cast("long"), "__fg_hash": F.xxhash64(text_col)})
    return keyed.join(hit, F.expr("__fg_key <=> __fg_hit_id AND __fg_hash = __fg_hit_hash"), "left_anti").drop("__fg_key", "__fg_hash")
