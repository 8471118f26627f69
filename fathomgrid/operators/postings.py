"""Full-text search of many queries at once over an inverted index.

Texts are split once. The index is a table of postings, dealt and sorted by term, with the
number of texts of every term and the size of every text. A query starts from the postings
of its rarest term; its other terms are looked up in those texts alone: postings of the terms asked
for are sent once, by text, so that a frequent term's are never sent to one task. Queries of the same terms
are answered once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fathomgrid.functions.stemming import stem_word
from fathomgrid.operators.retrieval import STOP_WORDS
from fathomgrid.session import written


@dataclass(frozen=True)
class Postings:
    """``postings(term, id, n)``, ``terms(term, texts)`` and ``sizes(id, size)``; ``stemmed`` says what a term is."""

    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame
    stemmed: bool


_TERM = re.compile("[a-z0-9]+")
_ROWS, _KNOWN = 200_000, 500_000  # rows that are held before they are sent, stems that are remembered


def _counted(rows: DataFrame, key: str, text: Column, stemmed: bool) -> DataFrame:
    """``key, term, n``: how often each term stands in each row's text; stop words aren't terms of a stemmed index.

    A text is split, stemmed and counted where it is read, so that its terms alone are sent. Rows of one key aren't added up.
    """
    schema = StructType([StructField(key, rows.schema[key].dataType), StructField("term", StringType()), StructField("n", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}

        def terms_of(text: str) -> dict[str, int]:
            words = Counter(_TERM.findall(text))
            if not stemmed:
                return words
            found: dict[str, int] = {}
            for word, n in words.items():
                if word in STOP_WORDS:
                    continue
                if (stem := known.get(word)) is None:
                    if len(known) >= _KNOWN:
                        known.clear()
                    stem = known[word] = stem_word(word)
                found[stem] = found.get(stem, 0) + n
            return found

        for batch in batches:
            at, terms, counts = [], [], []
            for i, text in enumerate(batch.column(1)):
                found = terms_of(text.as_py() or "")
                at.extend([i] * len(found))
                terms.extend(found)
                counts.extend(found.values())
                if len(at) > _ROWS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=schema.names)
                    at, terms, counts = [], [], []

    return rows.select(F.col(key), F.lower(text)).mapInArrow(count, schema)


def build_postings(docs: DataFrame, id_col: str, text_col: str, stemmed: bool = False) -> Postings:
    """The index of all texts; texts with a null id, and those without a term, are in none of its tables.

    Rows of one id are one text. The tables are written to the shared folder.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    dealt = _counted(rows, "id", F.col("_text"), stemmed).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(16))).repartition("term", "_part")
    postings = written(dealt.groupBy("term", "_part", "id").agg(F.sum("n").alias("n")).select("term", "id", "n").sortWithinPartitions("term", "id"))
    terms = written(postings.groupBy("term").agg(F.count("*").alias("texts")))
    sizes = written(postings.groupBy("id").agg(F.sum("n").alias("size")))
    return Postings(postings, terms, sizes, stemmed)


def search_postings(index: Postings, queries: DataFrame, limit: int = 20, batch: int = 1_000_000) -> DataFrame:
    """``query_id, id, rank_score, rank``: for each of ``queries(query_id, query)`` the texts that hold all its terms.

    The score is the share of a text's terms that are the query's; the best first, ties by id,
    ``limit`` at most. A query without a term, or with one that no text holds, finds nothing. Sets of terms go to
    every task in parts of about ``batch`` terms.
    """
    asked = _counted(queries.select("query_id", "query"), "query_id", F.col("query"), index.stemmed)
    sets = asked.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    sets = written(sets.withColumn("set_id", F.array_join("terms", " ")))
    distinct = sets.groupBy("set_id").agg(F.first("terms").alias("terms"))
    wanted = distinct.select("set_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).join(index.terms, "term")
    known = wanted.groupBy("set_id", "n_terms").agg(F.count("*").alias("n_known"), F.array_sort(F.collect_list(F.struct("texts", "term"))).alias("terms")).filter("n_known = n_terms")
    known = written(known.select("set_id", F.monotonically_increasing_id().alias("set_no"), F.col("terms.term").alias("terms")))
    # terms and sets go by number; a term leads the sets of which it is the rarest
    numbers = known.select(F.posexplode("terms").alias("pos", "term")).groupBy("term").agg((F.min("pos") == 0).alias("leads"))
    numbers = written(numbers.select("term", "leads", F.monotonically_increasing_id().alias("no")))
    numbered = known.select("set_no", F.posexplode("terms").alias("pos", "term")).join(numbers.select("term", "no"), "term")
    numbered = written(numbered.groupBy("set_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "no"))), lambda x: x["no"]).alias("nos")))

    # a text's wanted terms come together once, and are met there by the sets that its terms lead, some sets at a time
    has = index.postings.join(numbers, "term").groupBy("id").agg(F.collect_list(F.struct("no", "n", "leads")).alias("has"))
    texts = has.join(index.sizes, "id").select("id", "size", F.col("has.no").alias("nos"), F.col("has.n").alias("ns"), F.explode(F.filter("has", lambda x: x["leads"])).alias("at"))
    texts = texts.select("id", "size", "nos", "ns", F.col("at.no").alias("lead"), F.col("at.n").alias("n"))
    n_parts = numbered.agg(F.ceil(F.sum(F.size("nos") + 10) / batch)).first()[0] or 1
    one_of = lambda i: numbered.filter(F.pmod(F.xxhash64("set_no"), F.lit(n_parts)) == i).select("set_no", F.col("nos")[0].alias("lead"), F.slice("nos", 2, 2**31 - 1).alias("others"))
    met = reduce(DataFrame.union, (texts.join(F.broadcast(one_of(i)), "lead").select("set_no", "id", "size", "n", "others", "nos", "ns") for i in range(n_parts)))
    # null as soon as a term isn't in the text
    more = F.aggregate("others", F.lit(0).cast("long"), lambda total, no: total + F.get("ns", F.array_position("nos", no).cast("int") - 1))
    scored = met.select("set_no", "id", ((F.col("n") + more) / F.col("size")).alias("rank_score")).filter("rank_score IS NOT NULL")
    order = Window.partitionBy("set_no").orderBy(F.col("rank_score").desc(), "id")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return sets.select("query_id", "set_id").join(best.join(known.select("set_no", "set_id"), "set_no"), "set_id").select("query_id", "id", "rank_score", "rank")


def first_found(found: DataFrame, order: str = "query_pos", limit: int = 10) -> DataFrame:
    """``design_id, id, relevance, position``: of ``found(design_id, query_pos, id, relevance)`` each text once, as the first query found it, the most relevant first."""
    once = found.groupBy("design_id", "id").agg(F.min_by("relevance", order).alias("relevance"))
    over = Window.partitionBy("design_id").orderBy(F.col("relevance").desc(), "id")
    return once.withColumn("position", F.row_number().over(over)).filter(F.col("position") <= limit)
