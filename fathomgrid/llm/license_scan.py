"""Licence scan by diagonal voting.

Every rolling k-gram of a document's words is joined to the positions at which the
same k-gram stands in a licence template. A hit at document position p and template
position t votes for the diagonal p - t. Neighbouring diagonals, which an inserted or
missing word separates, are merged; a merged run is verified by the share of the
template's words that its hits cover and by how densely they lie in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain_words

#: Notices by which public licences are usually applied, by label.
TEMPLATES = {
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-notice": "This software is released under the MIT License",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}

#: Three words that tell a template from others of like wording; a span without them isn't of that licence.
MARKS = {
    "agpl": "gnu affero general",
    "apache": "the apache license",
    "bsd": "retain the above",
    "cc-by": "commons attribution 4",
    "gpl": "gnu general public",
    "gpl-notice": "gnu general public",
    "isc": "and or distribute",
    "lgpl": "gnu lesser general",
    "mit": "any person obtaining",
    "mit-notice": "the mit license",
    "mpl": "the mozilla public",
    "unlicense": "free and unencumbered",
}

#: Phrases whose every occurrence is reported, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for n, part in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + n) == part)
        return hit

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def template_grams(docs: DataFrame, k: int, templates: dict[str, str]) -> DataFrame:
    """Template k-grams: label, t (position), gram, size (words of the template), mark (whether it is what tells the template from others; null for a template without such words).

    As many rows as the templates, a parameter, have words, so they are broadcast.
    """
    rows = docs.sparkSession.createDataFrame(sorted(templates.items()), "label string, body string")
    words = rows.select("label", plain_words(F.col("body")).alias("w"))
    phrase = F.coalesce(*(F.when(F.col("label") == label, F.lit(m)) for label, m in MARKS.items()))
    grams = words.select("label", "w", F.size("w").alias("size"), F.posexplode(_grams(F.col("w"), k)).alias("t", "gram"))
    return grams.select("label", "size", "t", "gram", (F.array_join(F.slice("w", F.col("t") + 1, 3), " ") == phrase).alias("mark"))


def _grams(words: Column, k: int) -> Column:
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + n) for n in range(k)))))


def diagonal_matches(docs: DataFrame, k: int = 3, near: int = 3, cover: float = 0.6, dense: float = 0.5, templates: dict[str, str] | None = None) -> DataFrame:
    """Verified spans: key columns of ``docs``, label, first and last document word, coverage.

    ``docs`` has the columns doc_id, text_hash and w (words). Diagonals of one template
    not more than ``near`` apart merge. A span is kept if its hits cover at least
    ``cover`` of the template's words and ``dense`` of the span's words, and if the words
    that tell the template from others of like wording are among its hits. Rows that
    repeat an id and a text count once.
    """
    grams = docs.select("doc_id", "text_hash", F.posexplode(_grams(F.col("w"), k)).alias("p", "gram"))
    hits = grams.join(F.broadcast(template_grams(docs, k, templates or TEMPLATES)), "gram")
    key = ["doc_id", "text_hash", "label"]
    votes = hits.groupBy(*key, (F.col("p") - F.col("t")).alias("diagonal")).agg(F.first("size").alias("size"), F.collect_set("t").alias("ts"), F.bool_or("mark").alias("mark"))  # a set no longer than the template
    order = Window.partitionBy(*key).orderBy("diagonal")
    begun = votes.withColumn("run", F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= near, 0).otherwise(1)).over(order))
    covered = lambda ts: F.size(F.array_distinct(F.flatten(F.transform(ts, lambda t: F.sequence(t, t + k - 1)))))
    runs = begun.groupBy(*key, "run").agg(
        F.first("size").alias("size"),
        F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"),
        F.bool_or("mark").alias("mark"),
        F.min(F.array_min("ts") + F.col("diagonal")).alias("start"),
        (F.max(F.array_max("ts") + F.col("diagonal")) + (k - 1)).alias("end"),
    )
    n = covered(F.col("ts"))
    spans = runs.filter(F.coalesce("mark", F.lit(True))).select(*key, F.col("start").cast("long"), F.col("end").cast("long"), (n / F.col("size")).alias("coverage"), (n / (F.col("end") - F.col("start") + 1)).alias("density"))
    return spans.filter((F.col("coverage") >= cover) & (F.col("density") >= dense))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One row per input row: phrase places, labels of both kinds and a score.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score:
    1 where a phrase stands, else the best coverage of a verified span, else 0. A null
    or empty text has no words. Null ids are kept, rows that share an id and a text get
    the same result; no rows give no rows; other columns are ignored. Labels ending in
    ``-notice`` count as the licence they name. Only hits of template k-grams and one
    narrow row per document are shuffled.
    """
    text = F.col(text_col)
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), plain_words(text).alias("w"), F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("license")).alias("may"))
    labels = diagonal_matches(words.select("doc_id", "text_hash", "w"), **options).groupBy(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash")).agg(F.array_sort(F.collect_set(F.regexp_replace("label", "-notice$", ""))).alias("found"), F.max("coverage").alias("best"))
    none = F.array().cast("array<int>")
    base = words.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), *(F.when(F.col("may"), _places(F.col("w"), phrase)).otherwise(none).alias(f"at_{label}") for phrase, label in PHRASES))
    every = F.concat(*(F.col(f"at_{label}") for _, label in PHRASES))
    base = base.select("doc_id", "text_hash", "n_words", every.alias("at"), F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for _, label in PHRASES)))).alias("base"))
    joined = base.join(labels, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
