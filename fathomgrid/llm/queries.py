"""The registered queries of this subpackage, and their SQL where SQL has the means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .collocations import collocations
from .common import table
from .decontaminate import decontaminate
from .license_scan import MARKS, TEMPLATES, scan_licences
from .line_dedup import dedup_lines
from .lm_score import backoff_scores
from .mixing import mix_sources
from .packing import pack
from .secret_scan import scan_secrets
from .simhash import simhash_components
from .token_counts import token_counts
from .toxicity import score_toxicity
from .vector_codes import vector_codes


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


#: A window is the item's words s to s + n - 1, n being 10 or the item's length; n_near counts the items of which the two rarest words of a window stand within 3 words of their distance.
OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT k, n, p, array_to_string(w[p : p + n - 1], ' ') AS gram
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT k, p, g.n, item_id FROM grams g JOIN windows USING (n, gram)),
hit AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM found) GROUP BY k),
spelled AS (SELECT r, item_id, len(w) AS size, least(len(w), 10) AS n, unnest(range(len(w))) AS o, unnest(w) AS word FROM (SELECT row_number() OVER () AS r, * FROM items) WHERE len(w) > 0),
places AS (SELECT k, word, p FROM (SELECT k, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs) SEMI JOIN spelled USING (word)),
df AS (SELECT word, count(DISTINCT k) AS c FROM places GROUP BY word),
ranked AS (
  SELECT r, s, item_id, o, word, c, row_number() OVER (PARTITION BY r, s ORDER BY c, o) AS rank
  FROM (SELECT r, item_id, o, word, coalesce(c, 0) AS c, unnest(range(greatest(0, o - n + 1), least(o, size - n) + 1)) AS s FROM spelled LEFT JOIN df USING (word))),
anchors AS (
  SELECT DISTINCT a.item_id, a.o AS o1, a.word AS word1, coalesce(b.o, a.o) AS o2, coalesce(b.word, a.word) AS word2
  FROM ranked a LEFT JOIN ranked b ON a.r = b.r AND a.s = b.s AND b.rank = 2 WHERE a.rank = 1 AND a.c > 0),
close AS (
  SELECT k, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near
  FROM (SELECT x.k, item_id FROM anchors JOIN places x ON x.word = word1 JOIN places y ON y.k = x.k AND y.word = word2 WHERE abs(y.p - (x.p - o1) - o2) <= 3) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN hit USING (k) LEFT JOIN named USING (k) LEFT JOIN close USING (k)
"""


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


#: ASCII white space separates words; a line's place is (doc_id, line).
OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS body FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
words AS (
  SELECT doc_id, line, body, list_filter(regexp_split_to_array(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM lines),
firsts AS (SELECT w, min({'d': doc_id, 'l': line}) AS place FROM words WHERE len(w) >= 1 GROUP BY w),
variants AS (SELECT w, place, i, list_concat(w[1 : i - 1], w[i + 1 :]) AS v FROM (SELECT w, place, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 2)),
replaced AS (SELECT a.place, b.one FROM variants a JOIN (SELECT v, i, min(place) AS one FROM variants GROUP BY v, i) b ON a.v = b.v AND a.i = b.i WHERE b.one < a.place),
missing AS (SELECT greatest(a.place, f.place) AS place FROM variants a JOIN firsts f ON a.v = f.w WHERE len(f.w) >= 2 AND a.place <> f.place),
near AS (SELECT place FROM replaced UNION SELECT place FROM missing),
marked AS (
  SELECT doc_id, words.line, body, len(w) >= 1 AND (n.place IS NOT NULL OR f.place <> {'d': doc_id, 'l': words.line}) AS gone, n.place IS NOT NULL AS near
  FROM words LEFT JOIN firsts f USING (w) LEFT JOIN near n ON n.place = f.place)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (gone) AS n_dropped, count(*) FILTER (gone AND near) AS n_near,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (NOT coalesce(gone, false)), '')) AS text_sha256
FROM marked JOIN documents USING (doc_id) GROUP BY doc_id, text
"""

#: Two start marks stand before the words; o is a row's own count of an n-gram, which its count loses.
OP9_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
tokens AS (
  SELECT k, p[i - 2] AS u, p[i - 1] AS v, p[i] AS w
  FROM (SELECT k, p, unnest(range(3, len(p) + 1)) AS i FROM (SELECT k, list_concat([chr(10), chr(10)], w) AS p FROM docs WHERE len(w) > 0))),
started AS (SELECT DISTINCT k, chr(10) AS s FROM tokens),
own3 AS (SELECT k, u, v, w, count(*) AS o FROM tokens GROUP BY ALL),
own2 AS (SELECT k, v, w, count(*) AS o FROM (SELECT k, v, w FROM tokens UNION ALL SELECT k, s, s FROM started) GROUP BY ALL),
own1 AS (SELECT k, w, count(*) AS o FROM (SELECT k, w FROM tokens UNION ALL SELECT k, s FROM started) GROUP BY ALL),
c3 AS (SELECT k, u, v, w, sum(o) OVER (PARTITION BY u, v, w) - o AS c FROM own3),
c2 AS (SELECT k, v, w, sum(o) OVER (PARTITION BY v, w) - o AS c FROM own2),
c1 AS (SELECT k, w, sum(o) OVER (PARTITION BY w) - o AS c FROM own1),
sizes AS (SELECT k, count(*) AS n, greatest((SELECT count(*) FROM tokens) - count(*), 1) AS others FROM tokens GROUP BY k),
scored AS (
  SELECT k, c3.c > 0 AS known,
    CASE WHEN c3.c > 0 THEN log10(c3.c) - log10(h2.c) WHEN c2.c > 0 THEN log10(0.4) + log10(c2.c) - log10(h1.c)
         WHEN c1.c > 0 THEN 2 * log10(0.4) + log10(c1.c) - log10(others) ELSE 3 * log10(0.4) - log10(others) END AS s
  FROM tokens t JOIN sizes USING (k) JOIN c3 USING (k, u, v, w) JOIN c2 USING (k, v, w) JOIN c1 USING (k, w)
  JOIN c2 h2 ON h2.k = t.k AND h2.v = t.u AND h2.w = t.v JOIN c1 h1 ON h1.k = t.k AND h1.w = t.v)
SELECT doc_id, CAST(len(docs.w) AS BIGINT) AS n_words, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known, round(coalesce(total, 0.0), 4) AS log10_score, round(total / len(docs.w), 6) AS mean_log10
FROM docs LEFT JOIN (SELECT k, count(*) FILTER (known) AS n_known, sum(s) AS total FROM scored GROUP BY k) USING (k)
"""

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(label, body.replace("'", "''")) for label, body in sorted(TEMPLATES.items()))
_MARK_ROWS = ", ".join(f"('{label}', '{phrase}')" for label, phrase in MARKS.items())
_LICENCE_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {_LICENCE_WORDS.format("text")} AS w FROM documents),
templates AS (SELECT label, {_LICENCE_WORDS.format("body")} AS w FROM (VALUES {_TEMPLATE_ROWS}) t(label, body)),
grams AS (SELECT k, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS gram FROM (SELECT k, w, unnest(range(len(w) - 2)) AS p FROM docs WHERE len(w) >= 3)),
marks AS (SELECT label, n, t, w[t + 1] || ' ' || w[t + 2] || ' ' || w[t + 3] AS gram FROM (SELECT label, w, len(w) AS n, unnest(range(len(w) - 2)) AS t FROM templates)),
hits AS (SELECT DISTINCT k, label, n, t, p - t AS diagonal FROM grams JOIN marks USING (gram)),
diagonals AS (SELECT k, label, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY k, label ORDER BY diagonal) <= 3 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT k, label, diagonal FROM hits)),
runs AS (SELECT k, label, diagonal, sum(new) OVER (PARTITION BY k, label ORDER BY diagonal) AS run FROM diagonals),
covered AS (SELECT k, label, run, count(DISTINCT q) AS n_covered FROM (SELECT k, label, run, unnest([t, t + 1, t + 2]) AS q FROM hits JOIN runs USING (k, label, diagonal)) GROUP BY ALL),
spans AS (SELECT k, label, run, n, min(t + diagonal) AS a, max(t + diagonal) + 2 AS b FROM hits JOIN runs USING (k, label, diagonal) GROUP BY ALL),
told AS (SELECT k, label, run, bool_or(gram = phrase) AS mark FROM hits JOIN runs USING (k, label, diagonal) JOIN marks USING (label, t) LEFT JOIN (VALUES {_MARK_ROWS}) p(label, phrase) USING (label) GROUP BY ALL),
kept AS (SELECT k, regexp_replace(label, '-notice$', '') AS label, n_covered / n AS cover FROM spans JOIN covered USING (k, label, run) JOIN told USING (k, label, run) WHERE coalesce(mark, true) AND n_covered / n >= 0.6 AND n_covered / (b - a + 1) >= 0.5),
places AS (
  SELECT k, p, label FROM (SELECT k, w, unnest(range(len(w))) AS p FROM docs), (VALUES ('mit', ['mit', 'license']), ('apache', ['apache', 'license']), ('gpl', ['general', 'public', 'license'])) x(label, phrase)
  WHERE w[p + 1 : p + len(phrase)] = phrase),
base AS (SELECT k, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY k),
labelled AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM kept UNION SELECT k, label FROM places) GROUP BY k),
best AS (SELECT k, max(cover) AS cover FROM kept GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE least(coalesce(cover, 0.0), 1.0) END AS score
FROM docs LEFT JOIN base USING (k) LEFT JOIN labelled USING (k) LEFT JOIN best USING (k)
"""

#: A round is: the nearest entry of every part (its number), then the floored means; // of DuckDB cuts, so that means of sums below zero are floored by hand.
_OP12_ROUND = """
code{k} AS MATERIALIZED (SELECT v, p, part, min({{'d': list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS best FROM cut JOIN book{k} USING (p) GROUP BY v, p, part),
mean{k} AS (SELECT p, e, list(m ORDER BY j) AS entry FROM (
  SELECT p, best.e AS e, j, (sum(part[j]) - ((sum(part[j]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM code{k}, range(1, 5) t(j) WHERE j <= len(part) GROUP BY p, best.e, j) GROUP BY p, e),
book{n} AS MATERIALIZED (SELECT p, e, coalesce(m.entry, b.entry) AS entry FROM book{k} b LEFT JOIN mean{k} m USING (p, e)),
"""

#: Vectors of these tables have 64 components, so that a part has four.
OP12_SQL = f"""
WITH whole AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS v, vec_id, label, x
  FROM (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
cut AS MATERIALIZED (SELECT v, p, x[4 * p + 1 : 4 * p + 4] AS part FROM whole, range(16) t(p)),
book0 AS MATERIALIZED (SELECT p, v - 1 AS e, part AS entry FROM cut WHERE v <= 64),
{_OP12_ROUND.format(k=0, n=1)}{_OP12_ROUND.format(k=1, n=2)}{_OP12_ROUND.format(k=2, n=3).partition("mean2")[0]}
coded AS (SELECT v, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM code2 GROUP BY v),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(entry, lambda c: CAST(c AS VARCHAR)), ','), ',' ORDER BY p, e)) AS sha FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM whole JOIN coded USING (v), books
"""

#: g holds each phrase of one to five words with its count f; a longer phrase absorbs what stands inside it as often.
OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
said AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM said GROUP BY lang),
g AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM said, range(1, 6) t(k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
absorbed AS (SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN (
    SELECT lang, a, array_to_string(w[i : j], ' ') AS phrase FROM (SELECT lang, w, a, k, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates)) WHERE j - i + 1 < k) x
  ON x.lang = c.lang AND x.phrase = c.phrase WHERE 100 * x.a >= 100 * c.a),
cuts AS (SELECT lang, phrase, a, c, array_to_string(w[1 : c], ' ') AS first, array_to_string(w[c + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates ANTI JOIN absorbed USING (lang, phrase))),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, min({'score': 1000::HUGEINT * a * n // (x.f::HUGEINT * y.f), 'c': c, 'l': x.f, 'r': y.f}) AS best, n
  FROM cuts JOIN total USING (lang) JOIN g x ON x.lang = cuts.lang AND x.phrase = first JOIN g y ON y.lang = cuts.lang AND y.phrase = rest GROUP BY cuts.lang, cuts.phrase, a, n)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank, phrase, a, best.l AS l, best.r AS r, CAST(n AS BIGINT) AS n, CAST(best.score AS BIGINT) AS score
FROM scored QUALIFY rank <= 2000
"""


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents")).withColumns({"log10_score": F.round("log10_score", 4), "mean_log10": F.round("mean_log10", 6)})


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_neighbours, op4_simhash_dedup, op5_line_dedup, op6_decontamination, op7_token_counts, op8_secret_scan, op9_lm_score, op10_license_scan, op11_mixing, op12_vector_codes, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op9_lm_score": OP9_SQL, "op10_license_scan": OP10_SQL, "op12_vector_codes": OP12_SQL, "op13_collocations": OP13_SQL}
