"""The stemmer in SQL, a common table a step over distinct words: what the queries that stem are compared with."""

from __future__ import annotations

from fathomgrid.functions import stemming as S
from fathomgrid.operators.retrieval import STOP_WORDS

STOPPED = ", ".join(f"'{w}'" for w in STOP_WORDS)
WORDS = "SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS w FROM documents"

_V, _C = "[aeiouy]", "[^aeiouy]"


def _ending(table: dict[str, str] | tuple[str, ...]) -> str:
    return "regexp_extract(x, '(" + "|".join(sorted(table, key=len, reverse=True)) + ")$')"


def _replaced(table: dict[str, str]) -> str:
    return "CASE e " + " ".join(f"WHEN '{e}' THEN '{r}'" for e, r in table.items()) + " END"


_SHORT = f"regexp_full_match({{}}, '.*{_C}{_V}[^aeiouywxY]|{_V}{_C}')"


def stem_sql(words: str) -> str:
    """Common tables that end with ``stemmed(w, stem)`` for the distinct words ``w`` of the table ``words``."""
    whole = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.WHOLE_WORDS.items())
    kept = ", ".join(f"'{w}'" for w in S.KEPT_AFTER_PLURALS)
    return f"""voc AS (SELECT DISTINCT w FROM {words}),
marked AS (SELECT w, list_reduce(list_prepend('', string_split(w, '')), lambda a, c: a || CASE WHEN c = 'y' AND (a = '' OR right(a, 1) IN ('a', 'e', 'i', 'o', 'u', 'y')) THEN 'Y' ELSE c END) AS x FROM voc),
region1 AS (SELECT w, x, CASE WHEN regexp_matches(x, '^({"|".join(S.R1_PREFIXES)})') THEN length(regexp_extract(x, '^({"|".join(S.R1_PREFIXES)})'))
  WHEN regexp_matches(x, '{_V}{_C}') THEN length(regexp_extract(x, '^.*?{_V}{_C}')) ELSE length(x) END AS r1 FROM marked),
region2 AS (SELECT w, x, r1, CASE WHEN regexp_matches(substr(x, r1 + 1), '{_V}{_C}') THEN r1 + length(regexp_extract(substr(x, r1 + 1), '^.*?{_V}{_C}')) ELSE length(x) END AS r2 FROM region1),
plural AS (SELECT w, r1, r2, CASE WHEN x LIKE '%sses' THEN left(x, -2) WHEN x LIKE '%ied' OR x LIKE '%ies' THEN left(x, CASE WHEN length(x) > 4 THEN -2 ELSE -1 END)
  WHEN x LIKE '%us' OR x LIKE '%ss' THEN x WHEN regexp_matches(x, '{_V}.*.s$') THEN left(x, -1) ELSE x END AS x FROM region2),
past0 AS (SELECT *, regexp_extract(x, '(eedly|ingly|edly|eed|ing|ed)$') AS e, x IN ({kept}) AS done FROM plural),
past1 AS (SELECT *, left(x, length(x) - length(e)) AS b FROM past0),
past AS (SELECT w, r1, r2, done, CASE WHEN done OR e = '' THEN x WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE x END WHEN NOT regexp_matches(b, '{_V}') THEN x
  WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, -1) WHEN r1 >= length(b) AND {_SHORT.format("b")} THEN b || 'e' ELSE b END AS x FROM past1),
last_y AS (SELECT w, r1, r2, done, CASE WHEN NOT done AND regexp_matches(x, '.{_C}[yY]$') THEN left(x, -1) || 'i' ELSE x END AS x FROM past),
step2 AS (SELECT *, {_ending(S.STEP_2)} AS e FROM last_y),
step3 AS (SELECT w, r1, r2, done, CASE WHEN done OR e = '' OR length(x) - length(e) < r1 OR (e = 'ogi' AND x NOT LIKE '%logi') OR (e = 'li' AND NOT regexp_matches(x, '[{S.BEFORE_LI}]li$')) THEN x ELSE left(x, length(x) - length(e)) || {_replaced(S.STEP_2)} END AS x FROM step2),
step3e AS (SELECT *, {_ending(S.STEP_3)} AS e FROM step3),
step4 AS (SELECT w, r1, r2, done, CASE WHEN done OR e = '' OR length(x) - length(e) < CASE e WHEN 'ative' THEN r2 ELSE r1 END THEN x ELSE left(x, length(x) - length(e)) || {_replaced(S.STEP_3)} END AS x FROM step3e),
step4e AS (SELECT *, {_ending(S.STEP_4)} AS e FROM step4),
step5 AS (SELECT w, r1, r2, done, CASE WHEN done OR e = '' OR length(x) - length(e) < r2 OR (e = 'ion' AND NOT regexp_matches(x, '[st]ion$')) THEN x ELSE left(x, length(x) - length(e)) END AS x FROM step4e),
stemmed AS (SELECT w, CASE WHEN length(w) < 3 THEN w ELSE CASE w {whole} ELSE replace(CASE WHEN done THEN x
  WHEN x LIKE '%e' AND (length(x) - 1 >= r2 OR (length(x) - 1 >= r1 AND NOT {_SHORT.format("left(x, -1)")})) OR x LIKE '%ll' AND length(x) - 1 >= r2 THEN left(x, -1) ELSE x END, 'Y', 'y') END END AS stem FROM step5)"""


#: hits(doc_id, h, n): documents with the stems of "the works licensed", how many of their n words but stop words have one.
ONE_SEARCH = f"""words AS ({WORDS}), said AS (SELECT unnest(['the', 'works', 'licensed']) AS w), everything AS (SELECT w FROM words UNION ALL SELECT w FROM said),
{stem_sql("everything")},
wanted AS (SELECT DISTINCT stem FROM said JOIN stemmed USING (w) WHERE w NOT IN ({STOPPED})),
hits AS (SELECT doc_id, count(*) FILTER (stem IN (FROM wanted)) AS h, count(*) AS n FROM words JOIN stemmed USING (w) WHERE w NOT IN ({STOPPED}) GROUP BY 1 HAVING count(DISTINCT stem) FILTER (stem IN (FROM wanted)) = (SELECT count(*) FROM wanted))"""
