"""SQL that gives the same results as the queries of this package."""

from __future__ import annotations

_TERMS = """
WITH once AS (
    SELECT doc_id, pos, min(token) AS token FROM tokens
    WHERE doc_id IS NOT NULL AND pos IS NOT NULL AND token <> '' GROUP BY doc_id, pos
), counted AS (
    SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM once GROUP BY token
), marked AS (
    SELECT *, CASE WHEN records * 100 > 90 * (SELECT count(*) FROM doc_index) THEN 'common'
        WHEN occurrences < 10 OR records < 5 THEN 'rare' END AS mark FROM counted
)"""

_SCORED = """
WITH once AS (
    SELECT run_id, topic, word_id, max(phi) AS phi FROM phi
    WHERE run_id IS NOT NULL AND topic IS NOT NULL AND word_id IS NOT NULL AND phi IS NOT NULL AND NOT isnan(phi) AND phi > 0
    GROUP BY run_id, topic, word_id
), held AS (
    SELECT *, sum(phi) OVER w AS total, greatest(1, sum(CASE WHEN phi * 10000 >= 1 THEN 1 ELSE 0 END) OVER w)::BIGINT AS records
    FROM once WINDOW w AS (PARTITION BY run_id, word_id)
), scored AS (
    SELECT held.*, log2(m.n_topics / records) + log2(1 - exp(-total * 10000 / m.n_topics)) AS ridf
    FROM held LEFT JOIN models m USING (run_id)
)"""

ORACLE = {
    "p1_found": _TERMS + " SELECT token, mark FROM marked WHERE mark IS NOT NULL",
    "p1_term_frequency": _TERMS + " SELECT token, occurrences, records, mark FROM marked",
    "p1_bigram_frequency": """
WITH once AS (
    SELECT doc_id, pos, min(token) AS token FROM tokens
    WHERE doc_id IS NOT NULL AND pos IS NOT NULL AND token <> '' GROUP BY doc_id, pos
), pairs AS (
    SELECT a.doc_id, a.token || ' ' || b.token AS term FROM once a JOIN once b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
)
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM pairs GROUP BY term HAVING count(*) > 1""",
    "p1_bigram_marks": """
WITH once AS (
    SELECT doc_id, pos, min(token) AS token FROM tokens
    WHERE doc_id IS NOT NULL AND pos IS NOT NULL AND token <> '' GROUP BY doc_id, pos
), pairs AS (
    SELECT a.doc_id, a.token || ' ' || b.token AS term FROM once a JOIN once b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
), counted AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM pairs GROUP BY term)
SELECT *, CASE WHEN records * 100 > 90 * (SELECT count(*) FROM doc_index) THEN 'common'
    WHEN occurrences < 10 OR records < 5 THEN 'rare' END AS mark FROM counted""",
    "p1_repeated_ngrams": """
WITH once AS (
    SELECT doc_id, pos, min(token) AS token FROM tokens
    WHERE doc_id IS NOT NULL AND pos IS NOT NULL AND token <> '' GROUP BY doc_id, pos
), next AS (
    SELECT doc_id, token AS a, pos AS p, lead(token, 1) OVER w AS b, lead(pos, 1) OVER w AS q, lead(token, 2) OVER w AS c, lead(pos, 2) OVER w AS r,
        lead(token, 3) OVER w AS d, lead(pos, 3) OVER w AS s, lead(token, 4) OVER w AS e, lead(pos, 4) OVER w AS t
    FROM once WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), grams AS (
    SELECT doc_id, 2 AS n, a || ' ' || b AS term FROM next WHERE q = p + 1
    UNION ALL SELECT doc_id, 3, a || ' ' || b || ' ' || c FROM next WHERE r = p + 2
    UNION ALL SELECT doc_id, 4, a || ' ' || b || ' ' || c || ' ' || d FROM next WHERE s = p + 3
    UNION ALL SELECT doc_id, 5, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e FROM next WHERE t = p + 4
)
SELECT n, term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM grams GROUP BY n, term HAVING count(*) > 1""",
    "p2_found": """
WITH best AS (
    SELECT run_id, topic, term, max(score) AS score FROM term_scores
    WHERE topic IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND term IS NOT NULL GROUP BY run_id, topic, term
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY run_id, topic ORDER BY score DESC, term DESC)::INT AS place FROM best
)
SELECT run_id, topic, place, term FROM placed WHERE place <= 10""",
    "p4_found": """
SELECT word_id FROM corpus WHERE word_id IS NOT NULL GROUP BY word_id
HAVING count(*) * 1000 >= 2 * (SELECT count(word_id) FROM corpus)""",
    "p4_notable_words": """
SELECT word_id, count(*) AS n_rows, round(count(*) / (SELECT count(word_id) FROM corpus), 8) AS share
FROM corpus WHERE word_id IS NOT NULL GROUP BY word_id
HAVING count(*) * 1000 >= 2 * (SELECT count(word_id) FROM corpus)""",
    "p7_found": _SCORED + " SELECT run_id, topic, word_id FROM scored WHERE phi >= 0.002 AND phi >= 0.3 * total",
    "p7_distinctive_words": _SCORED + """
SELECT run_id, topic, word_id, phi, round(total, 14) AS total, records, round(ridf, 6) + 0.0::DOUBLE AS ridf,
    round(ridf * phi * 10000, 9) + 0.0::DOUBLE AS score FROM scored""",
}
