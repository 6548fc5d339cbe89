"""SQL that gives the same results as the queries of the core.

Written for an engine whose regular expressions have no lookaround.
"""

from __future__ import annotations

from lexiloom.plans import lda
from lexiloom.operators.generate import SPREAD
from lexiloom.plans.queries import _CYCLES, _SHORT, CUSTOM_STOPWORDS, FEW_TOPICS, FILTERS, KERNEL_TOPICS, N_TOPICS
from lexiloom.sources.stopwords import default_stopwords

DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _values(words) -> str:
    return "(VALUES " + ", ".join(f"('{w}')" for w in words) + ")"


def _lower(t: str) -> str:
    return f"lower({t})"


def _urls(t: str) -> str:
    return rf"regexp_replace({t}, '\S+://\S+', '', 'g')"


def _punct(t: str) -> str:
    return f"regexp_replace({t}, '[!,.?/:;_]', ' ', 'g')"


def _chars(t: str) -> str:
    return f"regexp_replace({t}, '[^a-zA-Z0-9'' -]', '', 'g')"


def _numbers(t: str) -> str:
    return f"array_to_string(list_transform(string_split({t}, ' '), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '' ELSE x END), ' ')"


def _blank(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')"


def _default(t: str) -> str:
    return _blank(_numbers(_chars(_punct(_urls(_lower(t))))))


def _clean(expression: str) -> str:
    return f"WITH {DOCS} SELECT doc_id, {expression} AS text FROM docs"


def _listed(text: str, spaced: str, split: str) -> str:
    """Parts of a text without trailing empty ones; ``spaced``: a text in which the delimiter is a space at each end."""
    return f"""CASE WHEN NOT regexp_matches({text}, '{spaced}') THEN [{text}]
        ELSE list_slice({split}, 1, coalesce(list_max(list_transform({split}, lambda x, i: CASE WHEN x <> '' THEN i END)), 0)) END"""


def _tokenise(spaced: str, split: str) -> str:
    return f"WITH {DOCS}, listed AS (SELECT doc_id, {_listed('text', spaced, split)} AS l FROM docs) SELECT doc_id, array_to_string(l, '|') AS tokens, len(l)::INT AS n_tokens FROM listed"


TOKENS = f"""{DOCS}, tokenised AS (
    SELECT doc_id, unnest(l) AS token, (generate_subscripts(l, 1) - 1)::INT AS pos
    FROM (SELECT doc_id, {_listed("t", " ", "string_split(t, ' ')")} AS l FROM (SELECT doc_id, {_default("text")} AS t FROM docs))
)"""
UNSTOPPED = f"{TOKENS}, unstopped AS (SELECT * FROM tokenised WHERE token NOT IN (SELECT * FROM {_values(default_stopwords())}))"
STATS = f"""{UNSTOPPED}, stats AS (
    SELECT token, count(*) AS freq, count(DISTINCT doc_id) AS doc_freq FROM unstopped GROUP BY token
)"""
_COLUMNS = {"freq": "freq", "share": "doc_freq / (SELECT count(*) FROM docs)", "docs": "doc_freq", "length": "length(token)"}


def _bounds(bounds) -> str:
    tests = [f"{_COLUMNS[name.split('_')[1]]} {'<=' if name.startswith('max') else '>='} {value}" for name, value in bounds.bounds().items()]
    return " AND ".join(tests) or "true"


def _filtered(bounds) -> str:
    return f"{STATS}, kept AS (SELECT * FROM unstopped WHERE token IN (SELECT token FROM stats WHERE {_bounds(bounds)}))"


_DEFAULT = type(next(iter(FILTERS.values()))).default()

ONCE = """once AS (
    SELECT doc_id, pos, min(word_id) AS word_id, min(topic) AS topic FROM corpus WHERE word_id IS NOT NULL GROUP BY doc_id, pos
), c AS (SELECT * FROM once WHERE topic IS NOT NULL)"""
LENGTHS = f"""{ONCE}, lengths AS (
    SELECT doc_id, coalesce(n, 0) AS n_tokens FROM doc_index LEFT JOIN (SELECT doc_id, count(*) AS n FROM once GROUP BY doc_id) USING (doc_id)
)"""
_V = "(SELECT count(*) FROM dictionary)"


def _phi_of(source: str, name: str) -> str:
    return f"""{name} AS (
    SELECT g.word_id, g.topic, coalesce(wk.n, 0) AS n, coalesce(k.n, 0) + {lda.BETA}::DOUBLE * {_V} AS d, (coalesce(wk.n, 0) + {lda.BETA}::DOUBLE) / (coalesce(k.n, 0) + {lda.BETA}::DOUBLE * {_V}) AS phi
    FROM (SELECT word_id, t::INT AS topic FROM dictionary, range({N_TOPICS}) r(t)) g
    LEFT JOIN (SELECT word_id, topic, count(*) AS n FROM {source} GROUP BY ALL) wk ON wk.word_id = g.word_id AND wk.topic = g.topic
    LEFT JOIN (SELECT topic, count(*) AS n FROM {source} GROUP BY ALL) k ON k.topic = g.topic
)"""


PHI = f"{ONCE}, {_phi_of('c', 'p')}"
# logarithms are added in order of the counts, so that equal counts give equal scores
SCORES = f"""{PHI}, totals AS (
    SELECT list_reduce(list_prepend(0.0::DOUBLE, list(ln(d) ORDER BY topic)), lambda s, x: s + x) AS logs FROM (SELECT DISTINCT topic, d FROM p)
), means AS (
    SELECT word_id, (list_reduce(list_prepend(0.0::DOUBLE, list(ln(n + {lda.BETA}::DOUBLE) ORDER BY n)), lambda s, x: s + x) - (SELECT logs FROM totals)) / {N_TOPICS} AS mean
    FROM p GROUP BY word_id
), scored AS (
    SELECT p.topic, token AS term, phi * (ln(phi) - mean) AS score FROM p JOIN means USING (word_id) JOIN dictionary USING (word_id)
)"""
RANKED = f"""{SCORES}, ranked AS (
    SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term DESC)::INT AS rank, term, round(score, 8) + 0.0::DOUBLE AS score FROM scored
)"""
GRID = f"""{ONCE}, n_dk AS (SELECT doc_id, topic, count(*) AS n FROM c GROUP BY ALL), grid AS (
    SELECT i.doc_id, t::INT AS topic, coalesce(n, 0) AS n FROM (SELECT doc_id FROM doc_index) i CROSS JOIN range({N_TOPICS}) r(t)
    LEFT JOIN n_dk ON n_dk.doc_id = i.doc_id AND n_dk.topic = t
)"""


def _bits(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def _drawn(n: int) -> str:
    return f"drawn AS (SELECT doc_id, pos, word_id, ({_bits("'7:' || doc_id || ':' || pos")} % {n})::INT AS topic FROM once)"


_A = f"{lda.FIRST_ALPHA}::DOUBLE"
_B = f"{lda.BETA}::DOUBLE"
CONDITIONAL = f"""{ONCE}, {_drawn(N_TOPICS)}, each AS (
    SELECT d.*, k::INT AS k, CASE WHEN k = topic THEN 1 ELSE 0 END AS own FROM drawn d, range({N_TOPICS}) r(k)
), p AS (
    SELECT e.doc_id, e.pos, e.word_id, e.k,
        (coalesce(dk.n, 0) - own + {_A}) * (coalesce(wk.n, 0) - own + {_B}) / (coalesce(tk.n, 0) - own + {_B} * {_V}) AS p
    FROM each e
    LEFT JOIN (SELECT doc_id, topic, count(*) AS n FROM drawn GROUP BY ALL) dk ON dk.doc_id = e.doc_id AND dk.topic = e.k
    LEFT JOIN (SELECT word_id, topic, count(*) AS n FROM drawn GROUP BY ALL) wk ON wk.word_id = e.word_id AND wk.topic = e.k
    LEFT JOIN (SELECT topic, count(*) AS n FROM drawn GROUP BY ALL) tk ON tk.topic = e.k
)"""

# one sweep, position by position: the tokens at position i of all documents are drawn from the counts that hold all draws before
KERNEL = rf"""WITH RECURSIVE raw AS (
    SELECT sample_id::BIGINT AS doc_id, {_blank("coalesce(text, '')")} AS t FROM reading_samples
), listed AS (
    SELECT doc_id, {_listed("t", " ", "string_split(t, ' ')")} AS l FROM raw
), tok AS MATERIALIZED (
    SELECT doc_id, token, pos, ({_bits("'5:' || doc_id || ':' || pos")} % {KERNEL_TOPICS})::INT AS z0,
        {_bits("'5:0:' || doc_id || ':0:' || pos")} / 4294967296.0::DOUBLE AS u
    FROM (SELECT doc_id, unnest(l) AS token, (generate_subscripts(l, 1) - 1)::INT AS pos FROM listed)
), size AS MATERIALIZED (SELECT count(DISTINCT token) AS v, max(pos) AS last FROM tok),
state(i, doc_id, pos, token, z) AS (
    SELECT 0, doc_id, pos, token, z0 FROM tok
    UNION ALL (
        WITH dk AS (SELECT doc_id, z, count(*) AS n FROM state GROUP BY ALL), wk AS (SELECT token, z, count(*) AS n FROM state GROUP BY ALL), tk AS (SELECT z, count(*) AS n FROM state GROUP BY ALL),
        each AS (SELECT s.doc_id, s.token, k::INT AS k, CASE WHEN k = s.z THEN 1 ELSE 0 END AS own FROM state s, range({KERNEL_TOPICS}) r(k) WHERE s.pos = s.i),
        p AS (
            SELECT e.doc_id, e.k, (coalesce(dk.n, 0) - own + {_A}) * (coalesce(wk.n, 0) - own + {_B}) / (coalesce(tk.n, 0) - own + {_B} * (SELECT v FROM size)) AS p
            FROM each e LEFT JOIN dk ON dk.doc_id = e.doc_id AND dk.z = e.k LEFT JOIN wk ON wk.token = e.token AND wk.z = e.k LEFT JOIN tk ON tk.z = e.k
        ), running AS (SELECT *, sum(p) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto, sum(p) OVER (PARTITION BY doc_id) AS s FROM p),
        fresh AS (
            SELECT r.doc_id, coalesce(min(CASE WHEN upto >= t.u * s THEN k END), {KERNEL_TOPICS - 1})::INT AS z
            FROM running r JOIN (SELECT DISTINCT i FROM state) x ON true JOIN tok t ON t.doc_id = r.doc_id AND t.pos = x.i GROUP BY r.doc_id
        )
        SELECT s.i + 1, s.doc_id, s.pos, s.token, CASE WHEN s.pos = s.i THEN f.z ELSE s.z END FROM state s LEFT JOIN fresh f USING (doc_id) WHERE s.i <= (SELECT last FROM size)
    )
) SELECT doc_id, pos, token, z AS topic FROM state WHERE i = (SELECT last FROM size) + 1"""


def _fine(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


# lengths from the cumulated Poisson probabilities, topics from the cumulated weights, words from the cumulated phi in order of their ids
GENERATED = f"""{PHI}, {LENGTHS.split("), ", 2)[2]}, mean AS (SELECT avg(n_tokens) AS m FROM lengths),
poisson AS (
    SELECT n, sum(exp(n * ln(m) - m - lgamma(n + 1))) OVER (ORDER BY n) AS upto
    FROM (SELECT m, unnest(range(greatest(0, floor(m - {SPREAD} * sqrt(m)))::BIGINT, ceil(m + {SPREAD} * sqrt(m))::BIGINT + {SPREAD} + 1)) AS n FROM mean)
), sized AS (
    SELECT d AS doc_id, coalesce((SELECT min(n) FROM poisson WHERE upto >= {_fine("'3:length:' || d")}), (SELECT max(n) FROM poisson)) AS n FROM range(1000) r(d)
), weight AS (SELECT k::INT AS topic, sum({_A}) OVER (ORDER BY k) AS upto FROM range({N_TOPICS}) r(k)
), token AS (
    SELECT doc_id, pos::INT AS pos, {_fine("'3:topic:' || doc_id || ':' || pos")} * (SELECT max(upto) FROM weight) AS x, {_fine("'3:word:' || doc_id || ':' || pos")} AS u
    FROM (SELECT doc_id, unnest(range(n)) AS pos FROM sized)
), topical AS (
    SELECT doc_id, pos, u, w.topic FROM token ASOF JOIN weight w ON token.x <= w.upto
), cumulated AS (
    SELECT topic, word_id, sum(phi) OVER (PARTITION BY topic ORDER BY word_id) AS upto, sum(phi) OVER (PARTITION BY topic) AS total FROM p
), total AS (SELECT topic, max(upto) AS total FROM cumulated GROUP BY topic
), generated AS (
    SELECT a.doc_id, a.pos, c.word_id FROM (SELECT t.*, u * total AS x FROM topical t JOIN total USING (topic)) a
    ASOF JOIN cumulated c ON a.topic = c.topic AND a.x <= c.upto
)"""
_ALPHA_STEP = f"""
    SELECT it + 1, list_transform(range({N_TOPICS}), lambda k: a[k + 1] * (
            list_sum(list_transform(range(len(hist[k + 1])), lambda j: hist[k + 1][j + 1] / (j + a[k + 1]))) + 1.001
        ) / (list_sum(list_transform(range(len(tail)), lambda j: tail[j + 1] / (j + list_sum(a)))) - 1.0))
    FROM steps, tails, hists WHERE it < 10"""
# documents with at least j tokens, j = 1 ...: each adds 1 / (j - 1 + a)
ALPHA = f"""
WITH RECURSIVE {LENGTHS}, n_dk AS (SELECT doc_id, topic, count(*) AS n FROM c GROUP BY ALL),
tails AS (SELECT list(n ORDER BY j) AS tail FROM (
    SELECT j, (SELECT count(*) FROM lengths WHERE n_tokens >= j)::DOUBLE AS n FROM range(1, (SELECT max(n_tokens) + 1 FROM lengths)) r(j))),
hists AS (SELECT list(h ORDER BY topic) AS hist FROM (
    SELECT topic, list(n ORDER BY j) AS h FROM (
        SELECT t AS topic, j, count(n_dk.n)::DOUBLE AS n
        FROM range({N_TOPICS}) r(t), range(1, (SELECT max(n) + 1 FROM n_dk)) s(j) LEFT JOIN n_dk ON n_dk.topic = t AND n_dk.n >= j
        GROUP BY t, j) GROUP BY topic)),
steps(it, a) AS (SELECT 0, list_transform(range({N_TOPICS}), lambda k: {_A}) UNION ALL {_ALPHA_STEP})
SELECT k::INT AS topic, round(a[k + 1], 8) AS alpha FROM steps, range({N_TOPICS}) r(k) WHERE it = 10"""

_S = lda.Schedule()
_SETTINGS = ", ".join(f"('{kind}', '{name}', {value}::DOUBLE)" for kind, bounds in (
    ("default", {"min_freq": 10, "max_share": 0.9, "min_docs": 5, "min_length": 3}),
    ("all", {"max_freq": 1000000, "min_freq": 10, "max_share": 0.9, "min_share": 0.01, "max_docs": 100000, "min_docs": 5, "max_length": 50, "min_length": 3}),
) for name, value in bounds.items())

ORACLE = {
    "clean_lower": _clean(_lower("text")),
    "clean_urls": _clean(_urls("'see:http://a.example/x?y=1 ' || text || ' at https://b.example/'")),
    "clean_punct": _clean(_punct("text")),
    "clean_chars": _clean(_chars("text")),
    "clean_numbers": _clean(_numbers(_chars("text"))),
    "clean_whitespace": _clean(_blank("text")),
    "clean_default": _clean(_default("text")),
    "clean_custom": _clean(f"replace({_blank('lower(text)')}, 'topic', 'theme')"),
    "clean_python": _clean(_punct("replace(lower(text), 'topic', 'theme')")),
    "scan_text": rf"""WITH {DOCS}, lines AS (SELECT doc_id, string_split_regex(text || chr(10), '\r\n|\r|\n') AS l FROM docs),
each AS (SELECT doc_id, unnest(l[1:-2]) AS text, generate_subscripts(l[1:-2], 1) AS k FROM lines)
SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS doc_id, text FROM each""",
    "scan_charset": rf"""WITH {DOCS} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id,
'> ' || regexp_replace(regexp_replace(text, '[\x00-\x1f]+', ' ', 'g'), '[^\x{{00}}-\x{{ff}}]', '?', 'g') AS text FROM docs""",
    "scan_texts": f"""WITH listed AS (SELECT row_number() OVER (ORDER BY sample_id) - 1 AS doc_id, {_listed("t", " ", "string_split(t, ' ')")} AS l FROM (SELECT sample_id, {_blank("coalesce(text, '')")} AS t FROM reading_samples))
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS token FROM listed""",
    "filter_settings": f"SELECT * FROM (VALUES {_SETTINGS}) v(kind, bound, value)",
    "nothing_left": f"WITH {TOKENS} SELECT count(*) = 0 AS refused FROM tokenised WHERE length(token) >= 1000000",
    "tokenise": _tokenise(" ", "string_split(text, ' ')"),
    "tokenise_delim": _tokenise("[,;]+", "string_split_regex(text, '[,;]+')"),
    "explode_tokens": f"WITH {TOKENS} SELECT doc_id, pos, token FROM tokenised",
    "detokenise": f"WITH {TOKENS} SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM tokenised GROUP BY doc_id",
    "stopwords_table": f"SELECT * FROM {_values(default_stopwords())} v(token)",
    "stopwords_removed": f"WITH {UNSTOPPED} SELECT doc_id, pos, token FROM unstopped",
    "stopwords_custom": f"WITH {TOKENS} SELECT doc_id, pos, token FROM tokenised WHERE token NOT IN (SELECT * FROM {_values(CUSTOM_STOPWORDS)})",
    "empty_docs": f"WITH {UNSTOPPED} SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM unstopped WHERE token <> '')",
    **{name: f"WITH {_filtered(bounds)} SELECT doc_id, pos, token FROM kept" for name, bounds in FILTERS.items()},
    "preprocess_default": f"WITH {_filtered(_DEFAULT)} SELECT doc_id, pos, token FROM kept",
    "preprocess_noop": f"""WITH {DOCS}, listed AS (SELECT doc_id, {_listed("t", " ", "string_split(t, ' ')")} AS l FROM (SELECT doc_id, {_blank("text")} AS t FROM docs))
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS token FROM listed""",
    "kept_total": f"WITH {_filtered(_DEFAULT)} SELECT (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM unstopped) AS total",
    "term_freq": f"WITH {STATS} SELECT token, freq FROM stats",
    "doc_freq": f"WITH {STATS} SELECT token, doc_freq FROM stats",
    "dictionary": f"""WITH {_filtered(_DEFAULT)}, first AS (SELECT token, min((doc_id, pos)) AS f, count(*) AS freq FROM kept GROUP BY token)
SELECT (row_number() OVER (ORDER BY f) - 1)::INT AS word_id, token, freq FROM first""",
    "doc_ordinal": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents",
    "encode_corpus": "SELECT doc_id, pos, word_id FROM (SELECT doc_id, pos, min(token) AS token FROM tokens WHERE token <> '' GROUP BY ALL) JOIN dictionary USING (token)",
    "decode_corpus": f"WITH {ONCE} SELECT doc_id, pos, token FROM once JOIN dictionary USING (word_id)",
    "dict_contains": f"WITH {TOKENS} SELECT doc_id, pos, token FROM tokenised WHERE token IN (SELECT token FROM dictionary)",
    "dict_lookup": f"WITH {STATS} SELECT token, word_id FROM stats LEFT JOIN dictionary USING (token)",
    "corpus_scalars": f"WITH {ONCE} SELECT (SELECT count(*) FROM doc_index) AS n_docs, {_V} AS n_words, (SELECT count(*) FROM once) AS n_tokens",
    "doc_lengths": f"WITH {LENGTHS} SELECT doc_id, n_tokens FROM lengths",
    "topic_counts": f"WITH {ONCE} SELECT topic, count(*) AS n FROM c GROUP BY topic",
    "word_topic_counts": f"WITH {ONCE} SELECT word_id, topic, count(*) AS n FROM c GROUP BY ALL",
    "doc_topic_counts": f"WITH {ONCE} SELECT doc_id, topic, count(*) AS n FROM c GROUP BY ALL",
    "count_grouping_sets": f"""WITH {ONCE} SELECT CASE grouping(doc_id, word_id, topic) WHEN 3 THEN 'doc' WHEN 6 THEN 'topic' WHEN 4 THEN 'word_topic' ELSE 'doc_topic' END AS kind,
doc_id, word_id, topic, count(*) AS n FROM c GROUP BY GROUPING SETS ((doc_id), (topic), (word_id, topic), (doc_id, topic))""",
    "max_doc_length": f"WITH {LENGTHS} SELECT coalesce(max(n_tokens), -1) + 1 AS max_length FROM lengths",
    "mean_doc_length": f"WITH {LENGTHS} SELECT round(coalesce(avg(n_tokens), 0), 6) AS mean_length FROM lengths",
    "doc_length_hist": f"WITH {LENGTHS} SELECT n_tokens, count(*) AS n_docs FROM lengths GROUP BY n_tokens",
    "doc_topic_hist": f"WITH {GRID} SELECT topic, n, count(*) AS n_docs FROM grid GROUP BY topic, n",
    "topic_max_count": f"WITH {GRID} SELECT topic, max(n) AS max_count FROM grid GROUP BY topic",
    "phi": f"WITH {PHI} SELECT word_id, topic, round(phi, 10) AS phi FROM p",
    "theta": f"WITH {GRID} SELECT doc_id, topic, round((n + {_A}) / (sum(n) OVER (PARTITION BY doc_id) + {_A} * {N_TOPICS}), 10) AS theta FROM grid",
    "geometric_mean": f"WITH {PHI} SELECT word_id, round(exp(avg(ln(phi))), 10) AS geomean FROM p GROUP BY word_id",
    "phi_column_sum": f"WITH {PHI} SELECT topic, round(sum(phi), 6) AS phi_sum FROM p GROUP BY topic",
    "phi_column": f"WITH {PHI} SELECT word_id, round(phi, 10) AS phi FROM p WHERE topic = 7",
    "term_score": f"WITH {SCORES} SELECT topic, term, round(score, 8) + 0.0::DOUBLE AS score FROM scored",
    "top_terms": f"WITH {RANKED} SELECT * FROM ranked WHERE rank <= 10",
    "top_terms_all": f"WITH {RANKED} SELECT * FROM ranked",
    "topic_words": f"WITH {RANKED} SELECT topic, string_agg(term, '|' ORDER BY rank) AS words FROM ranked WHERE rank <= 10 GROUP BY topic",
    "topic_display": f"WITH {RANKED} SELECT topic, topic || ' : [' || string_agg(format('{{}} : {{:.3f}}', term, score), ', ' ORDER BY rank) || ']' AS display FROM ranked WHERE rank <= 10 GROUP BY topic",
    "perplexity": f"""WITH {ONCE}
SELECT round(exp(-avg(ln((wk.n + {_B}) / (k.n + {_B} * {_V}) * (dk.n + {_A}) / (d.n + {_A} * {N_TOPICS})))), 4) AS perplexity FROM c
JOIN (SELECT word_id, topic, count(*) AS n FROM c GROUP BY ALL) wk USING (word_id, topic)
JOIN (SELECT doc_id, topic, count(*) AS n FROM c GROUP BY ALL) dk USING (doc_id, topic)
JOIN (SELECT topic, count(*) AS n FROM c GROUP BY ALL) k USING (topic)
JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY ALL) d USING (doc_id)""",
    "phi_accumulate": f"""WITH {PHI}, {_drawn(N_TOPICS)}, {_phi_of("drawn", "q")}
SELECT word_id, topic, round(sum(phi), 10) AS phi_sum, count(*)::INT AS samples FROM (SELECT word_id, topic, phi FROM p UNION ALL SELECT word_id, topic, phi FROM q) GROUP BY word_id, topic""",
    "reload_sums": """SELECT run_id, topic, word_id, phi * samples AS phi_sum
FROM (SELECT DISTINCT * FROM phi WHERE phi IS NOT NULL AND NOT isnan(phi)) JOIN (SELECT run_id, samples FROM models WHERE samples > 0) USING (run_id)""",
    "init_topics": f"WITH {ONCE}, {_drawn(N_TOPICS)} SELECT * FROM drawn",
    "gibbs_conditional": f"WITH {CONDITIONAL} SELECT doc_id, pos, string_agg(round(p * 1e12::DOUBLE)::BIGINT, '|' ORDER BY k) AS weights FROM p GROUP BY doc_id, pos",
    "gibbs_sweep": f"""WITH {CONDITIONAL}, running AS (
    SELECT *, sum(p) OVER (PARTITION BY doc_id, pos ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto, sum(p) OVER (PARTITION BY doc_id, pos) AS s,
        {_bits("'7:1:' || doc_id || ':' || pos")} / 4294967296.0::DOUBLE AS u FROM p
) SELECT doc_id, pos, word_id, coalesce(min(CASE WHEN upto >= u * s THEN k END), {N_TOPICS - 1})::INT AS topic FROM running GROUP BY doc_id, pos, word_id""",
    "multinomial_draw": f"""WITH {ONCE}, running AS (
    SELECT doc_id, topic, sum(n + 0.5::DOUBLE) OVER (PARTITION BY doc_id ORDER BY topic) AS upto, sum(n + 0.5::DOUBLE) OVER (PARTITION BY doc_id) AS s,
        {_bits("'11:' || doc_id")} / 4294967296.0::DOUBLE AS u FROM (SELECT doc_id, topic, count(*) AS n FROM c GROUP BY ALL)
) SELECT doc_id, coalesce(min(CASE WHEN upto >= u * s THEN topic END), max(topic)) AS topic FROM running GROUP BY doc_id""",
    "gibbs_kernel": KERNEL,
    "generate_ids": f"WITH {GENERATED} SELECT doc_id, pos, word_id FROM generated",
    "generate_text": f"""WITH {GENERATED} SELECT d AS doc_id, coalesce(text, '') AS text FROM range(1000) r(d)
LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM generated JOIN dictionary USING (word_id) GROUP BY doc_id) g ON g.doc_id = d""",
    "score_equality": "SELECT term, score, count(*) AS n_rows FROM term_scores GROUP BY term, score HAVING count(*) > 1",
    "alpha_iteration": ALPHA,
    "alpha_summary": f"SELECT count(*) AS n_topics, round(sum(alpha), 6) AS alpha_sum, bool_or(alpha < 0) AS any_negative FROM ({ALPHA})",
    "train_cycles": f"""SELECT c::INT AS cycle, CASE WHEN c < {_SHORT.burn_in} THEN 'burn-in' WHEN c % {_SHORT.sample_lag} = 0 THEN 'sampling'
WHEN c % {_SHORT.optimise_lag} = 0 THEN 'optimising' ELSE 'sample-lagging' END AS kind, c % {_SHORT.perplexity_lag} = 0 AS checked, true AS timed FROM range({_CYCLES}) r(c)""",
    "train_resumed": f"WITH {_filtered(_DEFAULT)} SELECT count(*) AS tokens, count(*) AS same_topic, true AS same_model FROM kept",
    "model_summary": f"""WITH {_filtered(_DEFAULT)} SELECT (SELECT count(*) FROM docs) AS n_docs, count(DISTINCT token) AS n_words, count(*) AS n_tokens,
{FEW_TOPICS} AS n_topics, {_B} AS beta, round({_A} * {FEW_TOPICS}, 8) AS alpha_sum, 0 AS samples, 0 AS cycles, round(count(*) / (SELECT count(*) FROM docs), 6) AS mean_length FROM kept""",
    "cycle_schedule": f"""SELECT c AS cycle, CASE WHEN c < {_S.burn_in} THEN 'burn-in' WHEN c % {_S.sample_lag} = 0 THEN 'sampling'
WHEN c % {_S.optimise_lag} = 0 THEN 'optimising' ELSE 'sample-lagging' END AS kind, c >= {_S.burn_in} AND c % {_S.optimise_lag} = 0 AS optimises,
c >= {_S.burn_in} AND c % {_S.sample_lag} = 0 AS samples, c % {_S.perplexity_lag} = 0 AS checks FROM range(1000) r(c)""",
}
