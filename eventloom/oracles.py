"""DuckDB SQL for the driver queries: the same rows by another engine and another formulation."""

from __future__ import annotations

from .adapters import QUERY
from .functions.lexicons import LOCAL_MARKERS, NON_EVENT_WORDS, QUESTION_WORDS, RELATIONS, STOPWORDS
from .queries import GRAPH_ANSWER, PROSE_LEXICON, SHAPES

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
MAX_EVENTS = 16


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[A-Za-z0-9'']+')"


def content(x: str) -> str:
    return f"list_filter({toks(x)}, lambda w: NOT list_contains({STOP}, w))"


def token_set(x: str) -> str:
    return f"list_distinct({content(x)})"


def jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {both} / CAST(len({a}) + len({b}) - {both} AS DOUBLE) ELSE 0e0 END)"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def compact(x: str, n: int) -> str:
    return f"(CASE WHEN length({collapse(x)}) <= {n} THEN {collapse(x)} ELSE rtrim(substr({collapse(x)}, 1, {n - 3})) || '...' END)"


def sentences(x: str) -> str:
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"list_filter(list_transform(string_split(regexp_replace(trim({x}, {blank}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {blank})), lambda s: s <> '')"


def mark(seed: int, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


def drawn(seed: int, *keys: str) -> str:
    """Uniform in [0, 1) from keys."""
    return f"(CAST('0x' || substr({mark(seed, *keys)}, 1, 8) AS BIGINT) / 4294967296e0)"


def between(k: int, low: str, high: str, *keys: str) -> str:
    return f"({low} + ({high} - {low}) * {drawn(7 + k, 'sample_id', *keys)})"


def coin(k: int, *keys: str) -> str:
    return f"CASE WHEN {drawn(7 + k, 'sample_id', *keys)} < 5e-1 THEN 0e0 ELSE 1e0 END"


SYNTHETIC = f"""
z AS (SELECT c_custkey AS sample_id, 4 + CAST(floor({drawn(7, "c_custkey")} * 5) AS INTEGER) AS n FROM customer),
sizes AS (SELECT sample_id, n, least(n - 1 + CAST(floor({drawn(8, "sample_id")} * (least(2 * n, 12) - n + 2)) AS INTEGER), n * (n - 1) // 2) AS m FROM z),
places AS (SELECT sample_id, n, m, unnest(range(n)) AS ord FROM sizes),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY -ln({drawn(27, "sample_id", "s", "t")} + 1e-12) * (n - 1 - s), s, t) - 1 AS ord
    FROM (SELECT a.sample_id, a.n, a.m, a.ord AS s, b.ord AS t FROM places a JOIN places b ON a.sample_id = b.sample_id AND a.ord < b.ord)) WHERE ord < m)"""

QT = token_set("'" + QUERY + "'")

NODES = f"""
ev0 AS (SELECT user_id AS sample_id, 'e' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS event_id, event_id AS ord, ts, event_type AS trig,
    'u' || user_id || 'w' || CAST(floor((dayofyear(ts) - 1) / 7) AS INTEGER) AS document_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
    value / 5e2 AS confidence, strftime(ts, '%Y-%m-%d') AS publish_time FROM events),
nodes AS (SELECT *, row_number() OVER (PARTITION BY sample_id, document_id ORDER BY ts, ord) - 1 AS sentence_index, 'p' || (k % 7) AS participant,
    'trigger=' || trig || '; mention=' || trig || ' item ' || k AS text FROM ev0),
ev1 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY confidence DESC, sentence_index, event_id) AS rn FROM nodes),
evall AS (SELECT *, {token_set("text")} AS tokens, array_to_string({content("text")}, ' ') AS norm, {jac(QT, token_set("text"))} AS qo FROM ev1),
ev AS (SELECT * FROM evall WHERE rn <= {MAX_EVENTS})"""

REL = """(CASE WHEN s.trig = 'purchase' OR t.trig = 'purchase' THEN 'mitigates' WHEN s.trig = 'error' OR t.trig = 'error' THEN 'escalates' ELSE 'precedes' END)"""

PAIRS = f"""
p0 AS (SELECT s.sample_id, s.event_id AS source, t.event_id AS target, s.ord AS so, t.ord AS too, {REL} AS rel,
    CASE WHEN s.document_id = t.document_id THEN 35e-2 ELSE 0e0 END + 25e-2 / (1 + abs(s.sentence_index - t.sentence_index)) + 2e-1 * {jac("s.tokens", "t.tokens")}
        + 1e-1 * (CASE WHEN s.participant = t.participant THEN 1 ELSE 0 END / 3e0) + 1e-1 * ((s.qo + t.qo) / 2) AS candidate_score
    FROM ev s JOIN ev t ON s.sample_id = t.sample_id AND s.event_id <> t.event_id
    WHERE (s.document_id = t.document_id AND abs(s.sentence_index - t.sentence_index) <= 3)
        OR (s.document_id <> t.document_id AND (s.participant = t.participant OR {jac("s.tokens", "t.tokens")} >= 12e-2))),
pairs0 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY candidate_score DESC, so, too) AS pair_rank FROM p0),
pairs AS (SELECT * FROM pairs0 WHERE pair_rank <= 64),
predicted AS (SELECT sample_id, 'pred_edge_' || (pair_rank - 1) AS edge_id, source, target, rel AS relation_type, round(candidate_score, 4) AS score FROM pairs WHERE round(candidate_score, 4) >= 6e-1)"""

COARSE = f"""
c0 AS (SELECT s.sample_id, s.event_id AS source, t.event_id AS target, s.ord AS so, t.ord AS too, {REL} AS relation_type,
    CASE WHEN s.document_id = t.document_id THEN CASE WHEN s.sentence_index < t.sentence_index THEN 9e-1 ELSE 0e0 END
        WHEN s.publish_time <= t.publish_time THEN 55e-2 ELSE 3e-1 END AS tmp,
    CASE WHEN s.participant = t.participant THEN 1e0 ELSE 0e0 END AS ent, {jac("s.tokens", "t.tokens")} AS lex, (s.qo + t.qo) / 2 AS qa
    FROM ev s JOIN ev t ON s.sample_id = t.sample_id AND s.event_id <> t.event_id),
c1 AS (SELECT *, round(least(34e-2 * tmp + 22e-2 * ent + 18e-2 * lex + 16e-2 * 0e0 + 1e-1 * qa, 99e-2), 4) AS score FROM c0 WHERE tmp > 0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, so, too) AS pair_rank FROM c1 WHERE score >= 5e-1),
coarse AS (SELECT * FROM c2 WHERE pair_rank <= 40)"""

TEMPORAL = """
n0 AS (SELECT sample_id, document_id, sentence_index, ord, event_id AS source, lead(event_id) OVER (PARTITION BY sample_id, document_id ORDER BY sentence_index, ord) AS target FROM ev),
temporal AS (SELECT sample_id, 'edge' || (row_number() OVER (PARTITION BY sample_id ORDER BY document_id, sentence_index, ord) - 1) AS edge_id, source, target, 'precedes' AS relation_type, 55e-2 AS score,
    row_number() OVER (PARTITION BY sample_id ORDER BY document_id, sentence_index, ord) - 1 AS ord FROM n0 WHERE target IS NOT NULL)"""

ALL_TEMPORAL = TEMPORAL.replace("FROM ev)", "FROM evall)")

ENDS = "ends AS (SELECT sample_id, source AS event_id, 1 AS o FROM coarse UNION ALL SELECT sample_id, target, 0 FROM coarse)"
DEGREES = f"{ENDS}, deg AS (SELECT sample_id, event_id, count(ends.o) FILTER (ends.o = 1) AS out_degree, count(ends.o) FILTER (ends.o = 0) AS in_degree, count(ends.o) AS degree FROM evall LEFT JOIN ends USING (sample_id, event_id) GROUP BY 1, 2)"

FIRST = """firsts AS (SELECT sample_id, event_id, min(p) AS place FROM (SELECT sample_id, source AS event_id, 2 * pair_rank AS p FROM coarse UNION ALL SELECT sample_id, target, 2 * pair_rank + 1 FROM coarse) GROUP BY 1, 2),
kept AS (SELECT * FROM (SELECT ev.sample_id, ev.event_id, row_number() OVER (PARTITION BY ev.sample_id ORDER BY place ASC NULLS LAST, degree DESC, confidence DESC, sentence_index, ev.event_id) AS n
    FROM ev JOIN deg USING (sample_id, event_id) LEFT JOIN firsts USING (sample_id, event_id)) WHERE n <= 8)"""

DAYS = "epoch(CAST(publish_time AS TIMESTAMP)) / 864e2"
CUT = "epoch(TIMESTAMP '2024-01-20') / 864e2"
CLIP = "least(greatest({}, -365e0), 365e0)"
TIMES = f"""anchors AS (SELECT sample_id, least(min({DAYS}), {CUT}) AS anchor FROM evall GROUP BY 1),
timed AS (SELECT evall.*, {CLIP.format(f"({DAYS} - anchor) / 3e1")} AS event_time, 1e0 AS time_valid, {CLIP.format(f"({CUT} - anchor) / 3e1")} AS cutoff_value, 1e0 AS cutoff_valid FROM evall JOIN anchors USING (sample_id))"""


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} <> 0 THEN ({a}) / CAST({b} AS DOUBLE) ELSE 0e0 END)"


def prf(tp: str, fp: str, fn: str) -> str:
    p, r = ratio(tp, f"({tp} + {fp})"), ratio(tp, f"({tp} + {fn})")
    return f"{p} AS precision, {r} AS recall, (CASE WHEN {p} + {r} <> 0 THEN (2 * {p} * {r}) / ({p} + {r}) ELSE 0e0 END) AS f1"


LABELS = "rows AS (SELECT ['none', 'precedes', 'causes', 'escalates', 'mitigates'][quality * 2 + toxic + 1] AS gold, ['none', 'precedes', 'causes', 'escalates', 'mitigates'][doc_id % 3 + 1] AS predicted FROM labels)"
REPORT = f"""names AS (SELECT gold AS label FROM rows UNION SELECT predicted FROM rows),
counted AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (gold <> label AND predicted = label) AS fp, count(*) FILTER (gold = label AND predicted <> label) AS fn FROM names, rows GROUP BY 1),
report AS (SELECT label, {prf("tp", "fp", "fn")}, tp + fn AS support FROM counted)"""
MET = "met AS (SELECT {k}, g.sample_id IS NOT NULL AS g, p.sample_id IS NOT NULL AS p FROM (SELECT DISTINCT {k} FROM temporal) g FULL JOIN (SELECT DISTINCT {k} FROM predicted) p USING ({k}))"
K3, K4 = "sample_id, source, target", "sample_id, source, target, relation_type"
SUMS = "count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn"
TITLE = r"string_split_regex(string_split(text, chr(10))[1], '[.!?]')[1]"
COMPLETION = f"""cv AS (SELECT ev.*, list_filter(list_distinct(string_split(norm, ' ')), lambda w: w <> '') AS nt FROM ev), cw AS (SELECT list_distinct(string_split(lower('{QUERY}'), ' ')) AS q),
cc AS (SELECT cv.*, len(list_intersect(q, nt)) / CAST(len(q) AS DOUBLE) AS cover FROM cv, cw),
everypair AS (SELECT s.sample_id, s.event_id AS source, t.event_id AS target, s.ord AS so, t.ord AS too, s.document_id = t.document_id OR s.participant = t.participant AS fit,
    CASE WHEN s.document_id = t.document_id THEN 25e-2 ELSE 0e0 END + 2e-1 / (1 + abs(s.sentence_index - t.sentence_index)) + 2e-1 * {jac("s.nt", "t.nt")} + 15e-2 * (CASE WHEN s.participant = t.participant THEN 1 ELSE 0 END / 3e0)
    + 1e-1 * ((s.cover + t.cover) / 2) + 1e-1 * (CASE WHEN t.sentence_index >= s.sentence_index THEN 1e0 ELSE 5e-1 END) AS completion_score
    FROM cc s JOIN cc t ON s.sample_id = t.sample_id AND s.event_id <> t.event_id),
completion AS (SELECT * FROM everypair WHERE fit)"""
NEWS = f"news AS (SELECT doc_id AS document_id, {TITLE} AS title, text FROM documents WHERE text IS NOT NULL)"

# answers of models: what each shape (sample_id % 6) comes to

IDS = "ids AS (SELECT sample_id, sample_id % 6 AS k, lpad(CAST(sample_id % 20 AS VARCHAR), 3, '0') AS code, list_sort(list(event_id))[1] AS a, list_sort(list(event_id))[2] AS b, count(*) AS n FROM nodes GROUP BY 1)"


def by_shape(*values: str) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def said_length(shape: int) -> int:
    """Characters of an answer: event ids have 10, codes 3."""
    text = SHAPES[shape]
    return len(text) + 8 * (text.count("$1") + text.count("$2")) + text.count("$c")


CODE = "(CASE WHEN k = 4 THEN '003' ELSE code END)"
KNOWN_CODE = "(CASE WHEN code IN ('003', '007') THEN 1 ELSE 0 END)"
TOLD = f"""told AS (SELECT sample_id, k NOT IN (2, 3) AS parsed_json, {CODE} AS event_code, CASE {CODE} WHEN '003' THEN 'C001' WHEN '007' THEN 'C002' ELSE '' END AS choice_id,
    CASE WHEN k = 4 OR (k = 1 AND code <> '007') THEN '007' ELSE '' END AS alternatives, CAST({by_shape("2", "0", "0", "0", "2", "5")} AS BIGINT) AS n_events, CAST({by_shape("1", "0", "0", "0", "2", "1")} AS BIGINT) AS n_edges,
    {by_shape("a || '|nothing|' || b || '|' || b || '|' || a || '|nothing'", "a || '|' || a", "''", "''", "'H01|' || b || '|H01|' || b", "''")} AS event_refs, CASE k WHEN 4 THEN 'R01' ELSE '' END AS edge_refs,
    {by_shape("b || '|' || a || '|nothing'", "a", "''", "''", "'H01|' || b", "''")} AS support_ids, k = 4 AS abstain,
    {by_shape("'users return to the item; tensions rise'", "'it sells'", "''", "''", "'crowds gather near the square; a plain text event'", "'late news; late news; late news; late news; late news'")} AS forecast_event,
    {by_shape("1e0", "5e-1", "0e0", "0e0", "3e-1", "0e0")} AS confidence, CASE k WHEN 1 THEN 'so' ELSE '' END AS rationale, {by_shape("'ft_1'", "''", "''", "''", "'ft_9'", "'ft_1'")} AS first_id,
    CASE k WHEN 4 THEN 'A|B' ELSE '' END AS actors, {by_shape("'t-2'", "''", "''", "''", "'before t'", "''")} AS relative_time FROM ids)"""
REWARDS = f"""linked AS (SELECT sample_id, count(*) AS edges FROM coarse GROUP BY 1),
parts AS (SELECT sample_id, n, k, coalesce(edges, 0) AS edges, CASE WHEN k = 4 OR {KNOWN_CODE} = 1 THEN 1e0 WHEN k = 1 THEN 5e-1 ELSE 0e0 END AS answer,
    (CASE WHEN k IN (2, 3) THEN 5e-1 ELSE 75e-2 END) + 25e-2 * (CASE WHEN k = 4 THEN 1 ELSE {KNOWN_CODE} END) AS form, {by_shape("4 / 6e0", "1e0", "0e0", "0e0", "1e0", "0e0")} AS events_ok,
    CASE WHEN k = 4 AND edges > 0 THEN 1e0 ELSE 0e0 END AS edges_ok, {by_shape("5e-1", "0e0", "0e0", "0e0", "4e-1", "0e0")} AS temporal, {by_shape("8e-1", "0e0", "0e0", "0e0", "25e-2", "9e-1")} AS bridge,
    {by_shape("5e-1", "1e0", "1e0", "1e0", "0e0", "1e0")} AS generic, CASE k WHEN 5 THEN 5e-1 ELSE 0e0 END AS density FROM ids LEFT JOIN linked USING (sample_id)),
sums AS (SELECT *, 2e-1 * form + 2e-1 * (65e-2 * events_ok + 35e-2 * edges_ok) + 2e-1 * temporal + 3e-1 * bridge - 15e-2 * generic - 15e-2 * density AS trace FROM parts),
rewards AS (SELECT *, round(answer + CASE WHEN answer <= 0 THEN least(trace, 2e-1) ELSE trace END, 6) AS total FROM sums)"""
GRAPH_ROWS = [
    ("a", "b", "causes", "7e-1", "so it is", None), ("a", "'zz'", "causes", "5e-1", "", "unknown event"), ("a", "a", "causes", "5e-1", "", "self-loop"), ("b", "a", "escalates", "5e-1", "", "unknown relation"),
    ("a", "b", "causes", "1e0", "", "repeated edge"), ("''", "''", "", "5e-1", "", "no object"), ("b", "a", "precedes", "5e-1", "", None), ("a", "b", "precedes", "5e-1", "", None),
]
assert GRAPH_ANSWER.count("relation_type") == len(GRAPH_ROWS) - 1

# documents to events


def norm(x: str) -> str:
    return f"array_to_string({content(x)}, ' ')"


def words_in(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def stem(w: str) -> str:
    cuts = " ".join(f"WHEN ends_with({w}, '{x}') AND length({w}) > {n} THEN left({w}, length({w}) - {len(x)})" for x, n in (("ing", 5), ("ed", 4), ("es", 4), ("s", 3)))
    return f"(CASE {cuts} ELSE {w} END)"


def first_of(words: list[str]) -> str:
    free, lexicon = words_in([*STOPWORDS, *QUESTION_WORDS, *NON_EVENT_WORDS]), words_in(words)
    fits = f"NOT list_contains({free}, w) AND NOT list_contains({free}, {stem('w')}) AND (list_contains({lexicon}, w) OR list_contains({lexicon}, {stem('w')}))"
    return f"list_transform(list_filter(tk, lambda w: {fits}), lambda w: {stem('w')})[1]"


CLAUSE_BREAK = r"(?i)\s*(?:,?\s+(?:and|but|while|after|because|since|as|which|who|that)\s+|[;:])\s*"
ENTITIES = r"list_filter(regexp_extract_all(regexp_replace(clause, '[^\x00-\x7F]', '_', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'), lambda w: lower(w) NOT IN ('as', 'how', 'what', 'when', 'where', 'which', 'who', 'why'))"
HINTS = words_in([*PROSE_LEXICON.verbs, *PROSE_LEXICON.nouns])


def first_six(e: str) -> str:
    return f"array_to_string(list_transform(list_sort(list_transform(list_distinct({e}), lambda x: [CAST(lpad(CAST(list_position({e}, x) AS VARCHAR), 9, '0') AS VARCHAR), x]))[1:6], lambda y: y[2]), '|')"


HITS = f"""hd AS (SELECT document_id, title, text, {token_set("title")} AS tt, {token_set("text")} AS bt FROM news), hq AS (SELECT item_id AS query_id, text AS query, {token_set("text")} AS qt FROM benchmark),
hm AS (SELECT query_id, qt, document_id, title, text, 14e-1 * {jac("qt", "tt")} + {jac("qt", "bt")} AS score FROM hq, hd),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM hm WHERE score > 0) WHERE rank <= 6)"""
FOUND = f"""fs AS (SELECT query_id, qt, document_id, rank, unnest(range(len(ss))) AS sentence_index, unnest(ss) AS sentence FROM (SELECT *, [{collapse("title")}] || {sentences("text")} AS ss FROM hits)),
fp AS (SELECT *, list_filter(list_transform(string_split_regex(sentence, '{CLAUSE_BREAK}'), lambda c: trim(c, ' ,.-')), lambda c: length(c) >= 12) AS k FROM fs WHERE sentence <> ''),
fk AS (SELECT * EXCLUDE (k), CASE WHEN len(k) > 0 THEN k WHEN length(trim(sentence, ' ,.-')) > 0 THEN [trim(sentence, ' ,.-')] ELSE [] END AS k FROM fp),
fc AS (SELECT * EXCLUDE (k), unnest(range(len(k))) AS ci, unnest(k) AS clause FROM fk),
fd AS (SELECT *, {norm("clause")} AS nt, {toks("clause")} AS tk, {token_set("clause")} AS cs FROM fc),
fe AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, sentence_index, nt ORDER BY ci) AS rn FROM fd),
ft AS (SELECT *, coalesce({first_of(PROSE_LEXICON.verbs)}, {first_of(PROSE_LEXICON.nouns)}) AS trig, {ENTITIES} AS ents FROM fe WHERE rn = 1),
fx AS (SELECT *, {jac("qt", "cs")} + 18e-2 + CASE WHEN len(ents) > 0 THEN 1e-1 ELSE 0e0 END + CASE WHEN len(list_filter(tk, lambda w: list_contains({HINTS}, w) OR list_contains({HINTS}, {stem("w")}))) > 0 THEN 18e-2 ELSE 0e0 END
    + CASE WHEN sentence_index = 0 THEN 15e-2 ELSE 0e0 END - CASE WHEN len(tk) > 26 THEN 8e-2 ELSE 0e0 END AS raw FROM ft WHERE trig IS NOT NULL),
found AS (SELECT *, round(least(raw, 98e-2), 4) AS fscore FROM fx WHERE raw >= 24e-2)"""
LOCAL = f"""lr AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY fscore DESC, sentence_index, ci) AS er FROM found),
local AS (SELECT query_id AS sample_id, document_id, rank, sentence_index, clause, trig, fscore, {first_six("ents")} AS participants, row_number() OVER (PARTITION BY query_id ORDER BY rank, er) - 1 AS ord,
    'trigger=' || trig || '; mention=' || {compact("clause", 180)} AS text FROM lr WHERE er <= 4)"""
NEXT = f"""ln AS (SELECT sample_id, rank, sentence_index, ord, 'e' || ord AS source, 'e' || lead(ord) OVER w AS target, lower(text || ' ' || lead(text) OVER w) AS ahead FROM local WINDOW w AS (PARTITION BY sample_id, document_id ORDER BY sentence_index, ord)),
le AS (SELECT *, 0 AS block, 'precedes' AS relation_type, 55e-2 AS score FROM ln WHERE target IS NOT NULL UNION ALL SELECT *, 1, 'causes', 72e-2 FROM ln WHERE target IS NOT NULL AND regexp_matches(ahead, '{"|".join(LOCAL_MARKERS)}'))"""

# event input: what is wrong by sample_id % 16

INPUT = """firsts AS (SELECT *, sample_id % 16 AS k, ord = min(ord) OVER (PARTITION BY sample_id) AS is_first FROM nodes),
sized AS (SELECT sample_id, sample_id % 16 AS k, count(*) AS n, count(DISTINCT document_id) AS d FROM nodes GROUP BY 1)"""

# gold graphs

GOLD = """gi AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord) - 1 AS i FROM nodes), gc AS (SELECT sample_id, count(*) AS n FROM gi GROUP BY 1),
ge AS (SELECT CAST(sample_id AS VARCHAR) AS sample_id, 'maven_e' || i AS event_id, i AS sentence_index, trig, '... some time there was a ' || trig || ' of an ' || trig || ' item ' || k || ' in the shop' AS mention FROM gi WHERE i NOT IN (2, 3)),
gp AS (SELECT sample_id, 0 AS b, i, 1 AS step, 'precedes' AS relation_type, 'PRECONDITION' AS source_relation FROM gi UNION ALL SELECT sample_id, 1, i, 2, 'causes', 'CAUSE' FROM gi),
gk AS (SELECT gp.* FROM gp JOIN gc USING (sample_id) WHERE i + step < n AND i NOT IN (2, 3) AND i + step NOT IN (2, 3))"""

# a whole run

RUN = f"""told0 AS (SELECT sample_id, source, target, CASE WHEN pair_rank % 7 <> 0 THEN rel END AS rel, round(candidate_score, 4) AS score FROM pairs),
gold0 AS (SELECT sample_id, source, target, relation_type FROM temporal),
rt AS (SELECT t.sample_id, t.source, t.target, rel IS NOT NULL AS parsed, coalesce(rel, 'none') AS raw, CASE WHEN score >= 6e-1 THEN coalesce(rel, 'none') ELSE 'none' END AS cut, coalesce(g.relation_type, 'none') AS gold FROM told0 t LEFT JOIN gold0 g USING (sample_id, source, target)),
rc AS (SELECT sample_id, source, target, rel AS relation_type FROM told0 WHERE rel IS NOT NULL AND score >= 6e-1),
rf AS (SELECT c.sample_id, c.source, c.target, c.relation_type, c.relation_type <> 'escalates' AS kept, CASE WHEN c.relation_type <> 'escalates' THEN c.relation_type ELSE 'none' END AS told, coalesce(g.relation_type, 'none') AS gold FROM rc c LEFT JOIN gold0 g USING (sample_id, source, target)),
rr AS (SELECT sample_id, source, target, relation_type FROM rf WHERE kept)"""


def numbers(name: str, source: str, columns: list[str]) -> str:
    """A row of numbers as (metric, value) rows."""
    return " UNION ALL ".join(f"SELECT '{name}.{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM ({source})" for c in columns)


PRF = ["tp", "fp", "fn", "precision", "recall", "f1"]


def classified(name: str, rows: str, told: str) -> str:
    source = f"""WITH x AS (SELECT gold AS g, {told} AS p FROM {rows}), l AS (SELECT g AS label FROM x UNION SELECT p FROM x),
        c AS (SELECT label, count(*) FILTER (g = label AND p = label) AS tp, count(*) FILTER (g <> label AND p = label) AS fp, count(*) FILTER (g = label AND p <> label) AS fn FROM l, x GROUP BY 1), r AS (SELECT label, {prf('tp', 'fp', 'fn')} FROM c),
        m AS (SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM r), t AS (SELECT count(*) AS total, count(*) FILTER (g = p) AS correct FROM x)
        SELECT total, correct, {ratio('correct', 'total')} AS accuracy, m.* FROM t, m"""
    return numbers(name, source, ["total", "correct", "accuracy", "macro_precision", "macro_recall", "macro_f1"])


def yes_or_no(name: str, rows: str, told: str) -> str:
    source = f"""WITH x AS (SELECT gold <> 'none' AS g, {told} AS p FROM {rows}), c AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM x)
        SELECT tp, fp, fn, tn, {prf('tp', 'fp', 'fn')}, {ratio('tp + tn', '(tp + fp + fn + tn)')} AS accuracy FROM c"""
    return numbers(name, source, [*PRF[:3], "tn", *PRF[3:], "accuracy"])


def sets(name: str, rows: str, keys: str) -> str:
    source = f"""WITH m AS (SELECT {keys}, g.sample_id IS NOT NULL AS g, p.sample_id IS NOT NULL AS p FROM (SELECT DISTINCT {keys} FROM gold0) g FULL JOIN (SELECT DISTINCT {keys} FROM {rows}) p USING ({keys})), s AS (SELECT {SUMS} FROM m)
        SELECT tp, fp, fn, {prf('tp', 'fp', 'fn')} FROM s"""
    return numbers(name, source, PRF)


def covering(name: str, rows: str, count: str) -> str:
    source = f"""WITH p AS (SELECT DISTINCT {K3} FROM {rows}), g AS (SELECT DISTINCT {K3} FROM gold0), c AS (SELECT (SELECT count(*) FROM p) AS {count}, (SELECT count(*) FROM p JOIN g USING ({K3})) AS candidate_gold_covered, (SELECT count(*) FROM g) AS n)
        SELECT {count}, candidate_gold_covered, {ratio('candidate_gold_covered', 'n')} AS candidate_gold_coverage FROM c"""
    return numbers(name, source, [count, "candidate_gold_covered", "candidate_gold_coverage"])


EVALUATION = " UNION ALL ".join([
    numbers("dataset", f"SELECT count(DISTINCT sample_id) AS samples, count(DISTINCT ({K3})) AS gold_edges, count(DISTINCT ({K4})) AS gold_labeled_edges FROM gold0", ["samples", "gold_edges", "gold_labeled_edges"]),
    numbers("coarse", f"SELECT {ratio('count(*) FILTER (parsed)', 'count(*)')} AS parse_rate FROM rt", ["parse_rate"]), covering("coarse", "rt", "candidate_pairs"),
    classified("coarse.pair_classification_raw", "rt", "raw"), classified("coarse.pair_classification_thresholded", "rt", "cut"), yes_or_no("coarse.edge_binary_thresholded", "rt", "cut <> 'none'"),
    sets("coarse.graph_unlabeled", "rc", K3), sets("coarse.graph_labeled", "rc", K4), covering("refinement", "rf", "candidate_edges"), yes_or_no("refinement.keep_binary", "rf", "kept"),
    classified("refinement.candidate_label_classification", "rf", "told"), sets("refinement.graph_unlabeled", "rr", K3), sets("refinement.graph_labeled", "rr", K4),
])

# prompts


def event_block(side: str) -> str:
    return f"chr(10) || 'id=' || {side}.event_id || chr(10) || 'doc=' || {side}.document_id || chr(10) || 'sent=' || {side}.sentence_index || chr(10) || 'trigger=' || {side}.trig || chr(10) || 'title=Week ' || {side}.document_id || chr(10) || 'event=' || {side}.text"


def document_block(side: str, role: str) -> str:
    return f"'[{role} Document ' || {side}.document_id || ']' || chr(10) || 'Title: Week ' || {side}.document_id"


KEEP = "1 / (1 + exp(-({logit})))"
LOGIT = "5e-1 * ln(least(greatest({s}, 1e-4), 1 - 1e-4) / (1 - least(greatest({s}, 1e-4), 1 - 1e-4)))"
REFINER = f"""done AS (SELECT sample_id, source, target FROM coarse),
extra0 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY completion_score DESC, so, too) AS pr FROM completion c WHERE NOT EXISTS (SELECT 1 FROM done x WHERE x.sample_id = c.sample_id AND x.source = c.source AND x.target = c.target)),
cands AS (SELECT sample_id, source, target, 'coarse' AS kind, pair_rank AS ord, {KEEP.format(logit=LOGIT.format(s="score") + " + 35e-2")} AS p FROM coarse
    UNION ALL SELECT sample_id, source, target, 'completion', pr + 1000000, {KEEP.format(logit=LOGIT.format(s="round(least(completion_score, 49e-2), 4)") + " - 25e-2")} FROM extra0 WHERE pr <= 64)"""

#: the events of samples that nothing has cut
WHOLE = NODES.replace(f"ev AS (SELECT * FROM evall WHERE rn <= {MAX_EVENTS})", "ev AS (SELECT * FROM evall)")

#: pairs, coarse edges and completions of which no best ones are taken
EVERY_PAIR = PAIRS.replace("pairs0 WHERE pair_rank <= 64", "pairs0")
EVERY_COARSE = COARSE.replace("c2 WHERE pair_rank <= 40", "c2")
EVERY_REFINER = REFINER.replace("extra0 WHERE pr <= 64", "extra0")

ORACLE_SQL = {
    "candidate_pairs_whole": f"WITH {WHOLE}, {PAIRS} SELECT sample_id, pair_rank, source, target, candidate_score FROM pairs",
    "coarse_edges_whole": f"WITH {WHOLE}, {COARSE} SELECT sample_id, pair_rank, source, target, relation_type, score FROM coarse",
    "completion_pairs_whole": f"""WITH {WHOLE}, {TEMPORAL}, {COMPLETION} SELECT sample_id, pair_rank, source, target, completion_score
        FROM (SELECT c.*, row_number() OVER (PARTITION BY c.sample_id ORDER BY completion_score DESC, so, too) AS pair_rank FROM completion c
        WHERE NOT EXISTS (SELECT 1 FROM temporal x WHERE x.sample_id = c.sample_id AND x.source = c.source AND x.target = c.target)) WHERE pair_rank <= 64""",
    "headline_pairs": rf"""WITH d AS (SELECT source, doc_id, {token_set(r"string_split_regex(string_split(text, chr(10))[1], '[.!?]')[1]")} AS w FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
        p AS (SELECT a.source, a.doc_id AS first_id, b.doc_id AS second_id, len(list_intersect(a.w, b.w)) AS common, len(a.w) + len(b.w) AS n FROM d a JOIN d b ON a.source = b.source AND a.doc_id < b.doc_id)
        SELECT source, first_id, second_id, common, round(common / CAST(n - common AS DOUBLE), 9) AS jaccard FROM p WHERE common > 0 AND common / CAST(n - common AS DOUBLE) >= 12e-2""",
    "token_counts": f"SELECT doc_id, len({toks('text')}) AS n_tokens, len(list_distinct({toks('text')})) AS n_distinct FROM documents",
    "normalized_text": f"SELECT item_id, array_to_string({content('text')}, ' ') AS normalized FROM benchmark",
    "sentence_split": f"SELECT doc_id, pos - 1 AS pos, s[pos] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, {sentences('text')} AS s FROM documents))",
    "clause_split": rf"""WITH s AS (SELECT item_id, pos - 1 AS s, x[pos] AS sentence FROM (SELECT item_id, x, unnest(range(1, len(x) + 1)) AS pos FROM (SELECT item_id, {sentences('text')} AS x FROM benchmark))),
        p AS (SELECT item_id, s, trim(sentence, ' ,.-') AS whole, list_filter(list_transform(string_split_regex(sentence, '(?i)\s*(?:,?\s+(?:and|but|while|after|because|since|as|which|who|that)\s+|[;:])\s*'), lambda c: trim(c, ' ,.-')), lambda c: length(c) >= 12) AS k FROM s),
        f AS (SELECT item_id, s, CASE WHEN len(k) > 0 THEN k WHEN length(whole) > 0 THEN [whole] ELSE [] END AS k FROM p)
        SELECT item_id, s, c - 1 AS c, k[c] AS clause FROM (SELECT item_id, s, k, unnest(range(1, len(k) + 1)) AS c FROM f)""",
    "clean_documents": rf"""WITH {NEWS}, l AS (SELECT document_id, array_to_string({content("coalesce(title, '')")}, ' ') AS tn, list_transform(string_split(text, chr(10)), lambda x: {collapse("x")}) AS lines FROM news),
        u AS (SELECT document_id, tn, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l), n AS (SELECT *, array_to_string({content("line")}, ' ') AS norm FROM u),
        k AS (SELECT *, row_number() OVER (PARTITION BY document_id, norm ORDER BY i) AS r FROM n WHERE norm <> '' AND norm <> tn AND NOT (starts_with(lower(line), 'by ') AND len(string_split(line, ' ')) <= 8) AND NOT starts_with(lower(line), 'source:'))
        SELECT document_id, coalesce(cleaned, '') AS cleaned FROM news LEFT JOIN (SELECT document_id, string_agg(line, chr(10) ORDER BY i) AS cleaned FROM k WHERE r = 1 GROUP BY 1) USING (document_id)""",
    "titlecase_entities": r"""SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(e), lambda x: [CAST(lpad(CAST(list_position(e, x) AS VARCHAR), 9, '0') AS VARCHAR), x]))[1:6], lambda y: y[2]), '|') AS entities
        FROM (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'), lambda w: lower(w) NOT IN ('as', 'how', 'what', 'when', 'where', 'which', 'who', 'why')) AS e FROM documents)""",
    "compact_text": f"SELECT doc_id, {compact('text', 120)} AS short FROM documents",
    "event_mentions": f"WITH {NODES} SELECT event_id, sample_id, document_id, sentence_index, text, publish_time, confidence FROM nodes",
    "stems_and_triggers": """SELECT event_type, CASE WHEN length(event_type) + 3 > 5 THEN event_type ELSE event_type || 'ing' END AS stem_ing,
        CASE WHEN length(event_type || 's') > 4 AND ends_with(event_type || 's', 'es') THEN left(event_type, length(event_type) - 1) ELSE event_type END AS stem_s, 'attack' AS "trigger" FROM (SELECT DISTINCT event_type FROM events)""",
    "generic_and_time": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN user_id > 0 THEN 1e0 ELSE 0e0 END WHEN 1 THEN 0e0 WHEN 2 THEN 8e-1 WHEN 3 THEN 6e-1 WHEN 4 THEN 8e-1 ELSE 0e0 END AS time_score, event_id % 3 = 0 AS generic FROM events",
    "time_values": f"""WITH o AS (SELECT o_orderkey, o_orderdate AS d FROM orders) SELECT o_orderkey, epoch(date_trunc('day', d)) / 864e2 AS days, epoch(date_trunc('month', d)) / 864e2 AS month_days, epoch(date_trunc('year', d)) / 864e2 AS year_days,
        {CLIP.format("(epoch(date_trunc('day', d)) / 864e2 - 9e3) / 3e1")} AS months FROM o""",
    "retrieve_documents": f"""WITH {NEWS}, d AS (SELECT document_id, {token_set("title")} AS tt, {token_set("text")} AS bt FROM news), q AS (SELECT item_id AS query_id, {token_set("text")} AS qt FROM benchmark),
        m AS (SELECT query_id, document_id, 14e-1 * {jac("qt", "tt")} + {jac("qt", "bt")} AS score, array_to_string(list_sort(list_distinct(list_concat(list_intersect(qt, tt), list_intersect(qt, bt)))), ' ') AS terms FROM q, d)
        SELECT query_id, document_id, rank, score, terms FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM m WHERE score > 0) WHERE rank <= 6""",
    "lexical_overlap": f"WITH q AS (SELECT item_id, {token_set('text')} AS t FROM benchmark), j AS (SELECT a.item_id AS query_id, b.item_id AS document_id, {jac('a.t', 'b.t')} AS overlap FROM q a JOIN q b ON a.item_id < b.item_id) SELECT * FROM j WHERE overlap > 0",
    "choice_vocabulary": """WITH n AS (SELECT p_type AS event_code, p_brand AS name, count(*) AS c, min(p_partkey) AS f FROM part GROUP BY 1, 2),
        k AS (SELECT event_code, CAST(sum(c) AS BIGINT) AS n, arg_max(name, (c, -f)) AS description FROM n GROUP BY 1 ORDER BY n DESC, event_code LIMIT 40)
        SELECT 'C' || lpad(CAST(row_number() OVER (ORDER BY event_code) AS VARCHAR), 3, '0') AS choice_id, event_code, description, n FROM k""",
    "news_for_requests": f"""WITH {NEWS}, r AS (SELECT o_orderkey AS query_id, unnest([0, 1, 2]) AS pos, unnest([o_custkey * 3 % 997, o_custkey * 5 % 997, o_custkey * 3 % 997]) AS document_id FROM orders)
        SELECT query_id, document_id, CAST(min(pos) AS BIGINT) AS pos, title FROM r JOIN news USING (document_id) GROUP BY query_id, document_id, title""",
    "truncated_events": f"WITH {NODES} SELECT sample_id, event_id, confidence FROM ev",
    "candidate_pairs": f"WITH {NODES}, {PAIRS} SELECT sample_id, pair_rank, source, target, candidate_score FROM pairs",
    "typed_edges": f"WITH {WHOLE}, {EVERY_PAIR} SELECT sample_id, edge_id, source, target, relation_type, candidate_score AS score FROM predicted JOIN pairs USING (sample_id, source, target)",
    "coarse_edges": f"WITH {NODES}, {COARSE} SELECT sample_id, pair_rank, source, target, relation_type, score FROM coarse",
    "negative_pairs": f"WITH {NODES}, {ALL_TEMPORAL} SELECT s.sample_id, s.event_id AS source, t.event_id AS target FROM evall s JOIN evall t ON s.sample_id = t.sample_id AND s.document_id = t.document_id AND s.event_id <> t.event_id AND abs(s.sentence_index - t.sentence_index) <= 3 WHERE NOT EXISTS (SELECT 1 FROM temporal x WHERE x.sample_id = s.sample_id AND x.source = s.event_id AND x.target = t.event_id)",
    "completion_pairs": f"""WITH {NODES}, {TEMPORAL}, {COMPLETION} SELECT sample_id, pair_rank, source, target, completion_score
        FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY completion_score DESC, so, too) AS pair_rank FROM completion c WHERE NOT EXISTS (SELECT 1 FROM temporal x WHERE x.sample_id = c.sample_id AND x.source = c.source AND x.target = c.target)) WHERE pair_rank <= 64""",
    "bridge_pairs": f"""WITH {NODES}, b AS (SELECT s.sample_id, s.event_id AS source, t.event_id AS target, 'security pressure around ' || s.participant || ' intensified' AS bridge_text,
            row_number() OVER (PARTITION BY s.sample_id ORDER BY s.ord, t.ord) AS pair_rank FROM ev s JOIN ev t ON s.sample_id = t.sample_id AND s.participant = t.participant AND s.participant IN ('p1', 'p2')
            WHERE s.trig = 'error' AND t.trig = 'view' AND s.k <> t.k AND NOT (s.document_id = t.document_id AND s.sentence_index >= t.sentence_index))
        SELECT sample_id, pair_rank, source, target, bridge_text FROM b WHERE pair_rank <= 2""",
    "temporal_edges": f"WITH {NODES}, {ALL_TEMPORAL} SELECT sample_id, edge_id, source, target, relation_type, score FROM temporal",
    "event_degrees": f"WITH {NODES}, {COARSE}, {DEGREES} SELECT * FROM deg",
    "edge_dedupe": f"WITH {NODES}, {COARSE} SELECT sample_id, source, target, relation_type, score FROM coarse",
    "truncated_graph": f"WITH {NODES}, {COARSE}, {DEGREES}, {FIRST} SELECT sample_id, event_id FROM kept",
    "truncated_graph_edges": f"WITH {NODES}, {COARSE}, {DEGREES}, {FIRST} SELECT c.sample_id, c.source, c.target, c.relation_type FROM coarse c JOIN kept a ON a.sample_id = c.sample_id AND a.event_id = c.source JOIN kept b ON b.sample_id = c.sample_id AND b.event_id = c.target",
    "pair_label_priority": f"""WITH {NODES}, {TEMPORAL}, {COARSE}, b AS (SELECT sample_id, source, target, relation_type, ord FROM temporal UNION ALL SELECT sample_id, source, target, relation_type, pair_rank + 1000 FROM coarse)
        SELECT sample_id, source, target, arg_max(relation_type, (CASE relation_type WHEN 'causes' THEN 4 WHEN 'escalates' THEN 3 WHEN 'mitigates' THEN 2 ELSE 1 END, -ord)) AS label FROM b GROUP BY 1, 2, 3""",
    "refined_graph": f"WITH {NODES}, {COARSE} SELECT sample_id, 'edge_' || pair_rank AS edge_id, source, target, relation_type, 'KEEP' AS action FROM coarse WHERE 1 / (1 + exp(-(5e-1 * ln(score / (1 - score)) + 35e-2))) >= 6e-1",
    "frontier_nodes": f"""WITH {NODES}, {COARSE}, {ENDS}, o AS (SELECT sample_id, event_id, sum(o) AS o FROM ends GROUP BY 1, 2),
        f AS (SELECT sample_id, event_id, round(o / CAST(greatest(sum(o) OVER (PARTITION BY sample_id), 1) AS DOUBLE), 4) AS frontier_score FROM o)
        SELECT sample_id, rank, event_id, frontier_score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY frontier_score DESC, event_id) AS rank FROM f) WHERE rank <= 5""",
    "best_path": f"""WITH RECURSIVE {NODES}, n AS (SELECT trig AS source, lead(trig) OVER (PARTITION BY sample_id ORDER BY ord) AS target FROM nodes), c AS (SELECT source, target, count(*) AS n FROM n WHERE target IS NOT NULL GROUP BY 1, 2),
        e AS (SELECT source, target, n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE) AS weight FROM c),
        walk(node, score, depth) AS (SELECT 'signup', 1e0, 0 UNION ALL SELECT target, score * weight, depth + 1 FROM walk JOIN e ON node = source WHERE depth < 6 AND (depth = 0 OR node NOT IN ('purchase', 'error')))
        SELECT node AS target, max(score) AS score FROM walk WHERE depth > 0 AND node IN ('purchase', 'error') GROUP BY 1""",
    "attention": f"WITH {NODES}, {COARSE} SELECT sample_id, source, target, round(exp(score * 8 - max(score * 8) OVER w) / sum(exp(score * 8 - m)) OVER w, 6) AS attention FROM (SELECT *, max(score * 8) OVER (PARTITION BY sample_id, target) AS m FROM coarse) WINDOW w AS (PARTITION BY sample_id, target)",
    "temporal_context": f"WITH {NODES}, {TIMES} SELECT sample_id, event_id, event_time, time_valid, cutoff_value, cutoff_valid FROM timed",
    "node_features": f"""WITH {NODES}, {TIMES} SELECT sample_id, event_id, 1e0 AS f0, CAST(len(string_split(norm, ' ')) AS DOUBLE) AS f1, CAST(sentence_index AS DOUBLE) AS f2, confidence AS f3,
        CASE WHEN {" OR ".join(f"contains(norm, '{w}')" for w in QUERY.lower().split())} THEN 1e0 ELSE 0e0 END AS f4, CAST(length(trig) AS DOUBLE) AS f5, event_time AS f6, time_valid AS f7, 0e0 AS f8, 0e0 AS f9 FROM timed""",
    "edge_features": f"""WITH {NODES}, {TIMES}, {COARSE}, {DEGREES}, f AS (SELECT timed.sample_id, timed.event_id, event_time, sentence_index, document_id, out_degree, in_degree FROM timed JOIN deg USING (sample_id, event_id))
        SELECT c.sample_id, c.source, c.target, c.score AS f0, CAST(list_position(['precedes', 'causes', 'escalates', 'mitigates'], relation_type) - 1 AS DOUBLE) AS f1, 0e0 AS f2, 0e0 AS f3, 0e0 AS f4, 0e0 AS f5, 0e0 AS f6,
        s.event_time AS f7, t.event_time AS f8, {CLIP.format("t.event_time - s.event_time")} AS f9, abs({CLIP.format("t.event_time - s.event_time")}) AS f10, least(greatest((t.sentence_index - s.sentence_index) / 8e0, -32e0), 32e0) AS f11,
        CASE WHEN s.document_id <> t.document_id THEN 1e0 ELSE 0e0 END AS f12, CAST(s.out_degree AS DOUBLE) AS f13, CAST(s.in_degree AS DOUBLE) AS f14, CAST(t.out_degree AS DOUBLE) AS f15, CAST(t.in_degree AS DOUBLE) AS f16, 0e0 AS f17, 1e0 AS f18, 0e0 AS f19
        FROM coarse c JOIN f s ON s.sample_id = c.sample_id AND s.event_id = c.source JOIN f t ON t.sample_id = c.sample_id AND t.event_id = c.target""",
    "query_features": f"""WITH {NODES}, {TIMES}, {COARSE}, n AS (SELECT sample_id, count(DISTINCT document_id) AS d, count(*) AS n, max(cutoff_value) AS v FROM timed GROUP BY 1), c AS (SELECT sample_id, count(*) AS n FROM coarse GROUP BY 1)
        SELECT n.sample_id, 2e0 AS f0, CAST(d AS DOUBLE) AS f1, CAST(n.n AS DOUBLE) AS f2, CAST(coalesce(c.n, 0) AS DOUBLE) AS f3, v AS f4, 1e0 AS f5 FROM n LEFT JOIN c USING (sample_id)""",
    "class_weights": f"""WITH {NODES}, {COARSE}, l AS (SELECT unnest({RELATIONS}) AS label), c AS (SELECT label, count(relation_type) AS n FROM l LEFT JOIN coarse ON label = relation_type GROUP BY 1), m AS (SELECT avg(n) AS mean, count(*) AS k FROM c WHERE n > 0)
        SELECT label, n, CASE WHEN k > 1 THEN CASE WHEN n > 0 THEN round(least(greatest(sqrt(mean / n), 1 / 1e1), 1e1), 9) ELSE 0e0 END END AS weight FROM c, m""",
    "labelled_samples": f"WITH {NODES}, {COARSE}, {TEMPORAL} SELECT c.sample_id, c.source, c.target, CAST(t.source IS NOT NULL AS INTEGER) AS edge_label, 0 AS type_id, CASE WHEN t.source IS NULL THEN 0e0 ELSE 55e-2 END AS strength FROM coarse c LEFT JOIN temporal t USING (sample_id, source, target)",
    "set_report": f"WITH {NODES}, {PAIRS}, {TEMPORAL}, {MET.format(k=K3)}, s AS (SELECT {SUMS} FROM met) SELECT tp, fp, fn, {prf('tp', 'fp', 'fn')} FROM s",
    "set_report_per_sample": f"WITH {NODES}, {PAIRS}, {TEMPORAL}, {MET.format(k=K4)}, s AS (SELECT sample_id, {SUMS} FROM met GROUP BY 1) SELECT sample_id, tp, fp, fn, {prf('tp', 'fp', 'fn')} FROM s",
    "micro_report": f"WITH {NODES}, {PAIRS}, {TEMPORAL}, {MET.format(k=K4)}, s AS (SELECT count(DISTINCT sample_id) AS samples, {SUMS} FROM met) SELECT samples, tp, fp, fn, {prf('tp', 'fp', 'fn')}, {ratio('tp + fn', 'samples')} AS average_gold_edges, {ratio('tp + fp', 'samples')} AS average_predicted_edges FROM s",
    "classification_report": f"WITH {LABELS}, {REPORT} SELECT * FROM report",
    "classification_summary": f"WITH {LABELS}, {REPORT}, t AS (SELECT count(*) AS total, count(*) FILTER (gold = predicted) AS correct FROM rows), m AS (SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1 FROM report) SELECT total, correct, correct / CAST(total AS DOUBLE) AS accuracy, m.* FROM t, m",
    "binary_report": f"WITH s AS (SELECT count(*) FILTER (quality = 1 AND doc_id % 2 = 1) AS tp, count(*) FILTER (quality = 0 AND doc_id % 2 = 1) AS fp, count(*) FILTER (quality = 1 AND doc_id % 2 = 0) AS fn, count(*) FILTER (quality = 0 AND doc_id % 2 = 0) AS tn FROM labels) SELECT tp, fp, fn, tn, {prf('tp', 'fp', 'fn')}, {ratio('tp + tn', '(tp + fp + fn + tn)')} AS accuracy FROM s",
    "edge_evaluation": f"""WITH {NODES}, {PAIRS}, {TEMPORAL}, {MET.format(k=K4)}, q AS (SELECT {K3}, bool_or(g) AS g, bool_or(p) AS p, bool_or(g AND p) AS x FROM met GROUP BY 1, 2, 3),
        c AS (SELECT sample_id, count(*) FILTER (x) AS exact, count(*) FILTER (g AND p AND NOT x) AS wrong_type, count(*) FILTER (g AND NOT p) AS missed, count(*) FILTER (p AND NOT g) AS extra FROM q GROUP BY 1),
        n AS (SELECT sample_id, count(*) AS events FROM ev GROUP BY 1), z AS (SELECT sample_id, events, coalesce(exact, 0) AS exact, coalesce(wrong_type, 0) AS wrong_type, coalesce(missed, 0) AS missed, coalesce(extra, 0) AS extra FROM n LEFT JOIN c USING (sample_id))
        SELECT *, {ratio("exact + wrong_type + greatest(events * (events - 1) - exact - wrong_type - missed - extra, 0)", "(events * (events - 1))")} AS pair_accuracy FROM z""",
    "review_tags": f"WITH {NODES}, {PAIRS}, {TEMPORAL} SELECT sample_id, source, target, g.relation_type AS gold_type, p.relation_type AS predicted_type, CASE WHEN g.relation_type IS NULL THEN 'EXTRA' WHEN p.relation_type IS NULL THEN 'MISS' WHEN g.relation_type = p.relation_type THEN 'MATCH' ELSE 'MIS-TYPE' END AS tag FROM temporal g FULL JOIN predicted p USING (sample_id, source, target)",
    "pair_stats": f"WITH {NODES}, {PAIRS} SELECT count(*) AS pairs, count(DISTINCT sample_id) AS samples, count(*) FILTER (rel <> 'none') AS positive_pairs, " + ", ".join(f"count(*) FILTER (rel = '{x}') AS n_{x}" for x in ("none", "precedes", "causes", "escalates", "mitigates")) + f", {ratio("count(*) FILTER (rel <> 'none')", 'count(*)')} AS positive_ratio FROM pairs",
    "answer_scores": "WITH o AS (SELECT o_orderkey, o_custkey % 9 = o_orderkey % 5 AS hit, o_custkey % 9 = o_orderkey % 5 OR o_orderkey % 9 = o_orderkey % 5 AS other FROM orders) SELECT o_orderkey, hit, other AS hit_with_alternatives, CASE WHEN hit THEN 1e0 WHEN other THEN 5e-1 ELSE 0e0 END AS reward FROM o",
    "missing_refs": "SELECT doc_id, 'label' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "with_refs": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "trajectories": f"WITH {NODES}, {COARSE} SELECT sample_id, CAST(count(*) AS VARCHAR) AS observation, 'keep' AS action, count(*) * 2e0 AS reward FROM coarse GROUP BY 1",
    "train_split": f"WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY {mark(7, 'c_custkey')}, c_custkey) AS k, count(*) OVER () AS n FROM customer) SELECT c_custkey, k <= greatest(1, CAST(floor(n * 2e-1) AS BIGINT)) AS is_validation FROM n",
    "training_pairs": f"""WITH {NODES}, {PAIRS}, {TEMPORAL}, w AS (SELECT sample_id, greatest(1, CAST(floor(count(*) * 15e-1) AS BIGINT)) AS most FROM temporal GROUP BY 1),
        neg AS (SELECT {K3}, least(round(candidate_score, 4), 49e-2) AS score, row_number() OVER (PARTITION BY sample_id ORDER BY {mark(7, *K3.split(", "))}, source, target) AS k FROM p0 ANTI JOIN temporal USING ({K3}))
        SELECT {K3}, relation_type AS label, score, false AS is_negative FROM temporal UNION ALL SELECT {K3}, 'none', score, true FROM neg JOIN w USING (sample_id) WHERE k <= most""",
    "perturbed_graph": f"""WITH {NODES}, {PAIRS}, {TEMPORAL}, w AS (SELECT sample_id, greatest(1, CAST(floor(count(*) * 25e-2) AS BIGINT)) AS most FROM temporal GROUP BY 1),
        neg AS (SELECT {K3}, row_number() OVER (PARTITION BY sample_id ORDER BY {mark(10, *K3.split(", "))}, source, target) AS k FROM p0 ANTI JOIN temporal USING ({K3}))
        SELECT {K3}, CASE WHEN {drawn(8, *K3.split(", "))} < 15e-2 THEN {list(RELATIONS)}[CAST(floor({drawn(9, *K3.split(", "))} * 4) AS BIGINT) + 1] ELSE relation_type END AS relation_type, 55e-2 + 4e-1 * {drawn(12, *K3.split(", "))} AS score
            FROM temporal WHERE {drawn(7, *K3.split(", "), "relation_type")} >= 25e-2
        UNION ALL SELECT {K3}, 'precedes', 5e-2 + 5e-1 * {drawn(11, *K3.split(", "))} FROM neg JOIN w USING (sample_id) WHERE k <= most""",
    "synthetic_graphs": f"""WITH {SYNTHETIC}, e AS (SELECT *, {between(21, "5e-1", "1e0", "s", "t")} AS f2, {between(22, "0e0", "1e0", "s", "t")} AS f3, {between(23, "0e0", "1e0", "s", "t")} AS f4, {coin(24, "s", "t")} AS f5, {between(25, "0e0", "1e0", "s", "t")} AS f6,
            CAST(floor({drawn(33, "sample_id", "s", "t")} * 4) AS INTEGER) AS type_id FROM chosen),
        x AS (SELECT *, 34e-2 * f2 + 22e-2 * f3 + 18e-2 * f4 + 16e-2 * f5 + 1e-1 * f6 AS f0 FROM e)
        SELECT sample_id, ord, 'n' || s AS source, 'n' || t AS target, f0, CAST(type_id AS DOUBLE) AS f1, f2, f3, f4, f5, f6, CAST(s AS DOUBLE) AS f7, CAST(t AS DOUBLE) AS f8, CAST(t - s AS DOUBLE) AS f9, CAST(t - s AS DOUBLE) AS f10, (t - s) / 4e0 AS f11,
            0e0 AS f12, 1e0 AS f13, 0e0 AS f14, 0e0 AS f15, 1e0 AS f16, 0e0 AS f17, 1e0 AS f18, 0e0 AS f19, CAST(f0 >= 62e-2 AS INTEGER) AS edge_label, type_id, f0 AS strength FROM x""",
    "synthetic_nodes": f"""WITH {SYNTHETIC} SELECT sample_id, 'n' || ord AS event_id, {between(10, "0e0", "6e0", "ord")} AS f0, {between(11, "3e0", "18e0", "ord")} AS f1, CAST(ord AS DOUBLE) AS f2, {between(12, "3e-1", "95e-2", "ord")} AS f3, {coin(13, "ord")} AS f4,
        {between(14, "3e0", "10e0", "ord")} AS f5, {between(15, "0e0", "8e0", "ord")} AS f6, {coin(16, "ord")} AS f7, {coin(17, "ord")} AS f8, {coin(18, "ord")} AS f9 FROM places""",
    "synthetic_queries": f"""WITH {SYNTHETIC} SELECT sample_id, {between(30, "1e0", "3e0")} AS f0, {between(31, "2e0", "6e0")} AS f1, CAST(n AS DOUBLE) AS f2, CAST(m AS DOUBLE) AS f3, {between(32, "0e0", "8e0")} AS f4, {coin(33)} AS f5 FROM sizes""",
    "normalized_choices": """SELECT p_partkey AS ord, CASE WHEN p_size % 2 = 0 THEN 'P' || p_partkey ELSE printf('C%03d', p_partkey + 1) END AS choice_id, p_type AS event_code, CASE WHEN p_size % 3 > 0 THEN trim(p_name) ELSE '' END AS description FROM part WHERE p_size % 5 > 0""",
    "parsed_forecasts": f"WITH {NODES}, {IDS}, {TOLD} SELECT * FROM told",
    "flat_forecasts": f"""WITH {NODES}, {IDS} SELECT sample_id, k NOT IN (2, 3) AS parsed_json, CASE WHEN k IN (1, 2, 3) THEN code ELSE '' END AS event_code, CASE k WHEN 1 THEN '007|' || code ELSE '' END AS alternatives, k = 4 AS abstain,
        CAST({by_shape("0", "8", str(said_length(2)), str(said_length(3)), "0", "0")} AS BIGINT) AS n_event, CASE k WHEN 1 THEN 5e-1 ELSE 0e0 END AS confidence, CASE k WHEN 1 THEN a ELSE '' END AS support_ids FROM ids""",
    "free_forecasts": f"""WITH {NODES}, {IDS} SELECT sample_id, k IN (1, 4, 5) AS parsed_json, k = 4 AS abstain, CAST({by_shape(str(said_length(0)), "8", str(said_length(2)), str(said_length(3)), "-1", "-1")} AS BIGINT) AS n_event,
        {by_shape("0e0", "5e-1", "0e0", "0e0", "-1e0", "-1e0")} AS confidence, CASE k WHEN 1 THEN a ELSE '' END AS support_ids FROM ids""",
    "forecast_rewards": f"""WITH {NODES}, {COARSE}, {IDS}, {REWARDS} SELECT sample_id, answer, round(form, 6) AS format, round(65e-2 * events_ok + 35e-2 * edges_ok, 6) AS grounding, round(events_ok, 6) AS valid_event_ref_ratio, edges_ok AS valid_edge_ref_ratio,
        temporal, bridge AS graph_bridge, generic AS generic_penalty, density AS density_penalty, total FROM rewards""",
    "code_rewards": f"WITH {NODES}, {COARSE}, {IDS}, {REWARDS}, {TOLD} SELECT sample_id, answer, answer AS total, event_code FROM rewards JOIN told USING (sample_id)",
    "run_rates": f"""WITH {NODES}, {COARSE}, {IDS}, {REWARDS} SELECT count(*) AS samples, 1e0 AS event_input_success_rate, count(*) FILTER (k NOT IN (2, 3)) / CAST(count(*) AS DOUBLE) AS forecast_parse_rate, count(*) FILTER (answer = 1) / CAST(count(*) AS DOUBLE) AS code_hit_rate,
        count(*) FILTER (answer > 0) / CAST(count(*) AS DOUBLE) AS code_hit_with_alternatives_rate, round(sum(total) / count(*), 6) AS average_reward, sum(n) / CAST(count(*) AS DOUBLE) AS average_event_count, sum(edges) / CAST(count(*) AS DOUBLE) AS average_coarse_edge_count, 0e0 AS average_refined_edge_count FROM rewards""",
    "predicted_edges": f"""WITH {NODES}, {IDS}, e AS ({" UNION ALL ".join(f"SELECT sample_id, k, CAST({n} AS BIGINT) AS ord, {a} AS source, {b} AS target, '{r}' AS relation_type, {c} AS score, '{v}' AS evidence, {f"'{w}'" if w else "''"} AS warning FROM ids" for n, (a, b, r, c, v, w) in enumerate(GRAPH_ROWS))})
        SELECT sample_id, ord, source, target, relation_type, score, evidence, warning FROM e WHERE k NOT IN (2, 5) UNION ALL SELECT sample_id, -1, '', '', '', -1e0, '', CASE k WHEN 2 THEN 'no JSON object' ELSE 'edges are no array' END FROM ids WHERE k IN (2, 5)""",
    "extracted_events": f"""WITH {NEWS}, s AS (SELECT document_id AS id, title, {sentences("text")} AS ss FROM news), c AS (SELECT *, [title] || ss AS cands, coalesce(ss[2], '') AS ev FROM s), n AS (SELECT *, list_transform(cands, lambda c: {norm("c")}) AS norms, {norm("ev")} AS en, 'people met there' AS pm FROM c),
        p AS (SELECT *, coalesce(list_position(list_transform(norms, lambda x: en <> '' AND (contains(x, en) OR contains(en, x))), true), 0) AS p1, coalesce(list_position(list_transform(norms, lambda x: contains(x, pm) OR contains(pm, x)), true), 0) AS p2 FROM n)
        SELECT id AS sample_id, 'qwen_e0' AS event_id, 'd' || id AS document_id, CAST(greatest(p1 - 1, 0) AS BIGINT) AS sentence_index, 'Saw' AS "trigger", 'trigger=Saw; mention=' || {compact("(CASE WHEN p1 > 0 THEN cands[p1] ELSE ev END)", 180)} AS text, '' AS participants, 7e-1 AS confidence FROM p WHERE ev <> ''
        UNION ALL SELECT id, 'qwen_e' || CASE WHEN ev <> '' THEN 1 ELSE 0 END, 'd' || id, greatest(p2 - 1, 0), 'met', 'trigger=met; mention=people met there', 'A', 1e0 FROM p""",
    "local_events": f"WITH {NEWS}, {HITS}, {FOUND}, {LOCAL} SELECT sample_id, 'e' || ord AS event_id, CAST(document_id AS VARCHAR) AS document_id, sentence_index, trig AS \"trigger\", text, participants, least(fscore, 95e-2) AS confidence, 'observed' AS node_type FROM local",
    "local_edges": f"WITH {NEWS}, {HITS}, {FOUND}, {LOCAL}, {NEXT} SELECT sample_id, 'edge' || (row_number() OVER (PARTITION BY sample_id ORDER BY rank, block, sentence_index, ord) - 1) AS edge_id, source, target, relation_type, score FROM le",
    "sentence_events": f"WITH {NEWS}, {HITS}, {FOUND}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, sentence_index ORDER BY ci) AS place FROM found) SELECT query_id, document_id, sentence_index, trig AS \"trigger\", clause AS text, fscore AS score FROM f WHERE place = 1",
    "event_input_errors": f"""WITH {NODES}, {INPUT} SELECT sample_id AS ord, CASE WHEN k <> 15 THEN 'q' || sample_id END AS query_id, CASE WHEN k <> 15 THEN 'events_q' || sample_id END AS sample_id,
        CASE k WHEN 1 THEN 'event_id is required' WHEN 2 THEN 'unknown document' WHEN 3 THEN 'sentence_index' WHEN 4 THEN 'sentence_index' WHEN 5 THEN 'confidence' WHEN 6 THEN 'unknown document' WHEN 8 THEN 'must be an object' WHEN 9 THEN 'query_id differs from the query''s'
            WHEN 10 THEN 'no events' WHEN 11 THEN 'must be an array|event_id is required|trigger and mention are required|document_id is required' WHEN 12 THEN 'edges are not allowed' WHEN 13 THEN 'schema_version' WHEN 15 THEN 'not a JSON object|query_id is required' ELSE '' END AS errors,
        CASE WHEN k IN (10, 15) THEN 0 WHEN k = 11 THEN 1 ELSE n END AS n_events, CASE WHEN k = 15 THEN 0 ELSE d END AS n_documents FROM sized""",
    "event_input_events": f"""WITH {NODES}, {INPUT} SELECT 'events_q' || sample_id AS sample_id, 'q' || sample_id AS query_id, event_id, trig AS "trigger", trig || ' item ' || f.k0 AS mention, text, {norm("trig || ' item ' || f.k0")} AS normalized_text, document_id, sentence_index, round(confidence, 3) AS confidence,
        CASE WHEN is_first AND k16 = 7 THEN 'a b' ELSE trig || ' item ' || f.k0 END AS evidence, participant AS participants, 'event-input-v1' AS "schema" FROM (SELECT nodes.*, nodes.k AS k0, sample_id % 16 AS k16, ord = min(ord) OVER (PARTITION BY sample_id) AS is_first FROM nodes) f WHERE k16 IN (0, 7, 14)""",
    "event_input_summary": f"WITH {NODES}, {INPUT}, v AS (SELECT * FROM sized WHERE k IN (0, 7, 14)) SELECT count(*) AS records, CAST(sum(n) AS BIGINT) AS events, (SELECT string_agg('q' || sample_id, '|' ORDER BY sample_id) FROM (SELECT sample_id FROM v ORDER BY 1 LIMIT 20)) AS query_ids, count(*) AS with_query, count(*) AS with_documents FROM v",
    "gold_events": f"WITH {NODES}, {GOLD} SELECT sample_id, event_id, sentence_index, trig AS \"trigger\", 'trigger=' || trig || '; mention=' || mention AS text, lower(trig) AS normalized_text FROM ge",
    "gold_edges": f"WITH {NODES}, {GOLD} SELECT CAST(sample_id AS VARCHAR) AS sample_id, 'gold_edge_' || (row_number() OVER (PARTITION BY sample_id ORDER BY b, i) - 1) AS edge_id, 'maven_e' || i AS source, 'maven_e' || (i + step) AS target, relation_type, 1e0 AS score, source_relation FROM gk",
    "gold_sample_sizes": f"WITH {NODES}, {GOLD} SELECT 'maven_' || sample_id AS sample_id, least(n - 2, 12) AS events, CAST(1 AS BIGINT) AS has_edges FROM gc",
    "relation_report": f"""WITH {NODES}, {PAIRS}, {TEMPORAL}, r AS (SELECT unnest(['precedes', 'causes']) AS relation_type), g AS (SELECT {K4} FROM temporal WHERE ord % 2 = 0), m AS (SELECT {K4}, g.sample_id IS NOT NULL AS g, p.sample_id IS NOT NULL AS p FROM g FULL JOIN (SELECT DISTINCT {K4} FROM predicted) p USING ({K4})),
        c AS (SELECT r.relation_type, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM r LEFT JOIN m USING (relation_type) GROUP BY 1) SELECT relation_type, tp, fp, fn, {prf('tp', 'fp', 'fn')} FROM c""",
    "selected_samples": f"WITH {NODES}, {PAIRS}, s AS (SELECT sample_id, min(ord) AS o FROM nodes GROUP BY 1) SELECT sample_id FROM s WHERE sample_id IN (SELECT sample_id FROM predicted) ORDER BY o LIMIT 20 OFFSET 5",
    "refined_with_completions": f"""WITH {WHOLE}, {EVERY_COARSE}, {COMPLETION}, {EVERY_REFINER}, x AS (SELECT sample_id, 'edge_' || ord AS edge_id, source, target, relation_type, round(score, 4) AS score, p, 'KEEP' AS action, CAST(ord AS INTEGER) AS ord FROM cands JOIN coarse USING (sample_id, source, target) WHERE kind = 'coarse'
        UNION ALL SELECT c.sample_id, 'refined_added_edge_' || ord, c.source, c.target, 'precedes', round(least(completion_score, 49e-2), 4), p, 'ADD', CAST(ord AS INTEGER) FROM cands c JOIN completion e USING (sample_id, source, target) WHERE kind = 'completion')
        SELECT sample_id, edge_id, source, target, relation_type, score, round(p, 4) AS keep_probability, action, ord FROM x WHERE p >= 4e-1""",
    "edge_actions": f"WITH {WHOLE}, {EVERY_COARSE}, {COMPLETION}, {EVERY_REFINER} SELECT sample_id, CASE WHEN kind = 'completion' THEN CASE WHEN p >= 42e-2 THEN 'ADD' ELSE 'REJECT' END WHEN p >= 42e-2 THEN 'KEEP' ELSE 'DROP' END AS action, count(*) AS n FROM cands GROUP BY 1, 2",
    "debug_edges": f"""WITH {NODES}, {COARSE}, {TEMPORAL}, p AS (SELECT sample_id, source, target, pair_rank AS ord, {KEEP.format(logit=LOGIT.format(s="score") + " + 35e-2")} AS p FROM coarse),
        a AS (SELECT p.*, CASE WHEN p >= 6e-1 THEN 'KEEP' ELSE 'DROP' END AS action, CASE WHEN t.source IS NULL THEN 'DROP' ELSE 'KEEP' END AS gold_action FROM p LEFT JOIN temporal t USING (sample_id, source, target))
        SELECT sample_id, source, target, action, gold_action FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY CASE action WHEN 'DROP' THEN 1 ELSE 3 END, CASE action WHEN 'DROP' THEN 0 ELSE -p END, ord) AS place FROM a) WHERE place <= 10""",
    "edge_preview": f"""WITH {NODES}, {COARSE} SELECT c.sample_id, c.source, c.target, s.text AS source_text, t.text AS target_text, 'coarse' AS candidate_kind, c.relation_type AS coarse_type, c.relation_type AS predicted_type, c.score AS coarse_score, round(c.score, 4) AS strength,
        round({KEEP.format(logit=LOGIT.format(s="c.score") + " + 35e-2")}, 4) AS keep_probability FROM coarse c JOIN ev s ON s.sample_id = c.sample_id AND s.event_id = c.source JOIN ev t ON t.sample_id = c.sample_id AND t.event_id = c.target""",
    "edge_payload": f"""WITH {NODES}, {COARSE} SELECT sample_id, length('{{"edges":[' || string_agg('{{"source_event_id":"' || source || '","target_event_id":"' || target || '","relation_type":"' || relation_type || '","score":' || score || '}}', ',') || ']}}') AS n, arg_min(source, pair_rank) AS first FROM coarse GROUP BY 1""",
    "id_sets": f"WITH {NODES}, {COARSE} SELECT sample_id, 'edge_' || pair_rank AS id FROM coarse",
    "evaluation": f"WITH {NODES}, {PAIRS}, {TEMPORAL}, {RUN} SELECT metric, round(value, 9) AS value FROM ({EVALUATION})",
    "edge_sample_stats": f"WITH {NODES}, {COARSE}, {TEMPORAL}, x AS (SELECT c.sample_id, t.source IS NOT NULL AS y FROM coarse c LEFT JOIN temporal t USING (sample_id, source, target)) SELECT count(DISTINCT sample_id) AS samples, count(*) AS edges, count(*) FILTER (y) AS positive_edges, count(*) FILTER (y) AS n_precedes, CAST(0 AS BIGINT) AS n_causes, CAST(0 AS BIGINT) AS n_escalates, CAST(0 AS BIGINT) AS n_mitigates, {ratio('count(*) FILTER (y)', 'count(*)')} AS positive_ratio FROM x",
    "completion_candidates": f"""WITH {NODES}, {COARSE}, {TEMPORAL}, {COMPLETION}, g AS (SELECT DISTINCT {K3} FROM temporal), h AS (SELECT DISTINCT {K3} FROM coarse), n AS (SELECT sample_id, greatest(1, CAST(floor(count(*) * 75e-2) AS BIGINT)) AS most FROM g GROUP BY 1),
        m AS (SELECT e.* FROM everypair e JOIN g USING ({K3}) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sample_id = e.sample_id AND h.source = e.source AND h.target = e.target)),
        r AS (SELECT c.*, row_number() OVER (PARTITION BY c.sample_id ORDER BY completion_score DESC, so, too) AS pr FROM completion c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sample_id = c.sample_id AND h.source = c.source AND h.target = c.target) AND NOT EXISTS (SELECT 1 FROM g WHERE g.sample_id = c.sample_id AND g.source = c.source AND g.target = c.target))
        SELECT {K4}, score, 'coarse' AS source_kind, '' AS kind FROM coarse UNION ALL SELECT {K3}, 'precedes', round(least(completion_score, 49e-2), 4), 'completion', 'completion_gold' FROM m
        UNION ALL SELECT {K3}, 'precedes', round(least(completion_score, 49e-2), 4), 'completion', 'completion_neg' FROM r LEFT JOIN n USING (sample_id) WHERE pr <= coalesce(most, 1)""",
    "pair_prompts": f"""WITH {NODES}, {PAIRS} SELECT p.sample_id, p.pair_rank, {event_block("s")} || chr(10) || chr(10) || 'Target Event:' || {event_block("t")} || chr(10) || chr(10) || 'Document Context:' || chr(10) || {document_block("s", "Source")}
        || CASE WHEN s.document_id = t.document_id THEN '' ELSE chr(10) || chr(10) || {document_block("t", "Target")} END || chr(10) || chr(10) || 'Metadata:' || chr(10) || 'same_document=' || CASE WHEN s.document_id = t.document_id THEN 1 ELSE 0 END || chr(10) || 'sentence_gap=' || (t.sentence_index - s.sentence_index)
        || chr(10) || 'shared_participants=' || CASE WHEN s.participant = t.participant THEN s.participant ELSE 'none' END AS prompt, '{{"relation_type":"' || p.rel || '","score":' || round(p.candidate_score, 4) || '}}' AS target
        FROM pairs p JOIN ev s ON s.sample_id = p.sample_id AND s.event_id = p.source JOIN ev t ON t.sample_id = p.sample_id AND t.event_id = p.target""",
    "forecast_prompts": f"""WITH {NODES}, {COARSE}, e AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord) AS n FROM ev), r AS (SELECT sample_id, event_id, 'H' || lpad(CAST(n AS VARCHAR), 2, '0') AS ref FROM e),
        eb AS (SELECT sample_id, count(*) AS n_events, arg_min(event_id, n) AS h01, string_agg('- H' || lpad(CAST(n AS VARCHAR), 2, '0') || ' | event_id=' || event_id || ' | doc=' || document_id || ' | sent=' || sentence_index || ' | trigger=' || trig || ' | event=' || text || ' | participants=' || participant, chr(10) ORDER BY n) AS t FROM e GROUP BY 1),
        xb AS (SELECT c.sample_id, count(*) AS n_edges, string_agg('- R' || lpad(CAST(pair_rank AS VARCHAR), 2, '0') || ' | edge_id=edge_' || pair_rank || ' | ' || s.ref || ' --' || relation_type || ':' || CAST(CAST(CAST(score AS DECIMAL(10, 4)) AS DECIMAL(10, 3)) AS VARCHAR) || '--> ' || t.ref || ' | source_event_id=' || source || ' | target_event_id=' || target, chr(10) ORDER BY pair_rank) AS t
            FROM coarse c JOIN r s ON s.sample_id = c.sample_id AND s.event_id = c.source JOIN r t ON t.sample_id = c.sample_id AND t.event_id = c.target GROUP BY 1),
        d0 AS (SELECT sample_id, document_id, min(ord) AS o, min(publish_time) AS day, string_agg(trig || ' item ' || k, '. ' ORDER BY trig || ' item ' || k) AS body FROM ev GROUP BY 1, 2),
        db AS (SELECT sample_id, string_agg('[Document ' || document_id || ']' || chr(10) || 'Date: ' || day || chr(10) || 'Title: Week ' || document_id || chr(10) || 'Text: ' || {compact("body", 700)}, chr(10) || chr(10) ORDER BY o) AS t FROM d0 GROUP BY 1),
        cn AS (SELECT p_type AS event_code, p_brand AS name, count(*) AS c, min(p_partkey) AS f FROM part GROUP BY 1, 2), ck AS (SELECT event_code, arg_max(name, (c, -f)) AS name FROM cn GROUP BY 1),
        cb AS (SELECT string_agg('- C' || lpad(CAST(n AS VARCHAR), 3, '0') || ' | event_code=' || event_code || ' | description=' || name, chr(10) ORDER BY n) AS t FROM (SELECT *, row_number() OVER (ORDER BY event_code) AS n FROM ck))
        SELECT eb.sample_id, 'q' || eb.sample_id || chr(10) || 'Query: {QUERY}' || chr(10) || 'Cutoff date: -' || chr(10) || 'Actors: -' || chr(10) || chr(10) || 'Choices:' || chr(10) || cb.t || chr(10) || chr(10) || 'Documents:' || chr(10) || db.t || chr(10) || chr(10)
        || 'Visible historical events:' || chr(10) || eb.t || chr(10) || chr(10) || 'Refined causal edges:' || chr(10) || coalesce(xb.t, '- none') AS prompt, h01, n_events, coalesce(n_edges, -1) AS n_edges FROM eb JOIN db USING (sample_id) LEFT JOIN xb USING (sample_id), cb""",
}

ORACLE_SQL["retrieve_indexed"] = ORACLE_SQL["retrieve_documents"]
