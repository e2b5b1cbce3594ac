"""ANSI SQL equivalents of the registered queries, run on the same tables for checking."""

from __future__ import annotations

from logweave.formats import FORMATS
from logweave.operators import routing, scoring
from logweave.operators.context import CHAT_FRAME, FRAMES, SYSTEM_PROMPT
from logweave.operators.reports import CATEGORIES
from logweave.plans.queries import BASELINE, EVENTS, IP_MASK, KEYWORDS, MODELS, NUMBER_MASK

SPARK_LAYOUT = next(fmt for fmt in FORMATS if fmt.name == "Spark")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


RX = _quoted(SPARK_LAYOUT.plain_regex)
HEADERS = _list(SPARK_LAYOUT.headers)

_CONTENT = """CASE event_id % 4
         WHEN 0 THEN 'user ' || user_id || ' did ' || event_type || ' value ' || printf('%.2f', value)
         WHEN 1 THEN 'request from 10.0.' || (user_id % 256) || '.' || (event_id % 256)
                     || ' took ' || (event_id % 500) || ' ms'
         WHEN 2 THEN 'props ' || props || ' accepted'
         ELSE 'session closed for user ' || user_id END"""

LINES = f"""lines AS (
  SELECT 'events.log' AS log_id, event_id + 1 AS line_no,
    strftime(ts, '%Y-%m-%d %H:%M:%S')
    || CASE event_type WHEN 'error' THEN ' ERROR ' ELSE ' INFO ' END || 'app.' || event_type
    || CASE WHEN event_id % 97 = 0 THEN ' ' ELSE ': ' END
    || {_CONTENT} AS line
  FROM events)"""

PARSED = f"""{LINES},
parsed AS (
  SELECT log_id, line_no, line, h.Date, h.Time, h.Level, h.Component, h.Content
  FROM (SELECT *, regexp_extract(line, {RX}, {HEADERS}) AS h FROM lines WHERE regexp_matches(line, {RX})))"""


def _mask(*patterns: str) -> str:
    text = "Content"
    for pattern in patterns:
        text = f"regexp_replace({text}, {_quoted(pattern)}, '<*>', 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


FULL_MASK = _mask(IP_MASK, NUMBER_MASK)
LIGHT_MASK = _mask(IP_MASK)

MASKED = f"""{PARSED},
masked AS (SELECT *, {FULL_MASK} AS template FROM parsed)"""

CATALOGUE = f"""{MASKED},
found AS (SELECT template, count(*) AS n, min(line_no) AS first_line FROM masked GROUP BY template),
catalogue AS (
  SELECT row_number() OVER (ORDER BY first_line) AS number,
    'Event' || row_number() OVER (ORDER BY first_line) AS EventId,
    template AS EventTemplate, n AS Occurrences, first_line, substr(md5(template), 1, 8) AS template_key
  FROM found)"""

STRUCTURED = f"""{CATALOGUE},
structured AS (
  SELECT m.*, c.EventId, c.EventTemplate FROM masked m JOIN catalogue c ON m.template = c.EventTemplate)"""

PARAMETERS = f"""{STRUCTURED},
patterned AS (
  SELECT *, (length(EventTemplate) - length(replace(EventTemplate, '<*>', ''))) // 3 AS gaps,
    '^' || replace(regexp_replace(regexp_replace(EventTemplate, '([^A-Za-z0-9])', '\\\\\\1', 'g'),
      '\\\\ +', '\\\\s+', 'g'), '\\<\\*\\>', '(.*?)') || '$' AS pattern
  FROM structured),
parameters AS (
  SELECT *,
    CASE WHEN gaps = 0 OR NOT regexp_matches(Content, pattern) THEN ''
         WHEN gaps = 1 THEN regexp_replace(Content, pattern, '\\1')
         ELSE regexp_replace(Content, pattern, '\\1|\\2') END AS parameters,
    CASE WHEN regexp_matches(Content, pattern) THEN gaps ELSE 0 END AS n_parameters
  FROM patterned)"""

# Mining line by line: one walk per number of tokens, with the list of clusters as its state.  ``c``
# holds the clusters (k: first token of the branch, t: tokens), ``own`` the cluster of the line.
# One token is the branch key, and lines of one token are their own templates.
MINED = f"""{PARSED},
light AS (SELECT *, {LIGHT_MASK} AS t FROM parsed),
grouped AS (
  SELECT len(string_split(t, ' ')) AS n, list(t ORDER BY line_no) AS texts, list(line_no ORDER BY line_no) AS nos
  FROM light WHERE len(string_split(t, ' ')) > 1 GROUP BY 1),
walk AS (
  SELECT n, 0::BIGINT AS i, 0::BIGINT AS own, []::STRUCT(k VARCHAR, t VARCHAR[])[] AS c FROM grouped
  UNION ALL
  SELECT n, i + 1,
    CASE WHEN found THEN place ELSE len(c) + 1 END,
    CASE WHEN found
      THEN list_transform(c, lambda x, j: CASE WHEN j = place THEN {{'k': x.k, 't': list_transform(x.t, lambda y, p:
             CASE WHEN y = b[p] THEN y ELSE '<*>' END)}} ELSE x END)
      ELSE list_append(c, {{'k': CASE WHEN list_contains(kids, b[1]) THEN b[1]
             WHEN regexp_matches(b[1], '[0-9]') OR len(kids) >= CASE WHEN list_contains(kids, '<*>') THEN 100 ELSE 99 END
             THEN '<*>' ELSE b[1] END, 't': b}}) END
  FROM (
    SELECT *, best // 1000000000 >= 0.5 * n AND best >= 0 AS found, list_position(scores, best)::BIGINT AS place
    FROM (
      SELECT *, coalesce(list_max(scores), -1) AS best
      FROM (
        SELECT *, list_transform(c, lambda x, j: CASE WHEN x.k = branch THEN
            len(list_filter(x.t, lambda y, p: y <> '<*>' AND y = b[p])) * 1000000000
            + len(list_filter(x.t, lambda y: y = '<*>')) * 1000000 + 999999 - j ELSE -1 END) AS scores
        FROM (
          SELECT *, CASE WHEN list_contains(kids, b[1]) THEN b[1] WHEN list_contains(kids, '<*>') THEN '<*>' END AS branch
          FROM (
            SELECT w.n, w.i, w.c, string_split(g.texts[w.i + 1], ' ') AS b,
              list_distinct(list_transform(w.c, lambda x: x.k)) AS kids
            FROM walk w JOIN grouped g ON g.n = w.n WHERE w.i < len(g.texts))))))),
ended AS (SELECT w.n, w.c FROM walk w JOIN grouped g ON g.n = w.n AND w.i = len(g.texts)),
assigned AS (
  SELECT g.nos[w.i] AS line_no, array_to_string(e.c[w.own].t, ' ') AS template
  FROM walk w JOIN grouped g ON g.n = w.n JOIN ended e ON e.n = w.n WHERE w.i > 0
  UNION ALL SELECT line_no, t FROM light WHERE len(string_split(t, ' ')) = 1),
mined AS (SELECT template, count(*) AS n, min(line_no) AS first_line FROM assigned GROUP BY template),
mined_events AS (
  SELECT 'Event' || row_number() OVER (ORDER BY first_line) AS EventId, template AS EventTemplate, n AS Occurrences,
    first_line, substr(md5(template), 1, 8) AS template_key
  FROM mined),
mined_lines AS (
  SELECT p.line_no, row_number() OVER (ORDER BY p.line_no) AS LineId, p.Content, e.EventId, e.EventTemplate,
    (length(EventTemplate) - length(replace(EventTemplate, '<*>', ''))) // 3 AS gaps,
    '^' || replace(regexp_replace(regexp_replace(EventTemplate, '([^A-Za-z0-9])', '\\\\\\1', 'g'),
      '\\\\ +', '\\\\s+', 'g'), '\\<\\*\\>', '(.*?)') || '$' AS pattern
  FROM parsed p JOIN assigned a ON a.line_no = p.line_no JOIN mined_events e ON e.EventTemplate = a.template)"""

QUESTIONS = """asked AS (
  SELECT conv_id * 1000 + turn AS question_id, conv_id AS c, turn AS t, text, (conv_id * 7 + turn) % 10 AS kind
  FROM conversations WHERE role = 'user'),
questions AS (
  SELECT question_id, CASE kind
    WHEN 0 THEN 'Summarize the log.'
    WHEN 1 THEN 'What happened at ' || lpad((c % 24)::VARCHAR, 2, '0') || ':' || lpad((t * 7 % 60)::VARCHAR, 2, '0')
                || ':' || lpad(((c + t) % 60)::VARCHAR, 2, '0') || '?'
    WHEN 2 THEN 'How many times does ''app.' || (['click', 'error', 'purchase', 'signup', 'view'])[c % 5 + 1]
                || ''' occur in the log file?'
    WHEN 3 THEN 'What is the event Event' || (c % 12 + 1) || '?'
    WHEN 4 THEN 'What kind of log file is this?'
    WHEN 5 THEN 'Are there any abnormal activities?'
    WHEN 6 THEN 'What is a Brute Force Attack?'
    WHEN 7 THEN 'Which users are named in the event ' || (c % 9 + 1) || ' and in Event' || (t % 9 + 1) || '?'
    WHEN 8 THEN 'What are ''user ' || (c % 150) || ''' and ''ERROR'' in this log?'
    ELSE '' END || ' ' || text AS question
  FROM asked)"""

_EVENT, _CLOCK, _QUOTE, _DOUBLE = map(
    _quoted, (routing.EVENT_NAME, routing.CLOCK_TIME, routing.QUOTED, routing.DOUBLE_QUOTED)
)


def _distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


_ALL_KEYWORDS = (
    f"list_concat(list_concat(regexp_extract_all(question, {_QUOTE}, 1), regexp_extract_all(question, {_DOUBLE}, 1)), "
    f"regexp_extract_all(question, {_CLOCK}))"
)
_ALL_EVENTS = f"list_transform(regexp_extract_all(question, {_EVENT}, 1), lambda x: 'Event' || x)"

ROUTED = f"""{QUESTIONS},
level1 AS (
  SELECT *, CASE
    WHEN regexp_matches(regexp_replace(regexp_replace(question, {_QUOTE}, ' ', 'g'), {_DOUBLE}, ' ', 'g'),
      {_quoted(routing.WHOLE_LOG)}) THEN 'all'
    WHEN regexp_matches(question, {_EVENT}) OR regexp_matches(question, {_CLOCK})
      OR regexp_matches(question, {_QUOTE}) OR regexp_matches(question, {_DOUBLE})
      OR regexp_matches(question, {_quoted(routing.LOG_TOPIC)}) THEN 'partial'
    ELSE 'generation' END AS level1
  FROM questions),
level2 AS (
  SELECT *, CASE
    WHEN level1 <> 'partial' THEN NULL
    WHEN regexp_matches(question, {_EVENT}) THEN 'event'
    WHEN regexp_matches(question, {_CLOCK}) OR regexp_matches(question, {_QUOTE}) OR regexp_matches(question, {_DOUBLE}) THEN 'search'
    ELSE 'retrieve' END AS level2
  FROM level1),
routed AS (
  SELECT *,
    CASE WHEN level2 = 'search' THEN {_distinct(_ALL_KEYWORDS)} ELSE [] END AS keywords,
    CASE WHEN level2 = 'event' THEN {_distinct(_ALL_EVENTS)} ELSE [] END AS events,
    upper(level1[1]) || level1[2:] || coalesce(' > ' || upper(level2[1]) || level2[2:], '') AS route
  FROM level2)"""

KEYWORD_HITS = """hits AS (
  SELECT q.question_id, l.line_no, l.line
  FROM routed q JOIN lines l
    ON len(list_filter(q.keywords, lambda k: contains(lower(l.line), lower(k)))) > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY line_no) AS place,
    count(*) OVER (PARTITION BY question_id) AS n_matched
  FROM hits)"""

CHUNKS = f"""{LINES},
sized AS (
  SELECT line_no, line, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda t: t <> '')) AS n FROM lines),
cum AS (SELECT *, sum(n) OVER (ORDER BY line_no)::BIGINT AS total FROM sized),
walk AS (
  SELECT min(line_no)::BIGINT AS line_from, 0::BIGINT AS used FROM cum
  UNION ALL
  SELECT * FROM (
    SELECT min(c.line_no)::BIGINT AS line_from, (SELECT p.total FROM cum p WHERE p.line_no = min(c.line_no) - 1)
    FROM walk w JOIN cum c ON c.line_no > w.line_from AND c.total - w.used > 1024) WHERE line_from IS NOT NULL),
owned AS (SELECT c.*, w.line_from FROM cum c ASOF JOIN walk w ON c.line_no >= w.line_from)"""

ANSWERS_WIDE = f"""wide AS (
  SELECT CASE d.lang WHEN 'es' THEN '---es' ELSE d.lang END AS sheet, d.doc_id AS question_id,
    ({_list(CATEGORIES)})[d.doc_id % 7 + 1] AS category, d.text AS expected,
    d.text AS "copy", b.text AS bench,
    CASE WHEN b.text IS NULL THEN d.text ELSE b.text || ' ' || d.text END AS joined,
    CASE WHEN l.quality = 1 THEN d.text END AS labelled
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark) LEFT JOIN labels l ON l.doc_id = d.doc_id),
answers AS (
  SELECT sheet, question_id, category, expected, model, answer
  FROM (SELECT * FROM wide WHERE NOT starts_with(sheet, '---'))
  UNPIVOT (answer FOR model IN ("copy", bench, joined, labelled)))"""

_NORMAL = "lower(regexp_replace(trim({0}), '([.!?])\\s+', '\\1 ', 'g'))"
_WORDS = "regexp_extract_all(" + _NORMAL + ", '[\\p{{L}}\\p{{N}}_]{{2,}}')"

SCORES = f"""{ANSWERS_WIDE},
words AS (
  SELECT sheet, question_id, category, model, 0 AS kind, 'e' AS side, unnest({_WORDS.format('expected')}) AS word FROM answers
  UNION ALL
  SELECT sheet, question_id, category, model, 0, 'a', unnest({_WORDS.format('answer')}) FROM answers
  UNION ALL
  SELECT sheet, question_id, category, model, 1, 'e', unnest(regexp_extract_all(lower(expected), '[a-z0-9]+')) FROM answers
  UNION ALL
  SELECT sheet, question_id, category, model, 1, 'a', unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) FROM answers),
counts AS (
  SELECT sheet, question_id, category, model, kind, word,
    count(*) FILTER (side = 'e') AS e, count(*) FILTER (side = 'a') AS a
  FROM words WHERE kind = 1 OR word NOT IN (SELECT unnest({_list(scoring.STOP_WORDS)}))
  GROUP BY ALL),
idf AS (SELECT *, CASE WHEN e > 0 AND a > 0 THEN 1.0::DOUBLE ELSE 1 + ln(1.5::DOUBLE) END AS w FROM counts),
sums AS (
  SELECT sheet, question_id, category, model,
    sum(e * a) FILTER (kind = 0) AS dot, sum((e * w) * (e * w)) FILTER (kind = 0) AS e2,
    sum((a * w) * (a * w)) FILTER (kind = 0) AS a2, sum(least(e, a)) FILTER (kind = 1) AS overlap,
    sum(e) FILTER (kind = 1) AS n_e, sum(a) FILTER (kind = 1) AS n_a
  FROM idf GROUP BY ALL),
scores AS (
  SELECT p.sheet, p.question_id, p.category, p.model,
    CASE WHEN e2 > 0 AND a2 > 0 THEN dot / sqrt(e2 * a2) ELSE 0 END AS cosine,
    CASE WHEN overlap > 0 THEN 2.0::DOUBLE * overlap / (n_e + n_a) ELSE 0 END AS rouge1
  FROM answers p LEFT JOIN sums s USING (sheet, question_id, category, model))"""

METRICS = f"""metrics AS (
  SELECT lang AS sheet, ({_list(CATEGORIES)})[doc_id % 7 + 1] AS category, 'model-' || (doc_id % 5) AS model,
    unnest(['Cosine Similarity', 'ROUGE-1 F1']) AS metric,
    unnest([(n_chars * 31 + doc_id * 17) % 1000 / 1000.0::DOUBLE, (n_chars * 13 + doc_id * 7) % 1000 / 1000.0::DOUBLE]) AS value
  FROM documents),
cells AS (SELECT sheet, category, model, metric, avg(value) AS value FROM metrics GROUP BY ALL),
means AS (
  SELECT category, model, metric, round_even(avg(value) * 100, 0) / 100 AS value FROM cells GROUP BY ALL),
improved AS (
  SELECT m.category, m.metric, m.model, (b.value - m.value) / b.value * 100 AS improvement
  FROM means m JOIN means b ON b.category = m.category AND b.metric = m.metric AND b.model = '{BASELINE}'
  WHERE m.model <> '{BASELINE}'),
category_improved AS (
  SELECT category, metric, round_even(avg(improvement) * 100, 0) / 100 AS improvement FROM improved GROUP BY ALL),
per_sheet AS (SELECT sheet, model, metric, avg(value) AS value FROM metrics GROUP BY ALL),
model_mean AS (SELECT model, metric, avg(value) AS value FROM per_sheet GROUP BY ALL)"""


def _quartiles(keys: str, source: str = "metrics") -> str:
    return (
        f"SELECT {keys}, count(*) AS n_values, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, "
        f"quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM {source} GROUP BY {keys}"
    )


LENGTHS = "lengths AS (SELECT doc_id, lang AS category, n_chars::DOUBLE AS value FROM documents)"
FENCES = f"""{LENGTHS},
spread AS ({_quartiles('category', 'lengths')}),
fenced AS (
  SELECT l.*, q1 - 1.5 * iqr AS low, q3 + 1.5 * iqr AS high FROM lengths l JOIN spread USING (category))"""

ROBUST = f"""{METRICS},
spread AS ({_quartiles('category, model, metric')}),
compared AS (
  SELECT s.*, b.iqr AS base, CASE WHEN s.model <> '{BASELINE}' THEN b.iqr - s.iqr END AS difference
  FROM spread s JOIN spread b ON b.category = s.category AND b.metric = s.metric AND b.model = '{BASELINE}')"""


def _pivot(source: str, ids: str, key: str, names: list[str]) -> str:
    cells = ", ".join(f"round(avg(value) FILTER ({key} = {_quoted(n)}), 6) AS \"{n}\"" for n in names)
    return f"SELECT {ids}, {cells} FROM {source} GROUP BY {ids.split(', list_position')[0]}"


_BY_MODEL = _pivot(
    "metrics", "sheet, model", "metric || ' (' || category || ')'",
    [f"{metric} ({category})" for category in CATEGORIES for metric in ("Cosine Similarity", "ROUGE-1 F1")],
)
_BY_CATEGORY = _pivot(
    "metrics", f"sheet, category, list_position({_list(CATEGORIES)}, category)::BIGINT AS position", "model || ' ' || metric",
    [f"{model} {metric}" for model in MODELS for metric in ("Cosine Similarity", "ROUGE-1 F1")],
)

_STRICT = " UNION ALL ".join(
    f"SELECT log_id, {_quoted(f.name)} AS format, {i} AS position, {f.required_literal_length} AS literals, "
    f"count(*) AS n_lines, count(*) FILTER (regexp_matches(line, {_quoted(f.strict_regex)})) AS n_strict "
    "FROM lines GROUP BY log_id"
    for i, f in enumerate(FORMATS)
)

EXCHANGES = """exchanges AS (
  SELECT conv_id, turn, text AS user_input, CASE WHEN next_role = 'assistant' THEN next_text END AS response
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user')"""


ROUTED_EXCHANGES = (
    "questions AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS question_id, user_input AS question FROM exchanges)"
    + ROUTED.removeprefix(QUESTIONS)
)


def _like_format(text: str, *arguments: str) -> str:
    """SQL that puts the arguments at the ``%s`` marks."""
    parts = text.split("%s")
    pieces = [_quoted(parts[0])]
    for argument, part in zip(arguments, parts[1:], strict=True):
        pieces += [f"coalesce(({argument})::VARCHAR, '')", _quoted(part)]
    return " || ".join(pieces)


def _chat(text: str) -> str:
    return _like_format(CHAT_FRAME, _quoted(SYSTEM_PROMPT), text)


def _advice(lines: tuple[str, ...]) -> str:
    return _quoted("\n".join(lines))


def _cut(cap: int) -> str:
    return f"CASE WHEN trimmed THEN {_quoted(FRAMES.cut % cap)} ELSE '' END"


_SUMMARY_TEXT = _chat(_like_format(
    FRAMES.whole, "w.log_id", "w.n_lines", "w.n_events", "w.first_line", "w.last_line", "p.events_text",
    _advice(FRAMES.whole_advice), "q.question",
))
_SEARCH_TEXT = _chat(_like_format(
    FRAMES.search, "array_to_string(keywords, ', ')", "n_matched", _cut(200), "context", _advice(FRAMES.lines_advice), "q.question"
))
_EVENT_TEXT = _chat(_like_format(
    FRAMES.event, "array_to_string(events, ', ')", "n_matched", _cut(150), "event_rows", "context",
    _advice(FRAMES.lines_advice), "q.question",
))
_RETRIEVE_TEXT = _chat(_like_format(FRAMES.retrieve, "context", _advice(FRAMES.retrieve_advice), "q.question"))

SUMMARY = """extent AS (
  SELECT log_id, min_by(line, line_no) AS first_line, max_by(line, line_no) AS last_line, count(*) AS n_lines
  FROM lines GROUP BY log_id),
whole AS (SELECT *, (SELECT count(*) FROM catalogue) AS n_events FROM extent),
pages AS (
  SELECT 0::BIGINT AS page,
    string_agg(EventId || ',' || EventTemplate || ',' || Occurrences, chr(10) ORDER BY number) AS events_text
  FROM catalogue)"""

# Chunks chosen for a question: TF-IDF of the words themselves, the two best, the first ones where too few share a word.
CHOSEN = """chunk_text AS (
  SELECT line_from, string_agg(line, chr(10) ORDER BY line_no) AS text FROM owned GROUP BY line_from),
chunk_words AS (
  SELECT line_from, word, count(*) AS n FROM (
    SELECT line_from, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS word FROM chunk_text)
  GROUP BY ALL),
word_idf AS (
  SELECT word, ln((1 + (SELECT count(*) FROM chunk_text)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM chunk_words GROUP BY word),
chunk_weights AS (
  SELECT line_from, word, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY line_from)) AS w
  FROM chunk_words JOIN word_idf USING (word)),
asked_words AS (
  SELECT question_id, word, count(*) AS n FROM (
    SELECT question_id, unnest(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda t: t <> '')) AS word
    FROM routed WHERE level2 = 'retrieve')
  GROUP BY ALL),
asked_weights AS (
  SELECT question_id, word, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY question_id)) AS w
  FROM asked_words JOIN word_idf USING (word)),
chunk_scores AS (
  SELECT question_id, line_from, max(score) AS score FROM (
    SELECT question_id, line_from, round(sum(a.w * c.w), 9) AS score
    FROM asked_weights a JOIN chunk_weights c USING (word) GROUP BY ALL
    UNION ALL
    SELECT question_id, line_from, 0 FROM routed, (SELECT line_from FROM chunk_text ORDER BY line_from LIMIT 2)
    WHERE level2 = 'retrieve')
  GROUP BY ALL),
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, line_from) AS place FROM chunk_scores)"""

CONTEXTS = """asked_events AS (SELECT question_id, unnest(events) AS EventId FROM routed),
event_totals AS (
  SELECT question_id, sum(Occurrences)::BIGINT AS n,
    string_agg(EventId || ',' || EventTemplate || ',' || Occurrences, chr(10) ORDER BY number) AS event_rows
  FROM asked_events JOIN catalogue USING (EventId) GROUP BY 1),
event_ranked AS (
  SELECT question_id, s.line_no, s.line, row_number() OVER (PARTITION BY question_id ORDER BY s.line_no) AS place
  FROM asked_events JOIN structured s USING (EventId)),
shown AS (
  SELECT question_id, line_no AS place, line FROM ranked WHERE place <= 200
  UNION ALL SELECT question_id, place, line FROM event_ranked WHERE place <= 150
  UNION ALL SELECT question_id, place, text FROM chosen JOIN chunk_text USING (line_from) WHERE place <= 2),
gathered AS (
  SELECT question_id, count(*) AS n_context, string_agg(line, chr(10) ORDER BY place) AS context FROM shown GROUP BY 1),
keyword_totals AS (SELECT question_id, count(*) AS n FROM hits GROUP BY 1),
answered AS (
  SELECT *, level1 <> 'all' AND (level1 <> 'partial' OR n_matched = 0) AS direct,
    coalesce((level2 = 'search' AND n_matched >= 200) OR (level2 = 'event' AND n_matched >= 150), false) AS trimmed
  FROM (
    SELECT r.*, e.event_rows, coalesce(g.n_context, 0) AS n_context, coalesce(g.context, '') AS context,
      CASE WHEN level1 = 'all' THEN (SELECT count(*) FROM catalogue)
           ELSE coalesce(CASE level2 WHEN 'search' THEN k.n WHEN 'event' THEN e.n WHEN 'retrieve' THEN g.n_context END, 0) END AS n_matched
    FROM routed r
    LEFT JOIN keyword_totals k USING (question_id)
    LEFT JOIN event_totals e USING (question_id)
    LEFT JOIN gathered g USING (question_id)))"""

_DISPATCH = """SELECT question_id, route, n_matched, trimmed, direct, n_context, md5(context) AS context_md5,
  array_to_string(keywords, '|') AS keywords, array_to_string(events, '|') AS events FROM answered"""

# Every fifth question has a router's decision, of three choices in turn.
_RULED = ROUTED.replace("routed AS (", "ruled AS (")
DECIDED = f"""{_RULED},
routed AS (
  SELECT question_id, question,
    CASE WHEN question_id % 5 <> 0 THEN level1 WHEN question_id % 15 = 10 THEN 'all' ELSE 'partial' END AS level1,
    CASE WHEN question_id % 5 <> 0 THEN level2 WHEN question_id % 15 = 0 THEN 'search' WHEN question_id % 15 = 5 THEN 'event' END AS level2,
    CASE WHEN question_id % 5 <> 0 THEN keywords WHEN question_id % 15 = 0 THEN ['purchase', 'User 1'] ELSE [] END AS keywords,
    CASE WHEN question_id % 5 <> 0 THEN events WHEN question_id % 15 = 5 THEN ['Event2', 'Event5'] ELSE [] END AS events,
    CASE WHEN question_id % 5 <> 0 THEN route WHEN question_id % 15 = 0 THEN 'Partial > Search'
      WHEN question_id % 15 = 5 THEN 'Partial > Event' ELSE 'All' END AS route
  FROM ruled)"""
_LOG_PARTS = f"{CHUNKS}, {STRUCTURED.removeprefix(LINES + ',')}"

# The layout of a line follows from its event; so do its parts.
LAYOUTS = f"""layouts(place, format, n_headers) AS (VALUES {
    ", ".join(f"({place}, '{fmt.name}', {len(fmt.headers)}::BIGINT)" for place, fmt in enumerate(FORMATS))
}),
layout_lines AS (
  SELECT format, n_headers, event_id // 16 + 1 AS line_no,
    CASE WHEN format IN ('HDFS', 'Hadoop', 'Spark', 'Zookeeper', 'BGL', 'OpenStack') THEN if(event_type = 'error', 'ERROR', 'INFO')
         WHEN format = 'Windows' THEN if(event_type = 'error', 'Error', 'Info')
         WHEN format = 'Linux' THEN 'combo'
         WHEN format = 'Android' THEN if(event_type = 'error', 'E', 'I')
         WHEN format = 'Apache' THEN if(event_type = 'error', 'error', 'notice') END AS level,
    {_CONTENT} AS content
  FROM events JOIN layouts ON place = event_id % 16)"""

SQL: dict[str, str] = {
    "read_text_log": f"""WITH {LINES}
        SELECT substr(line, 1, 10) AS day, row_number() OVER (PARTITION BY substr(line, 1, 10) ORDER BY line_no) AS place, line
        FROM lines""",
    "parse_lines": f"WITH {PARSED} SELECT line_no, Date, Time, Level, Component, Content FROM parsed",
    "line_ids": f"WITH {PARSED} SELECT line_no, row_number() OVER (ORDER BY line_no) AS LineId FROM parsed",
    "rejected_lines": f"WITH {LINES} SELECT line_no, line FROM lines WHERE NOT regexp_matches(line, {RX})",
    "coverage": f"""WITH {LINES}, c AS (
        SELECT log_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, {RX})) AS n_parsed
        FROM lines GROUP BY log_id) SELECT *, n_parsed / n_lines AS coverage FROM c""",
    "log_extent": f"""WITH {LINES} SELECT log_id, min_by(line, line_no) AS first_line,
        max_by(line, line_no) AS last_line, count(*) AS n_lines FROM lines GROUP BY log_id""",
    "sample_lines": f"""WITH {LINES} SELECT line_no, line FROM lines
        ORDER BY md5('0:' || log_id || ':' || line_no), line_no LIMIT 10""",
    "format_scores": f"""WITH {LINES}, s AS ({_STRICT})
        SELECT log_id, format, n_strict, n_lines,
          row_number() OVER (PARTITION BY log_id ORDER BY n_strict DESC, literals DESC, position) AS format_rank
        FROM s""",
    "detect_format": f"""WITH {LAYOUTS} SELECT format || '.log' AS log_id, format, count(*) AS n_parsed, count(*) AS n_lines,
        1.0::DOUBLE AS coverage FROM layout_lines GROUP BY format""",
    "parse_detected": f"""WITH {LAYOUTS} SELECT format || '.log' AS log_id, line_no, format, content, level, n_headers
        FROM layout_lines""",
    "mask_templates": f"WITH {MASKED} SELECT template, count(*) AS n_lines FROM masked GROUP BY template",
    "tokenise": f"""WITH {PARSED} SELECT line_no, len(regexp_split_to_array(Content, '\\s+')) AS n_tokens,
        array_to_string(regexp_split_to_array(Content, '\\s+'), '|') AS tokens FROM parsed""",
    "digit_tokens": f"""WITH {PARSED} SELECT line_no, array_to_string(list_filter(
        regexp_split_to_array(Content, '\\s+'), lambda t: regexp_matches(t, '[0-9]')), '|') AS digit_tokens FROM parsed""",
    "event_catalogue": f"""WITH {CATALOGUE}
        SELECT EventId, EventTemplate, Occurrences, first_line, template_key FROM catalogue""",
    "structured_log": f"WITH {STRUCTURED} SELECT line_no, Level, Component, EventId, EventTemplate FROM structured",
    "param_list": f"WITH {PARAMETERS} SELECT line_no, EventId, n_parameters, parameters FROM parameters",
    "template_similarity": f"""WITH {STRUCTURED}, t AS (
        SELECT line_no, string_split(EventTemplate, ' ') AS a, string_split({LIGHT_MASK}, ' ') AS b FROM structured)
        SELECT line_no, round(len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> '<*>' AND a[i] = b[i])) / len(a), 6)
          AS similarity FROM t""",
    "template_match": f"""WITH {CATALOGUE},
        l AS (SELECT line_no, {LIGHT_MASK} AS t, string_split({LIGHT_MASK}, ' ') AS b FROM parsed),
        e AS (SELECT number, EventId, string_split(EventTemplate, ' ') AS a FROM catalogue),
        pairs AS (
          SELECT t, number, EventId, len(a) AS n,
            len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> '<*>' AND a[i] = b[i])) AS hits,
            len(list_filter(a, lambda x: x = '<*>')) AS wild
          FROM (SELECT DISTINCT t, b FROM l) JOIN e ON len(a) = len(b)),
        best AS (
          SELECT *, row_number() OVER (PARTITION BY t ORDER BY hits DESC, wild DESC, number) AS place FROM pairs)
        SELECT line_no, best.EventId, round(hits / n, 6) AS similarity
        FROM l LEFT JOIN best ON best.t = l.t AND place = 1 AND hits / n >= 0.5""",
    "template_merge": f"""WITH {PARSED}, l AS (SELECT {LIGHT_MASK} AS t FROM parsed),
        k AS (SELECT t, string_split(t, ' ') AS b FROM l),
        p AS (SELECT len(b) AS n_tokens, b[1] AS first_token, unnest(b) AS token, unnest(range(1, len(b) + 1)) AS place FROM k),
        m AS (SELECT n_tokens, first_token, place, count(*) AS n,
                CASE WHEN min(token) = max(token) THEN min(token) ELSE '<*>' END AS token FROM p GROUP BY 1, 2, 3)
        SELECT n_tokens, first_token, string_agg(token, ' ' ORDER BY place) AS merged_template, max(n) AS n_lines
        FROM m GROUP BY 1, 2""",
    "mine_templates": f"""WITH RECURSIVE {MINED}
        SELECT EventId, EventTemplate, Occurrences, first_line, template_key FROM mined_events""",
    "mined_log": f"""WITH RECURSIVE {MINED}
        SELECT line_no, LineId, EventId, EventTemplate,
          CASE WHEN gaps = 0 OR NOT regexp_matches(Content, pattern) THEN ''
            ELSE regexp_replace(Content, pattern, array_to_string(list_transform(range(1, gaps + 1), lambda i: '\\' || i), '|'))
            END AS parameters
        FROM mined_lines""",
    "parsing_accuracy": f"""WITH RECURSIVE {MINED}, g AS (
        SELECT (line_no - 1) % 4 AS kind, EventTemplate AS mined, count(*) AS n FROM mined_lines GROUP BY 1, 2),
        t AS (SELECT *, sum(n) OVER (PARTITION BY kind) AS a, sum(n) OVER (PARTITION BY mined) AS b FROM g),
        p AS (SELECT sum(n * (n - 1) / 2) AS shared, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM g GROUP BY kind)) AS pa,
          (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM g GROUP BY mined)) AS pb,
          sum(n)::BIGINT AS n_lines, sum(CASE WHEN n = a AND n = b THEN n ELSE 0 END) / sum(n) AS grouped FROM t)
        SELECT 'events.log' AS log_id, n_lines, round(shared / pb, 6) AS "precision", round(shared / pa, 6) AS recall,
          round(2 * shared / (pa + pb), 6) AS f1, round(grouped, 6) AS grouping_accuracy FROM p""",
    "mined_stream": f"WITH RECURSIVE {MINED} SELECT line_no, EventTemplate FROM mined_lines",
    "mined_lengths": f"""WITH {PARSED}, l AS (SELECT line_no, len(string_split({LIGHT_MASK}, ' ')) AS n_tokens FROM parsed)
        SELECT n_tokens, count(*) AS n_lines, min(line_no) AS first_line FROM l GROUP BY n_tokens""",
    "keyword_search": f"""WITH {LINES} SELECT line_no, line FROM lines
        WHERE {' OR '.join(f"contains(lower(line), {_quoted(k.lower())})" for k in KEYWORDS)}""",
    "capped_search": f"""WITH {LINES}, m AS (
        SELECT row_number() OVER (ORDER BY line_no) AS place, line_no, line, count(*) OVER () AS n_matched
        FROM lines WHERE contains(lower(line), 'app.error'))
        SELECT *, n_matched >= 200 AS trimmed FROM m WHERE place <= 200""",
    "keyword_search_batch": f"""WITH {LINES}, {ROUTED}, {KEYWORD_HITS}
        SELECT question_id, coalesce(max(n_matched), 0) AS n_matched, count(line_no) AS n_shown,
          coalesce(max(n_matched), 0) >= 200 AS trimmed, min(line_no) AS first_line, max(line_no) AS last_line
        FROM (SELECT question_id FROM routed WHERE len(keywords) > 0)
        LEFT JOIN (SELECT * FROM ranked WHERE place <= 200) USING (question_id) GROUP BY question_id""",
    "keyword_matches": f"""WITH {LINES}, {ROUTED}, sets AS (
        SELECT DISTINCT list_sort(list_transform(keywords, lambda k: lower(k))) AS k FROM routed WHERE len(keywords) > 0)
        SELECT array_to_string(k, '|') AS keywords, line_no, line FROM sets JOIN lines
        ON len(list_filter(k, lambda w: contains(lower(line), w))) > 0""",
    "event_search": f"""WITH {STRUCTURED} SELECT line_no, EventId, line FROM structured
        WHERE list_contains({_list(EVENTS)}, EventId)""",
    "event_lookup": f"""WITH {CATALOGUE} SELECT EventId, EventTemplate, Occurrences FROM catalogue
        WHERE list_contains({_list(EVENTS)}, EventId)""",
    "event_lines": f"""WITH {STRUCTURED} SELECT EventId,
        row_number() OVER (PARTITION BY EventId ORDER BY line_no) AS place, line_no, line FROM structured""",
    "event_pages": f"""WITH {STRUCTURED}, p AS (
        SELECT EventId, (row_number() OVER (PARTITION BY EventId ORDER BY line_no) - 1) // 1000 AS page, line_no, line
        FROM structured)
        SELECT EventId, page, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS lines_md5
        FROM p GROUP BY 1, 2""",
    "event_mentions": """WITH a AS (
        SELECT conv_id, turn, 'Event' || (conv_id % 9 + 1) AS e1, 'Event' || (turn % 9 + 1) AS e2,
          regexp_extract_all(text, '\\bEvent\\d+\\b') AS own
        FROM conversations WHERE role = 'assistant'),
        m AS (SELECT conv_id, turn, list_concat(own, CASE WHEN e1 = e2 THEN [e1] ELSE [e1, e2] END) AS all_events FROM a)
        SELECT conv_id, turn, unnest(range(len(all_events))) AS place, unnest(all_events) AS EventId FROM m""",
    "mention_lines": f"""WITH {STRUCTURED}, named AS (
        SELECT EventId, count(*) AS n_mentions FROM (
          SELECT DISTINCT conv_id, turn, unnest(['Event' || (conv_id % 9 + 1), 'Event' || (turn % 9 + 1)]) AS EventId
          FROM conversations WHERE role = 'assistant') GROUP BY EventId)
        SELECT EventId, line_no, line, n_mentions FROM structured JOIN named USING (EventId)""",
    "chunks": f"""WITH RECURSIVE {CHUNKS} SELECT line_from, max(line_no) AS line_to,
        count(*) AS n_lines, sum(n)::BIGINT AS n_tokens FROM owned GROUP BY line_from""",
    "chunk_texts": f"""WITH RECURSIVE {CHUNKS}, t AS (
        SELECT line_from, string_agg(line, chr(10) ORDER BY line_no) AS text FROM owned GROUP BY line_from)
        SELECT line_from, md5(text) AS text_md5, length(text) AS n_chars FROM t""",
    "chunk_vectors": """WITH w AS (
        SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS word FROM documents),
        b AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY 1, 2),
        i AS (SELECT word, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM b GROUP BY word),
        x AS (SELECT doc_id, word, tf * idf AS w FROM b JOIN i USING (word))
        SELECT doc_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""",
    "vector_topk": """WITH p AS (
        SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings),
        m AS (SELECT label, place, avg(x) AS x FROM p GROUP BY 1, 2),
        q AS (SELECT label, list(x ORDER BY place) AS vector FROM m GROUP BY label),
        s AS (SELECT q.label, v.vec_id, list_cosine_similarity(q.vector, v.embedding::DOUBLE[]) AS score FROM q CROSS JOIN embeddings v),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place FROM s)
        SELECT label::BIGINT AS label, vec_id, place, round(score, 5) AS score FROM r WHERE place <= 5""",
    "vector_index": """SELECT vec_id AS query_id, least(10, (SELECT count(*) FROM embeddings)) AS n_found,
        vec_id AS first_id, true AS enough FROM embeddings WHERE vec_id % 20 = 0""",
    "summary_context": f"WITH {CATALOGUE}, {SUMMARY} SELECT log_id, first_line, last_line, n_lines, n_events FROM whole",
    "catalogue_pages": f"WITH {CATALOGUE}, {SUMMARY} SELECT page, events_text FROM pages",
    "route_l1": f"WITH {ROUTED} SELECT question_id, level1 AS choice FROM routed",
    "route_l2": f"""WITH {ROUTED} SELECT question_id, level2 AS choice, array_to_string(keywords, '|') AS keywords,
        array_to_string(events, '|') AS events, route FROM routed WHERE level1 = 'partial'""",
    "router_json": f"""WITH {ROUTED} SELECT question_id,
        CASE WHEN level1 <> 'generation' THEN coalesce(level2, level1) END AS choice,
        CASE WHEN level1 <> 'generation' THEN array_to_string(keywords, '|') END AS keywords,
        CASE WHEN level1 <> 'generation' THEN array_to_string(events, '|') END AS events,
        level1 <> 'generation' AS usable FROM routed""",
    "dispatch": f"WITH RECURSIVE {_LOG_PARTS}, {ROUTED}, {KEYWORD_HITS}, {CHOSEN}, {CONTEXTS} {_DISPATCH}",
    "dispatch_decided": f"WITH RECURSIVE {_LOG_PARTS}, {DECIDED}, {KEYWORD_HITS}, {CHOSEN}, {CONTEXTS} {_DISPATCH}",
    "prompts": f"""WITH RECURSIVE {_LOG_PARTS}, {SUMMARY}, {ROUTED}, {KEYWORD_HITS}, {CHOSEN}, {CONTEXTS}, made AS (
        SELECT question_id, route, CASE
          WHEN direct THEN {_chat("q.question")}
          WHEN level1 = 'all' THEN {_SUMMARY_TEXT}
          WHEN level2 = 'event' THEN {_EVENT_TEXT}
          WHEN level2 = 'retrieve' THEN {_RETRIEVE_TEXT}
          ELSE {_SEARCH_TEXT} END AS prompt
        FROM answered q, whole w, pages p)
        SELECT question_id, route, md5(prompt) AS prompt_md5, length(prompt) AS n_chars FROM made""",
    "summary_prompts": f"""WITH {CATALOGUE}, {SUMMARY}, {ROUTED}
        SELECT q.question_id, p.page, {_SUMMARY_TEXT} AS prompt
        FROM routed q CROSS JOIN whole w CROSS JOIN pages p WHERE q.level1 = 'all'""",
    "exchanges": f"WITH {EXCHANGES} SELECT conv_id, turn, user_input, response FROM exchanges",
    "exchange_metrics": f"""WITH {EXCHANGES}, t AS (SELECT *, (length(user_input) + 100) / 64.0::DOUBLE AS elapsed FROM exchanges)
        SELECT conv_id, turn, printf('%.2f', floor(elapsed * 100 + 0.5) / 100) || ' seconds' AS response_time,
          round(length(response) / elapsed, 6) AS chars_per_second FROM t""",
    "saved_exchanges": f"""WITH {EXCHANGES}, {ROUTED_EXCHANGES}
        SELECT user_input, response, 'Route: ' || route
          || CASE WHEN len(keywords) > 0 THEN ' | Keywords: ' || array_to_string(keywords, ', ') ELSE '' END
          || CASE WHEN len(events) > 0 THEN ' | Events: ' || array_to_string(events, ', ') ELSE '' END
          || ' | Time Taken: ' || printf('%.2f', floor(elapsed * 100 + 0.5) / 100) || ' s'
          || ' | Tokens/Second: ' || printf('%.2f', coalesce(length(response), 0) / elapsed) AS extra_info,
          '2024-01-01 00:00:00' AS timestamp, '1.00 seconds' AS response_time
        FROM routed JOIN (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS question_id,
          (length(user_input) + 100) / 64.0::DOUBLE AS elapsed FROM exchanges) USING (question_id)""",
    "replaced_results": f"""WITH {STRUCTURED} SELECT CASE WHEN line_no % 2 = 0 THEN 'even.log' ELSE 'odd.log' END AS log_id,
        line_no, EventId FROM structured WHERE line_no % 2 = 0 OR Level = 'ERROR'""",
    "structured_roundtrip": f"WITH {PARAMETERS} SELECT log_id, line_no, EventId, Content, parameters FROM parameters",
    "catalogue_csv": f"""WITH {CATALOGUE}
        SELECT 'events.log' AS log_id, EventId, EventTemplate, Occurrences, first_line, template_key FROM catalogue""",
    "metric_files": f"""WITH {METRICS} SELECT sheet, category, model, metric,
        round_even(value * 100, 0) / 100 AS value FROM cells""",
    "answers_long": f"""WITH {ANSWERS_WIDE} SELECT sheet, question_id, category, model, md5(answer) AS answer_md5 FROM answers""",
    "normalise_text": f"SELECT doc_id, md5({_NORMAL.format('text')}) AS text_md5 FROM documents",
    "tfidf_cosine": f"WITH {SCORES} SELECT question_id, model, round(cosine, 6) AS cosine FROM scores",
    "rouge1": f"WITH {SCORES} SELECT question_id, model, round(rouge1, 6) AS rouge1 FROM scores",
    "mean_scores": f"""WITH {SCORES} SELECT sheet, model, category, round(avg(cosine), 6) AS cosine,
        round(avg(rouge1), 6) AS rouge1 FROM scores GROUP BY ALL""",
    "pivot_by_model": f"WITH {METRICS} {_BY_MODEL}",
    "melt_metrics": f"""WITH {SCORES}, m AS (
        SELECT sheet, model, category, avg(cosine) AS c, avg(rouge1) AS r FROM scores GROUP BY ALL)
        SELECT sheet, model, category, 'Cosine Similarity' AS metric, round(c, 6) AS value FROM m
        UNION ALL SELECT sheet, model, category, 'ROUGE-1 F1', round(r, 6) FROM m""",
    "pivot_by_category": f"WITH {METRICS} {_BY_CATEGORY}",
    "mean_reports": f"""WITH {METRICS}, c AS (
        SELECT sheet, category, model, metric, avg(value) AS value FROM metrics GROUP BY ALL),
        m AS (SELECT sheet, model, metric, avg(value) AS value FROM metrics GROUP BY ALL)
        SELECT 'cell' AS report, sheet, category, model, metric, round(value, 6) AS value FROM c
        UNION ALL SELECT 'category', NULL, category, model, metric, round(avg(value), 6) FROM c GROUP BY category, model, metric
        UNION ALL SELECT 'model', NULL, NULL, model, metric, round(avg(value), 6) FROM m GROUP BY model, metric""",
    "category_mean": f"WITH {METRICS} SELECT category, model, metric, value FROM means",
    "improvement": f"WITH {METRICS} SELECT category, metric, model, round(improvement, 6) AS improvement FROM improved",
    "category_improvement": f"WITH {METRICS} SELECT category, metric, improvement FROM category_improved",
    "top_categories": f"""WITH {METRICS}, a AS (
        SELECT category, avg(improvement) AS improvement FROM category_improved GROUP BY category),
        r AS (SELECT *, row_number() OVER (ORDER BY improvement DESC, category) AS place FROM a)
        SELECT category, round(improvement, 6) AS improvement, place FROM r WHERE place <= 3""",
    "total_improvement": f"""WITH {METRICS} SELECT metric, round(avg(improvement), 6) AS improvement
        FROM category_improved GROUP BY metric""",
    "model_means": f"""WITH {METRICS} SELECT model, metric, round(value, 6) AS value,
        row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS place FROM model_mean""",
    "overall_improvement": f"""WITH {METRICS}, d AS (
        SELECT m.metric, m.model, (b.value - m.value) / b.value * 100 AS improvement FROM model_mean m
        JOIN model_mean b ON b.metric = m.metric AND b.model = '{BASELINE}' WHERE m.model <> '{BASELINE}')
        SELECT metric, model, round(improvement, 6) AS improvement,
          round(avg(improvement) OVER (PARTITION BY metric), 6) AS mean_improvement FROM d""",
    "task_ranking": f"""WITH {METRICS}, t AS (
        SELECT metric, category, avg(value) AS value FROM metrics WHERE model = '{BASELINE}' GROUP BY ALL)
        SELECT metric, category, round(value, 6) AS value,
          row_number() OVER (PARTITION BY metric ORDER BY value DESC, category) AS place FROM t""",
    "iqr": f"""WITH {METRICS}, q AS ({_quartiles('model, metric')})
        SELECT model, metric, n_values, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr FROM q""",
    "median": f"""WITH {METRICS} SELECT model, metric, count(*) AS n_values, round(median(value), 6) AS median
        FROM metrics GROUP BY ALL""",
    "outliers": f"""WITH {FENCES} SELECT category, doc_id, value, round(low, 6) AS low, round(high, 6) AS high
        FROM fenced WHERE value < low OR value > high""",
    "outlier_share": f"""WITH {FENCES}, n AS (
        SELECT category, count(*) AS n_values, count(*) FILTER (value < low OR value > high) AS n_outliers
        FROM fenced GROUP BY category)
        SELECT *, round(n_outliers / n_values * 100, 6) AS percent FROM n""",
    "iqr_narrowing": f"""WITH {METRICS}, q AS ({_quartiles('model, metric')})
        SELECT q.metric, round(avg(q.iqr / b.iqr - 1) * 100, 6) AS narrowing FROM q
        JOIN q b ON b.metric = q.metric AND b.model = '{BASELINE}' WHERE q.model <> '{BASELINE}' GROUP BY q.metric""",
    "category_robustness": f"""WITH {ROBUST}, r AS (
        SELECT category, metric, avg(difference) / avg(iqr) * 100 AS percent FROM compared GROUP BY ALL)
        SELECT category, metric, round(percent, 6) AS percent,
          CASE WHEN percent > 0 THEN 'wider' ELSE 'narrower' END AS label FROM r""",
    "final_robustness": f"""WITH {ROBUST}, r AS (
        SELECT metric, avg(difference) / avg(iqr) FILTER (model = '{BASELINE}') * 100 AS percent FROM compared GROUP BY metric)
        SELECT metric, round(percent, 6) AS percent,
          CASE WHEN percent > 0 THEN 'wider' ELSE 'narrower' END AS label FROM r""",
    "plot_inputs": f"""WITH {METRICS},
        q AS (SELECT category, model, metric, count(*) AS n_values, quantile_cont(value, 0.25) AS q1,
                median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM metrics GROUP BY ALL),
        m AS (SELECT m.*, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS outlier
              FROM metrics m JOIN q USING (category, model, metric))
        SELECT category, model, metric, n_values, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
          round(min(value) FILTER (NOT outlier), 6) AS whisker_low,
          round(max(value) FILTER (NOT outlier), 6) AS whisker_high, count(*) FILTER (outlier) AS n_outliers
        FROM q JOIN m USING (category, model, metric) GROUP BY ALL""",
}
